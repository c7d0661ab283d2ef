"""Events of fits, for whoever listens.

    with listen(Memory()) as events:
        KMeans(k=3).fit(df)
    events.summary()

Events are emitted on the driver, once or twice an iteration. Nothing is computed for them that the loop does not need,
so listening adds no job. Without a listener they go nowhere.
"""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

KINDS = ("started", "iteration", "empty_clusters", "converged", "warning", "finished")


@dataclass(frozen=True)
class Event:
    kind: str
    facts: dict[str, Any]
    at: float = field(default_factory=time.time)


class Memory:
    """Keeps all events."""

    def __init__(self) -> None:
        self.events: list[Event] = []

    def take(self, event: Event) -> None:
        self.events.append(event)

    def of(self, kind: str) -> list[Event]:
        return [e for e in self.events if e.kind == kind]

    def summary(self) -> dict[str, Any]:
        """Iterations, seconds, first and last cost, whether it converged, empty clusters, warnings."""
        turns = self.of("iteration")
        return {
            "iterations": len(turns),
            "seconds": self.events[-1].at - self.events[0].at if self.events else 0.0,
            "first_cost": turns[0].facts["cost"] if turns else None,
            "last_cost": turns[-1].facts["cost"] if turns else None,
            "converged": bool(self.of("converged")),
            "empty_clusters": sum(e.facts["count"] for e in self.of("empty_clusters")),
            "warnings": [e.facts["message"] for e in self.of("warning")],
        }

    def report(self) -> str:
        begun = self.events[0].at if self.events else 0.0
        return "\n".join(f"{e.at - begun:9.3f} s  {e.kind:14}  " + " ".join(f"{k}={v}" for k, v in e.facts.items()) for e in self.events)


class Log:
    """Writes events to a logger; warnings as warnings."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("halocline")

    def take(self, event: Event) -> None:
        self.logger.log(logging.WARNING if event.kind == "warning" else logging.INFO, "%s %s", event.kind, event.facts)


_sinks: ContextVar[tuple] = ContextVar("sinks", default=())


@contextlib.contextmanager
def listen(sink) -> Iterator:
    """``sink.take(event)`` gets the events emitted inside the block, besides the sinks around it."""
    token = _sinks.set((*_sinks.get(), sink))
    try:
        yield sink
    finally:
        _sinks.reset(token)


def emit(kind: str, **facts: Any) -> None:
    if kind not in KINDS:
        raise ValueError(f"no event {kind!r}")
    for sink in _sinks.get():
        sink.take(Event(kind, facts))
