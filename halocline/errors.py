"""Errors by what went wrong, and outcomes that carry a value or an error.

Errors about input and settings are ``ValueError``s and the others ``RuntimeError``s too, so callers need not know this
module to catch them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class ClusteringError(Exception):
    """Base of all; ``kind`` is one of settings, columns, rows, fitting, internal."""

    kind = "internal"

    def __init__(self, message: str, **facts: Any):
        super().__init__(message)
        self.facts = facts


class SettingsError(ClusteringError, ValueError):
    kind = "settings"


class UnknownName(SettingsError):
    """A name that no divergence, transform, strategy or preset has."""

    def __init__(self, what: str, name: str, known: list[str]):
        super().__init__(f"unknown {what} {name!r}; one of {', '.join(known)}", what=what, name=name, known=known)


class OutOfRange(SettingsError):
    def __init__(self, setting: str, value: Any, wanted: str):
        super().__init__(f"{setting} is {value!r}, must be {wanted}", setting=setting, value=value)


class UnfitTransform(SettingsError):
    """A feature transform whose values are outside a divergence's domain."""


class ColumnError(ClusteringError, ValueError):
    kind = "columns"


class MissingColumn(ColumnError):
    def __init__(self, column: str, there: list[str]):
        super().__init__(f"no column {column!r} among {', '.join(there)}", column=column, there=there)


class RowError(ClusteringError, ValueError):
    kind = "rows"


class EmptyTable(RowError):
    def __init__(self) -> None:
        super().__init__("the table is empty")


class MixedDimensions(RowError):
    def __init__(self, sizes: int):
        super().__init__(f"features must have one dimension, not {sizes}", sizes=sizes)


class BrokenRule(RowError):
    def __init__(self, rule: str, rows: int, detail: str = ""):
        super().__init__(f"{rows} rows fail the rule {rule}{f' ({detail})' if detail else ''}", rule=rule, rows=rows)


class TooManyRows(RowError):
    """More rows than a method that needs all pairs takes."""


class FittingError(ClusteringError, RuntimeError):
    kind = "fitting"


class NotConverged(FittingError):
    def __init__(self, iterations: int, cost: float):
        super().__init__(f"not converged after {iterations} iterations (cost {cost:g})", iterations=iterations, cost=cost)


class CostRose(FittingError):
    def __init__(self, iteration: int, before: float, after: float):
        super().__init__(f"cost rose from {before:g} to {after:g} in iteration {iteration}", iteration=iteration, before=before, after=after)


class NothingAssigned(FittingError):
    def __init__(self, iteration: int):
        super().__init__(f"no cluster has a point in iteration {iteration}", iteration=iteration)


class NotFitted(ClusteringError, RuntimeError):
    pass


@dataclass(frozen=True)
class Outcome:
    """The value of a call, or the error that it raised."""

    value: Any = None
    error: ClusteringError | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    def then(self, f: Callable[[Any], Any]) -> Outcome:
        return attempt(f, self.value) if self.ok else self

    def get(self, otherwise: Any = None) -> Any:
        return self.value if self.ok else otherwise

    def unwrap(self) -> Any:
        if self.error is not None:
            raise self.error
        return self.value


def attempt(f: Callable[..., Any], *args: Any, **named: Any) -> Outcome:
    """Only errors of this module become outcomes; others (bugs, lost clusters) are raised."""
    try:
        return Outcome(f(*args, **named))
    except ClusteringError as e:
        return Outcome(error=e)
