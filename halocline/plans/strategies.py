"""Parts of a fit by name, and a loop for updates of one's own.

To extend: a divergence is a ``functions.divergences.Divergence``, an assignment a function like ``operators.assign.assign``
with a fixed strategy, an update one like ``gradient`` below, and a loop any state with a step and a cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial
from typing import Any, Generic, TypeVar

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from halocline.errors import UnknownName
from halocline.functions.divergences import Divergence, make
from halocline.operators.assign import STRATEGIES, assign
from halocline.operators.update import cluster_sums, hard, new_centres, weighted_medians
from halocline.plans.elkan import BOUNDED_FROM, bounded_lloyd
from halocline.plans.lloyd import LloydResult, lloyd, refill

State = TypeVar("State")
#: (df, features, centres, divergence, weight) -> centres after one update.
Update = Callable[[DataFrame, str, np.ndarray, Divergence, str | None], np.ndarray]
#: What becomes of empty clusters, by name: an option of ``lloyd``.
EMPTY = {"random": "reseed", "reseed": "reseed", "reseedRandom": "reseed", "drop": "drop", "keep": "keep"}


def assignment(name: str = "auto") -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise UnknownName("strategy", name, STRATEGIES)
    return partial(assign, strategy=name)


def gradient(df: DataFrame, features: str, centres: np.ndarray, div: Divergence, weight: str | None = None) -> np.ndarray:
    """inv_grad of the mean gradients of each cluster; an empty one keeps its centre."""
    sums = cluster_sums(df, features, len(centres), hard(centres, div), div.grad or (lambda x: x), weight)
    return new_centres(sums, centres, div, "dual")


def medians(df: DataFrame, features: str, centres: np.ndarray, div: Divergence, weight: str | None = None) -> np.ndarray:
    """Weighted medians of each cluster, a component at a time."""
    new = np.array(centres, dtype=float)
    for row in weighted_medians(assign(df, features, new, div), features, "cluster", weight).collect():
        new[row["cluster"], row["pos"]] = row["median"]
    return new


def update(divergence: str) -> Update:
    """Medians for L1, gradient means for the others."""
    return medians if make(divergence).name == "l1" else gradient


def empty_handler(name: str) -> Callable[[DataFrame, str, np.ndarray, np.ndarray, Divergence], np.ndarray]:
    """(df, features, centres, empty slots, divergence) -> centres."""
    if name not in EMPTY:
        raise UnknownName("empty-cluster policy", name, sorted(EMPTY))
    return {"reseed": refill, "drop": lambda df, features, centres, empty, div: centres[~empty], "keep": lambda df, features, centres, empty, div: centres}[EMPTY[name]]


def loop(div: Divergence, k: int, accelerate: bool = False) -> Callable[..., LloydResult]:
    """The loop with bounds (``bounded_lloyd``) if asked for and of use, else Lloyd's. Called with df, features and centres, then max_iter, tol and weight by name."""
    if accelerate and div.name == "squaredEuclidean" and k >= BOUNDED_FROM:
        return bounded_lloyd
    return lambda df, features, centres, **options: lloyd(df, features, centres, div, **options)


@dataclass
class Progress(Generic[State]):
    state: State
    costs: list[float] = field(default_factory=list)
    converged: bool = False

    @property
    def iterations(self) -> int:
        return len(self.costs)


def iterate(state: State, step: Callable[[State], tuple[State, float]], max_iter: int = 20, tol: float = 1e-4, improving: bool = False) -> Progress[State]:
    """Repeats ``step`` until its cost changes by less than ``tol`` of itself. With ``improving``, a cost that falls does not count as converged (for costs that are to rise, such as a likelihood)."""
    out = Progress(state)
    for _ in range(max_iter):
        out.state, cost = step(out.state)
        out.costs.append(float(cost))
        if len(out.costs) > 1:
            change = (out.costs[-1] - out.costs[-2]) / max(abs(out.costs[-2]), 1e-10)
            if abs(change) < tol and not (improving and change < 0):
                out.converged = True
                break
    return out


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` persisted within the block."""
    held = df.persist(level)
    try:
        yield held
    finally:
        held.unpersist()


@contextmanager
def shared(spark: SparkSession, value: Any) -> Iterator[Broadcast]:
    """A value on every executor within the block; for values of a known size."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()
