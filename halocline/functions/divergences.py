"""Divergences D(x, centre): as distance matrices (NumPy, for Arrow batches) and as Column expressions.

The centre is the second argument. ``grad`` and ``inv_grad`` give the dual mean inv_grad(mean(grad(x))).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from halocline.errors import UnknownName

EPSILON = 1e-10
NORM_FLOOR = 1e-10

Array = np.ndarray


@dataclass(frozen=True)
class Divergence:
    name: str
    #: (n, d), (k, d) -> (n, k)
    matrix: Callable[[Array, Array], Array]
    #: Term of one dimension, summed over dimensions; ``None`` where D is no such sum.
    term: Callable[[Column, Column], Column] | None
    grad: Callable[[Array], Array] | None
    inv_grad: Callable[[Array], Array] | None
    grad_column: Callable[[Column], Column] | None = None
    domain: str = "finite"


def _square(x: Array, c: Array) -> Array:
    return np.maximum(0.0, 0.5 * ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T))


def _l1(x: Array, c: Array) -> Array:
    return np.stack([np.abs(x - m).sum(1) for m in c], axis=1)


def _unit(x: Array) -> Array:
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.where(norm > NORM_FLOOR, x / np.maximum(norm, NORM_FLOOR), x)


def _spherical(x: Array, c: Array) -> Array:
    return 1 - np.clip(_unit(x) @ _unit(c).T, -1, 1)


def make(name: str, smoothing: float = EPSILON) -> Divergence:
    """The divergence of a name or alias, in any case."""
    e = smoothing
    key = ALIASES.get(name.strip().lower())
    if key == "squaredEuclidean":
        return Divergence(key, _square, lambda x, c: 0.5 * (x - c) * (x - c), lambda x: x, lambda t: t, lambda x: x)
    if key == "kl":

        def kl(x: Array, c: Array) -> Array:
            x = x + e
            return (x * np.log(x)).sum(1)[:, None] - x @ np.log(c + e).T

        return Divergence(key, kl, lambda x, c: (x + e) * F.log((x + e) / (c + e)), lambda x: np.log(x + e) + 1, lambda t: np.exp(t - 1), lambda x: F.log(x + e) + 1, "positive")
    if key == "itakuraSaito":

        def itakura(x: Array, c: Array) -> Array:
            x, c = x + e, c + e
            return x @ (1 / c).T - np.log(x).sum(1)[:, None] + np.log(c).sum(1) - x.shape[1]

        return Divergence(key, itakura, lambda x, c: (x + e) / (c + e) - F.log((x + e) / (c + e)) - 1, lambda x: -1 / (x + e), lambda t: -1 / t, lambda x: -1 / (x + e), "positive")
    if key == "generalizedI":

        def general(x: Array, c: Array) -> Array:
            x, c = x + e, c + e
            return (x * np.log(x) - x).sum(1)[:, None] - x @ np.log(c).T + c.sum(1)

        return Divergence(key, general, lambda x, c: (x + e) * F.log((x + e) / (c + e)) - (x + e) + (c + e), lambda x: np.log(x + e), np.exp, lambda x: F.log(x + e), "non-negative")
    if key == "logistic":

        def logistic(x: Array, c: Array) -> Array:
            x, c = np.clip(x, e, 1 - e), np.clip(c, e, 1 - e)
            return (x * np.log(x) + (1 - x) * np.log(1 - x)).sum(1)[:, None] - x @ np.log(c).T - (1 - x) @ np.log(1 - c).T

        def clip(x: Column) -> Column:
            return F.greatest(F.lit(e), F.least(F.lit(1 - e), x))

        def term(x: Column, c: Column) -> Column:
            x, c = clip(x), clip(c)
            return x * F.log(x / c) + (1 - x) * F.log((1 - x) / (1 - c))

        def logit(x: Array) -> Array:
            x = np.clip(x, e, 1 - e)
            return np.log(x / (1 - x))

        return Divergence(key, logistic, term, logit, lambda t: 1 / (1 + np.exp(-t)), lambda x: F.log(clip(x) / (1 - clip(x))), "open unit interval")
    if key == "l1":
        return Divergence(key, _l1, lambda x, c: F.abs(x - c), None, None)
    if key == "spherical":
        return Divergence(key, _spherical, None, _unit, _unit)
    raise UnknownName("divergence", name, sorted(set(ALIASES.values())))


@dataclass(frozen=True)
class Traits:
    """What a planner needs to know of a divergence."""

    name: str
    #: D(x, c) = D(c, x)
    symmetric: bool
    #: Needs positive coordinates.
    positive: bool
    #: The distance matrix is a matrix product, and bounds by the triangle inequality hold for its root.
    product_form: bool
    #: Transform that moves data into the domain, by its name in ``transforms``.
    transform: str
    #: Fewer centres than this are small enough to travel with the plan.
    broadcast_below: int
    #: Unit vectors turn it into squared Euclidean distance.
    wants_unit: bool

    def assignment(self, k: int) -> str:
        """A strategy of ``operators.assign`` for ``k`` centres."""
        if self.name == "squaredEuclidean" and k >= 5:
            return "accelerated"
        return "crossJoin" if (self.product_form or self.wants_unit) and k < self.broadcast_below else "adaptive"


#: Centres that are few, by divergence; 500 for the others.
BROADCAST_BELOW = {"squaredEuclidean": 1000, "spherical": 1000, "l1": 800}


def traits(name: str) -> Traits:
    key = make(name).name
    return Traits(
        key,
        key in ("squaredEuclidean", "l1", "spherical"),
        key in ("kl", "generalizedI", "itakuraSaito", "logistic"),
        key == "squaredEuclidean",
        {"kl": "kl", "generalizedI": "kl", "itakuraSaito": "epsilon_shift", "spherical": "spherical"}.get(key, "identity"),
        BROADCAST_BELOW.get(key, 500),
        key == "spherical",
    )


#: Accepted names.
ALIASES = {
    "squaredeuclidean": "squaredEuclidean", "se": "squaredEuclidean", "euclidean": "squaredEuclidean",
    "kl": "kl", "kullbackleibler": "kl",
    "itakurasaito": "itakuraSaito", "is": "itakuraSaito",
    "generalizedi": "generalizedI", "geni": "generalizedI",
    "logistic": "logistic", "logisticloss": "logistic",
    "l1": "l1", "manhattan": "l1",
    "spherical": "spherical", "cosine": "spherical",
}


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(array_sum(F.transform(x, lambda v: v * v)))


def unit(x: Column) -> Column:
    n = norm(x)
    return F.when(n > NORM_FLOOR, F.transform(x, lambda v: v / n)).otherwise(x)


def between(div: Divergence, x: Column, c: Column) -> Column:
    """D of two array columns."""
    if div.name == "spherical":
        dot = array_sum(F.zip_with(unit(x), unit(c), lambda a, b: a * b))
        return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))
    return array_sum(F.zip_with(x, c, div.term))


def to_centre(div: Divergence, x: Column, dim: int, centre: Sequence[float]) -> Column:
    """D of an array column to a fixed centre, unrolled: stays within generated code."""
    if div.name == "spherical":
        c = _unit(np.asarray(centre, dtype=float))
        square = sum((x[i] * x[i] for i in range(1, dim)), x[0] * x[0])
        dot = sum((x[i] * float(c[i]) for i in range(1, dim)), x[0] * float(c[0]))
        length = F.sqrt(square)
        return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(length > NORM_FLOOR, dot / length).otherwise(dot)))
    out = div.term(x[0], F.lit(float(centre[0])))
    for i in range(1, dim):
        out = out + div.term(x[i], F.lit(float(centre[i])))
    return out


def violations(div: Divergence, x: Column) -> Column:
    """Whether an array column has a value outside of the divergence's domain (or none at all)."""
    bad = {
        "finite": lambda v: F.isnan(v) | (F.abs(v) == float("inf")),
        "positive": lambda v: ~(v > 0) | F.isnan(v) | (v == float("inf")),
        "non-negative": lambda v: ~(v >= 0) | F.isnan(v) | (v == float("inf")),
        "open unit interval": lambda v: ~((v > 0) & (v < 1)) | F.isnan(v),
    }[div.domain]
    return F.coalesce(F.exists(x, lambda v: F.coalesce(bad(v), F.lit(True))), F.lit(True))
