"""Elementwise and normalising feature transforms on array columns, with inverses where they exist."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from halocline.errors import UnknownName

from halocline.functions.divergences import array_sum, norm

DIVERGENCES = ("squaredEuclidean", "kl", "itakuraSaito", "generalizedI", "logistic", "l1", "spherical")


@dataclass(frozen=True)
class Transform:
    name: str
    apply: Callable[[Column], Column]
    inverse: Callable[[Column], Column] | None
    compatible: frozenset[str]

    def then(self, other: Transform) -> Transform:
        """First this, then the other; the inverse runs backwards."""
        inverse = None
        if self.inverse and other.inverse:
            inverse = lambda x: self.inverse(other.inverse(x))
        return Transform(f"{self.name}>{other.name}", lambda x: other.apply(self.apply(x)), inverse, self.compatible & other.compatible)


ALL = frozenset(DIVERGENCES)
POSITIVE = frozenset(("squaredEuclidean", "kl", "itakuraSaito", "generalizedI", "l1"))


def identity() -> Transform:
    return Transform("identity", lambda x: x, lambda x: x, ALL)


def log1p() -> Transform:
    return Transform("log1p", lambda x: F.transform(x, F.log1p), lambda x: F.transform(x, F.expm1), POSITIVE)


def epsilon_shift(epsilon: float = 1e-10) -> Transform:
    return Transform("epsilon_shift", lambda x: F.transform(x, lambda v: v + epsilon), lambda x: F.transform(x, lambda v: v - epsilon), POSITIVE | {"logistic"})


def normalize_l2(least: float = 1e-10) -> Transform:
    def apply(x: Column) -> Column:
        n = norm(x)
        return F.when(n >= least, F.transform(x, lambda v: v / n)).otherwise(x)

    return Transform("normalize_l2", apply, None, frozenset(("squaredEuclidean", "spherical", "l1")))


def normalize_l1(least: float = 1e-10) -> Transform:
    def apply(x: Column) -> Column:
        n = array_sum(F.transform(x, F.abs))
        return F.when(n >= least, F.transform(x, lambda v: v / n)).otherwise(x)

    return Transform("normalize_l1", apply, None, frozenset(("squaredEuclidean", "kl", "generalizedI", "l1")))


def standard_scale(mean: Sequence[float], stddev: Sequence[float]) -> Transform:
    if len(mean) != len(stddev) or any(s <= 0 for s in stddev):
        raise ValueError("mean and stddev need one size, and stddev must be positive")
    m, s = (F.array(*[F.lit(float(v)) for v in x]) for x in (mean, stddev))
    return Transform(
        "standard_scale",
        lambda x: F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b),
        lambda x: F.zip_with(F.zip_with(x, s, lambda a, b: a * b), m, lambda a, b: a + b),
        frozenset(("squaredEuclidean", "l1")),
    )


def make(name: str) -> Transform:
    """By name: identity, log1p, epsilon_shift, normalize_l1, normalize_l2, kl (shift, then L1), spherical (L2)."""
    key = name.strip().lower()
    simple = {"identity": identity, "none": identity, "log1p": log1p, "epsilon_shift": epsilon_shift, "normalize_l2": normalize_l2, "l2": normalize_l2, "spherical": normalize_l2, "normalize_l1": normalize_l1, "l1": normalize_l1}
    if key in simple:
        return simple[key]()
    if key == "kl":
        return epsilon_shift().then(normalize_l1())
    raise UnknownName("transform", name, [*simple, "kl"])


def derivative(x: Column) -> Column:
    """Differences of neighbours; a series of one value or none gives [0]."""
    n = F.size(x)
    return F.when(n <= 1, F.array(F.lit(0.0))).otherwise(F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a))
