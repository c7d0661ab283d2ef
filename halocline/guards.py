"""Checks of single values and vectors on the driver; each returns what it was given. Columns: ``functions.vectors``."""

from __future__ import annotations

import math
from collections.abc import Collection
from typing import Any

import numpy as np

from halocline.errors import OutOfRange

Vector = np.ndarray


def _vector(x: Any) -> Vector:
    return np.asarray(x, dtype=float)


def _every(x: Any, good: np.ndarray, what: str, wanted: str) -> Vector:
    if not good.all():
        at = int(np.flatnonzero(~good)[0])
        raise OutOfRange(f"{what}[{at}]", float(_vector(x)[at]), wanted)
    return _vector(x)


def finite(value: float, what: str = "value") -> float:
    if not math.isfinite(value):
        raise OutOfRange(what, value, "finite")
    return value


def positive(value: float, what: str = "value") -> float:
    if not value > 0:
        raise OutOfRange(what, value, "above 0")
    return value


def non_negative(value: float, what: str = "value") -> float:
    if not value >= 0:
        raise OutOfRange(what, value, "0 or more")
    return value


def probability(value: float, what: str = "probability") -> float:
    if not 0 <= value <= 1:
        raise OutOfRange(what, value, "between 0 and 1")
    return value


def weight(value: float, what: str = "weight", zero: bool = True) -> float:
    """Finite, and above 0 unless ``zero`` is allowed."""
    return (non_negative if zero else positive)(finite(value, what), what)


def present(value: Any, what: str = "value") -> Any:
    if value is None:
        raise OutOfRange(what, value, "given")
    return value


def filled(values: Collection, what: str = "collection") -> Collection:
    if not len(values):
        raise OutOfRange(what, values, "not empty")
    return values


def index(at: int, length: int, what: str = "index") -> int:
    if not 0 <= at < length:
        raise OutOfRange(what, at, f"from 0 to {length - 1}")
    return at


def finite_vector(x: Any, what: str = "vector") -> Vector:
    return _every(x, np.isfinite(_vector(x)), what, "finite")


def positive_vector(x: Any, what: str = "vector", least: float = 0.0) -> Vector:
    return _every(finite_vector(x, what), _vector(x) > least, what, f"above {least:g}")


def non_negative_vector(x: Any, what: str = "vector") -> Vector:
    return _every(x, _vector(x) >= 0, what, "0 or more")


def distribution(x: Any, what: str = "distribution", tolerance: float = 1e-6) -> Vector:
    """No negative value, and a sum of 1."""
    total = float(non_negative_vector(x, what).sum())
    if abs(total - 1) > tolerance:
        raise OutOfRange(f"the sum of {what}", total, "1")
    return _vector(x)


def same_length(a: Any, b: Any, what: str = "vectors") -> tuple[Vector, Vector]:
    if len(a) != len(b):
        raise OutOfRange(f"the lengths of {what}", (len(a), len(b)), "equal")
    return _vector(a), _vector(b)


def add(a: Any, b: Any, what: str = "sum") -> Vector:
    """The sum of two vectors of one length; an overflow is an error."""
    x, y = same_length(a, b, what)
    with np.errstate(over="ignore", invalid="ignore"):
        return finite_vector(x + y, what)


def scale(x: Any, by: float, what: str = "product") -> Vector:
    with np.errstate(over="ignore", invalid="ignore"):
        return finite_vector(_vector(x) * finite(by, what), what)
