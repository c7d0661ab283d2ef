"""Vector algebra on array columns, inside generated code. A null vector gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from halocline.functions.divergences import array_sum


def trans(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(x, f)


def merge(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(x, y, f)


def scale(a: float | Column, x: Column) -> Column:
    return F.transform(x, lambda v: v * a)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def axpy(a: float | Column, x: Column, y: Column) -> Column:
    """a x + y"""
    return F.zip_with(x, y, lambda u, v: u * a + v)


def dot(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(x, y, lambda a, b: a * b))


def total(x: Column) -> Column:
    return array_sum(x)


def largest(x: Column) -> Column:
    return F.array_max(x)


def norm1(x: Column) -> Column:
    return array_sum(F.transform(x, F.abs))


def squared_norm(x: Column) -> Column:
    return array_sum(F.transform(x, lambda v: v * v))


def norm2(x: Column) -> Column:
    return F.sqrt(squared_norm(x))


def normalised(x: Column, least: float = 1e-10) -> Column:
    """Of unit length; a vector shorter than ``least`` stays as it is."""
    n = norm2(x)
    return F.when(n < least, x).otherwise(F.transform(x, lambda v: v / n))


def safe_log(v: Column) -> Column:
    """Natural logarithm, with 0 for 0; null below."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.ln(v))


def is_finite(x: Column) -> Column:
    return ~F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def is_distribution(x: Column, tolerance: float = 1e-9) -> Column:
    """No negative value, and a sum of 1."""
    return ~F.exists(x, lambda v: ~(v >= 0)) & (F.abs(array_sum(x) - 1) <= tolerance)
