"""Mercer kernels as matrices and as Column expressions of two array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from halocline.functions.divergences import array_sum


def gram(x: np.ndarray, y: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    dot = x @ y.T
    if kind == "linear":
        return dot
    if kind == "polynomial":
        return (gamma * dot + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if kind == "laplacian":
        apart = np.zeros((len(x), len(y)))
        for a, b in zip(x.T, y.T, strict=True):  # one dimension at a time: memory is that of the result
            apart += np.abs(a[:, None] - b)
        return np.exp(-gamma * apart)
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * dot))
    raise ValueError(f"unknown kernel {kind!r}")


def kernel(x: Column, y: Column, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> Column:
    dot = array_sum(F.zip_with(x, y, lambda a, b: a * b))
    if kind == "linear":
        return dot
    if kind == "polynomial":
        return F.pow(gamma * dot + coef0, F.lit(float(degree)))
    if kind == "sigmoid":
        return F.tanh(gamma * dot + coef0)
    if kind == "laplacian":
        return F.exp(-gamma * array_sum(F.zip_with(x, y, lambda a, b: F.abs(a - b))))
    if kind == "rbf":
        return F.exp(-gamma * array_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))
    raise ValueError(f"unknown kernel {kind!r}")


def median_gamma(x: np.ndarray, sample: int = 1000) -> float:
    """1 / the upper median of squared distances among the first floor(sqrt(sample)) points."""
    x = x[: int(np.sqrt(sample))]
    i, j = np.triu_indices(len(x), 1)
    d = np.sort(((x[i] - x[j]) ** 2).sum(1))
    return 1.0 / d[len(d) // 2] if len(d) and d[len(d) // 2] > 0 else 1.0
