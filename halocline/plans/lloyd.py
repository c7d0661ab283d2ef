"""The fixed-point loop: one aggregate job an iteration, centres on the driver, no lineage that grows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.errors import CostRose
from halocline.functions.divergences import Divergence
from halocline.operators.assign import assign, features_of, nearest
from halocline.operators.update import cluster_sums, hard, new_centres, weighted_medians
from halocline.telemetry import emit


@dataclass
class LloydResult:
    centres: np.ndarray
    iterations: int
    distortion: list[float] = field(default_factory=list)
    movement: list[float] = field(default_factory=list)
    converged: bool = False
    empty_events: int = 0


def hashed_points(df: DataFrame, features: str, n: int, seed: int = 0) -> np.ndarray:
    """``n`` different points in an order of hashes: the same for any partitioning."""
    x = df.select(features_of(df, features).alias("x"))
    rows = x.withColumn("h", F.xxhash64("x", F.lit(seed))).dropDuplicates(["x"]).orderBy("h", "x").limit(n).collect()
    return np.array([r["x"] for r in rows], dtype=float)


def first_points(df: DataFrame, features: str, n: int, id_col: str) -> np.ndarray:
    """The points with the ``n`` smallest ids."""
    rows = df.select(id_col, features_of(df, features).alias("x")).orderBy(id_col).limit(n).collect()
    return np.array([r["x"] for r in rows], dtype=float)


def kmeans_parallel(df: DataFrame, features: str, k: int, div: Divergence, rounds: int = 2, seed: int = 0, factor: float = 2.0) -> np.ndarray:
    """k-means||: each round draws about factor * k points in proportion to D, then the draws are weighed and clustered."""
    found = hashed_points(df, features, 1, seed)
    x = df.select(features_of(df, features).alias(features))
    for turn in range(rounds):
        near = assign(x, features, found, div, distance="_d")
        cost = near.agg(F.sum(F.greatest("_d", F.lit(0.0)))).first()[0] or 0.0
        if cost <= 0:
            break
        draw = F.pmod(F.xxhash64(features, F.lit(seed), F.lit(turn)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        share = F.lit(factor * k / cost) * F.greatest("_d", F.lit(0.0))
        # The shares add up to factor * k, so that is how many rows come, about.
        new = near.where(draw < share).select(features).distinct().collect()
        if new:
            found = np.vstack([found, np.array([r[0] for r in new], dtype=float)])
    if len(found) < k:
        more = hashed_points(df, features, 2 * k, seed + 1)
        found = np.unique(np.vstack([found, more]), axis=0)
    if len(found) <= k:
        return found
    weights = cluster_sums(x, features, len(found), hard(found, div), lambda p: p).weight
    rng = np.random.default_rng(seed)
    chosen = [int(np.argmax(weights))]
    for _ in range(k - 1):
        d = np.maximum(div.matrix(found, found[chosen]).min(1), 0) * weights
        d[chosen] = 0
        chosen.append(int(rng.choice(len(found), p=d / d.sum())) if d.sum() > 0 else int(np.setdiff1d(np.arange(len(found)), chosen)[0]))
    return found[chosen]


def initial(df: DataFrame, features: str, k: int, div: Divergence, mode: str = "k-means||", seed: int = 0, steps: int = 2) -> np.ndarray:
    return hashed_points(df, features, k, seed) if mode == "random" else kmeans_parallel(df, features, k, div, steps, seed)


def refill(df: DataFrame, features: str, centres: np.ndarray, empty: np.ndarray, div: Divergence) -> np.ndarray:
    """Puts the points furthest from their centres into the empty slots."""
    far = assign(df.select(features_of(df, features).alias(features)), features, centres[~empty], div, distance="_d").orderBy(F.desc("_d"), features).limit(int(empty.sum()))
    points = [r[features] for r in far.select(features).collect()]
    out = centres.copy()
    for slot, p in zip(np.flatnonzero(empty), points, strict=False):
        out[slot] = p
    return out


def lloyd(df: DataFrame, features: str, centres: np.ndarray, div: Divergence, max_iter: int = 20, tol: float = 1e-4, weight: str | None = None, centroid: str = "dual", empty: str = "keep") -> LloydResult:
    """``empty``: keep (the slot keeps its centre), reseed (furthest points), drop (k shrinks)."""
    r = LloydResult(np.asarray(centres, dtype=float), 0)
    emit("started", divergence=div.name, k=len(r.centres))
    to_dual = div.grad if centroid == "dual" and div.grad is not None else (lambda x: x)
    for _ in range(max_iter):
        sums = cluster_sums(df, features, len(r.centres), hard(r.centres, div), to_dual, weight)
        if div.name == "l1":
            new = r.centres.copy()
            for row in weighted_medians(assign(df, features, r.centres, div), features, "cluster", weight).collect():
                new[row["cluster"], row["pos"]] = row["median"]
        else:
            new = new_centres(sums, r.centres, div, centroid)
        none = sums.weight <= 0
        if none.any():
            r.empty_events += 1
            emit("empty_clusters", iteration=r.iterations, count=int(none.sum()))
            if empty == "reseed":
                new = refill(df, features, new, none, div)
            elif empty == "drop":
                new, r.centres = new[~none], r.centres[~none]
        moved = float(np.sqrt(((new - r.centres) ** 2).sum(1)).max())
        r.centres, r.iterations = new, r.iterations + 1
        r.distortion.append(float(sums.cost.sum()))
        r.movement.append(moved)
        emit("iteration", iteration=r.iterations, cost=r.distortion[-1], moved=moved)
        if len(r.distortion) > 1 and r.distortion[-1] > r.distortion[-2] * (1 + 1e-9):
            emit("warning", message=str(CostRose(r.iterations, r.distortion[-2], r.distortion[-1])))
        if moved < tol:
            r.converged = True
            emit("converged", iteration=r.iterations, moved=moved)
            break
    emit("finished", iterations=r.iterations, converged=r.converged)
    return r


def local_lloyd(x: np.ndarray, centres: np.ndarray, div: Divergence, w: np.ndarray | None = None, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """The same loop over points in memory: (centres, labels, cost)."""
    w = np.ones(len(x)) if w is None else w
    value = div.grad(x) if div.grad else x
    for _ in range(rounds):
        c, d = nearest(x, centres, div)
        new = centres.copy()
        for j in range(len(centres)):
            own = c == j
            if w[own].sum() > 0:
                m = (w[own, None] * value[own]).sum(0) / w[own].sum()
                new[j] = div.inv_grad(m) if div.inv_grad else m
        if np.allclose(new, centres):
            break
        centres = new
    c, d = nearest(x, centres, div)
    return centres, c, float((w * d).sum())
