"""Must-link and cannot-link constraints: a table (i, j, w, kind), never a driver-side graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.assign import assign, distances, features_of, nearest
from halocline.operators.graph import components, cut
from halocline.operators.update import cluster_sums, new_centres
from halocline.operators.validate import require_valid
from halocline.plans.estimators import CentreModel, KMeans
from halocline.plans.lloyd import LloydResult

MUST, CANNOT = "must", "cannot"


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by shuffle: a broadcast passes through the driver, and in loops these bytes add up."""
    return df.hint("merge")


def canonical(c: DataFrame) -> DataFrame:
    """(i, j, w, kind) with i <= j; a pair named twice counts once, with its largest weight; a null weight is 1."""
    w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in c.columns else F.lit(1.0)
    rows = c.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), w.alias("w"), "kind")
    return rows.groupBy("i", "j", "kind").agg(F.max("w").alias("w")).select("i", "j", "w", "kind")


def partners(c: DataFrame) -> DataFrame:
    """(id, other, w, kind): each pair of different rows from both ends."""
    c = c.where("i <> j")
    return c.select(F.col("i").alias("id"), F.col("j").alias("other"), "w", "kind").union(c.select("j", "i", "w", "kind"))


def must_link_components(c: DataFrame) -> DataFrame:
    """(id, component) over every constrained id; must-links join, cannot-links do not."""
    own = components(c.where(F.col("kind") == MUST))
    ids = c.select(F.col("i").alias("id")).union(c.select("j")).distinct()
    return ids.join(dealt(own), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_satisfiable(c: DataFrame) -> bool:
    """False if a cannot-link lies within one must-link component."""
    k = must_link_components(c)
    pairs = c.where(F.col("kind") == CANNOT).join(dealt(k.toDF("i", "a")), "i").join(dealt(k.toDF("j", "b")), "j")
    return pairs.where("a = b").isEmpty()


def violations(assigned: DataFrame, c: DataFrame) -> DataFrame:
    """(kind, pairs, violated, penalty) of an assignment (id, cluster); the penalty is the weight of what is violated."""
    both = c.join(assigned.select(F.col("id").alias("i"), F.col("cluster").alias("a")), "i").join(assigned.select(F.col("id").alias("j"), F.col("cluster").alias("b")), "j")
    bad = F.when(F.col("kind") == MUST, F.col("a") != F.col("b")).otherwise(F.col("a") == F.col("b"))
    return both.groupBy("kind").agg(F.count("*").alias("pairs"), F.count_if(bad).alias("violated"), F.sum(F.when(bad, F.col("w")).otherwise(0.0)).alias("penalty"))


def penalties(assigned: DataFrame, pairs: DataFrame, k: int, weight: float = 1.0, alpha: float | None = None) -> DataFrame:
    """(id, penalty array of k): the weight of must-link partners elsewhere and cannot-link partners here.

    ``pairs``: (id, other, w, kind), as by ``partners``; ``assigned``: (id, cluster); a partner without a cluster is left
    out. ``alpha`` gives the exponential form e^(alpha * linear) - 1. Sums by (id, cluster) come first, so that an id with many
    partners is reduced to k numbers before they are put side by side.
    """
    w, must = F.col("w"), F.col("kind") == MUST
    at = pairs.join(dealt(assigned.select(F.col("id").alias("other"), "cluster")), "other").groupBy("id", "cluster")
    at = at.agg(F.sum(F.when(must, w).otherwise(0.0)).alias("m"), F.sum(F.when(must, -w).otherwise(w)).alias("here"))
    per = at.groupBy("id").agg(F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("cluster", "here"))).alias("here"))
    linear = lambda j: F.lit(weight) * (F.col("m") + F.coalesce(F.try_element_at("here", j), F.lit(0.0)))
    form = (lambda v: F.exp(F.lit(alpha) * v) - 1) if alpha is not None else (lambda v: v)
    return per.select("id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: form(linear(j))).alias("penalty"))


def least(d: Column) -> Column:
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def greedy_components(costs: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, cluster): in order of priority (most conflicts first), each takes its nearest cluster that no
    conflicting component of a higher priority took; the nearest of all if none is free.

    A component decides once all its rivals of higher priority have: the outcome of the sequential greedy method, in
    rounds of parallel decisions. ``costs``: (component, d array); ``edges``: (component, other), both directions.
    """
    degree = edges.groupBy("component").count()
    pri = F.struct(-F.coalesce("count", F.lit(0)), F.xxhash64("component"), "component").alias("pri")
    nodes = cut(costs.join(dealt(degree), "component", "left").select("component", "d", pri))
    rank = nodes.select("component", "pri")
    before = cut(edges.join(dealt(rank), "component").join(dealt(rank.toDF("other", "pri2")), "other").where("pri2 < pri").select("component", "other"))
    done = cut(nodes.select("component", F.lit(0).alias("cluster")).where(F.lit(False)))
    while True:
        left = nodes.join(dealt(done), "component", "left_anti")
        waiting = before.join(dealt(done.select(F.col("component").alias("other"))), "other", "left_anti").select("component").distinct()
        ready = left.join(dealt(waiting), "component", "left_anti")
        taken = before.join(dealt(done.toDF("other", "cluster")), "other").groupBy("component").agg(F.collect_set("cluster").alias("taken"))
        free = F.transform("d", lambda v, i: F.when(F.array_contains("taken", i), F.lit(float("inf"))).otherwise(v))
        now = ready.join(dealt(taken), "component", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>"))).withColumn("free", free)
        new = cut(now.select("component", F.when(F.array_min("free") < float("inf"), least(F.col("free"))).otherwise(least(F.col("d"))).alias("cluster")))
        if new.isEmpty():
            return done
        done = cut(done.union(new))


def greedy_rows(costs: DataFrame, c: DataFrame, k: int, weight: float) -> DataFrame:
    """(id, cluster): in order of priority (most partners first), each row takes the cluster of the least cost plus the
    penalties of the partners that have chosen before it. Parallel rounds, as in ``greedy_components``.
    """
    pairs = partners(c)
    nodes = cut(costs.join(dealt(pairs.groupBy("id").count()), "id", "left").select("id", "d", F.struct(-F.coalesce("count", F.lit(0)), F.xxhash64("id"), "id").alias("pri")))
    rank = nodes.select("id", "pri")
    before = cut(pairs.join(dealt(rank), "id").join(dealt(rank.toDF("other", "pri2")), "other").where("pri2 < pri").select("id", "other", "w", "kind"))
    done = cut(nodes.select("id", F.lit(0).alias("cluster")).where(F.lit(False)))
    while True:
        waiting = before.join(dealt(done.select(F.col("id").alias("other"))), "other", "left_anti").select("id").distinct()
        ready = nodes.join(dealt(done), "id", "left_anti").join(dealt(waiting), "id", "left_anti").join(dealt(penalties(done, before, k, weight)), "id", "left")
        cost = F.when(F.col("penalty").isNull(), F.col("d")).otherwise(F.zip_with("d", "penalty", lambda a, b: a + b))
        new = cut(ready.withColumn("cost", cost).select("id", least(F.col("cost")).alias("cluster")))
        if new.isEmpty():
            return done
        done = cut(done.union(new))


@dataclass
class ConstrainedKMeans(KMeans):
    """Lloyd's loop under constraints.

    soft: D plus ``constraint_weight`` times the weight of violated pairs, by ``greedy_rows``. hard: must-link components move as one; cannot-links by ``greedy_components``; an error if no assignment can
    satisfy the constraints. Rows without constraints go to their nearest centre.
    """

    id_col: str = "id"
    mode: str = "soft"
    constraint_weight: float = 1.0

    def constrained_rows(self, df: DataFrame, c: DataFrame) -> DataFrame:
        ids = c.select(F.col("i").alias("id")).union(c.select("j")).distinct()
        return df.select(F.col(self.id_col).cast("long").alias("id"), features_of(df, self.features).alias("x")).join(dealt(ids), "id", "left_semi")

    def step(self, rows: DataFrame, c: DataFrame, centres: np.ndarray) -> DataFrame:
        """(id, cluster) of the constrained rows for these centres."""
        if self.mode == "hard":
            own = rows.join(dealt(must_link_components(c)), "id").withColumn("d", distances(rows, "x", centres, self.div))
            costs = own.groupBy("component").agg(F.array(*[F.sum(F.col("d")[j]) for j in range(len(centres))]).alias("d"))
            part = own.select("id", "component")
            edges = partners(c.where(F.col("kind") == CANNOT)).join(dealt(part), "id").join(dealt(part.toDF("other", "rival")), "other")
            edges = edges.select("component", F.col("rival").alias("other")).distinct()
            return cut(part.join(dealt(greedy_components(costs, edges)), "component").select("id", "cluster"))
        return greedy_rows(rows.select("id", distances(rows, "x", centres, self.div).alias("d")), c, len(centres), self.constraint_weight)

    def fit(self, df: DataFrame, constraints: DataFrame) -> CentreModel:
        require_valid(df, self.features, self.div, self.weight)
        c = cut(canonical(constraints))
        if self.mode == "hard" and not is_satisfiable(c):
            raise ValueError("a cannot-link pair is joined by must-links")
        rows, centres = self.constrained_rows(df, c), self.start(df)
        to_dual = self.div.grad if self.centroid == "dual" and self.div.grad is not None else (lambda x: x)
        r = LloydResult(centres, 0)
        for _ in range(self.max_iter):
            state = self.step(rows, c, r.centres)

            def member(points: np.ndarray, centres: np.ndarray = r.centres) -> tuple[np.ndarray, np.ndarray]:
                x, fixed = points[:, 1:], points[:, 0].astype(int)
                own = np.where(fixed >= 0, fixed, nearest(x, centres, self.div)[0])
                part = np.eye(len(centres))[own]
                return part, part * self.div.matrix(x, centres)

            key = df.select(F.col(self.id_col).cast("long").alias("id"), features_of(df, self.features).alias("x"), (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("w"))
            tagged = key.join(dealt(state), "id", "left").select(F.concat(F.array(F.coalesce(F.col("cluster").cast("double"), F.lit(-1.0))), "x").alias("x"), "w")
            sums = cluster_sums(tagged, "x", len(r.centres), member, lambda p: to_dual(p[:, 1:]), "w")
            new = new_centres(sums, r.centres, self.div, self.centroid)
            moved = float(np.sqrt(((new - r.centres) ** 2).sum(1)).max())
            r.centres, r.iterations = new, r.iterations + 1
            r.distortion.append(float(sums.cost.sum()))
            r.movement.append(moved)
            if moved < self.tol:
                r.converged = True
                break
        return self.model(r.centres, r)

    def labels(self, model: CentreModel, df: DataFrame, constraints: DataFrame) -> DataFrame:
        """``df`` with its clusters under the constraints (``model.transform`` knows none)."""
        c = cut(canonical(constraints))
        state = self.step(self.constrained_rows(df, c), c, model.centres)
        out = assign(df, self.features, model.centres, self.div, cluster="_near").withColumn("_key", F.col(self.id_col).cast("long"))
        return out.join(dealt(state.toDF("_key", "_own")), "_key", "left").withColumn(self.prediction, F.coalesce("_own", "_near")).drop("_key", "_own", "_near")

