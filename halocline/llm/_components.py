"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step sends a vertex's neighbours to the smallest vertex it knows. Vertices with very many edges are treated as
heavy keys (see ``attach_groups``), every round is written to the shared folder, and nothing but two numbers a round
reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import Table, attach_groups

#: An edge table this small is solved by one task in one pass.
ONE_TASK_EDGES = 16_000


def label_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For vertices 0..n-1 and edges (a, b): the smallest vertex of each component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def star_edges(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions of ``nodes`` (int64 ids) -> star edges (node, smallest node of its component)."""
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    label = label_min(len(nodes), rank[a], rank[b])
    moved = label != np.arange(len(nodes))
    sorted_nodes = nodes[order]
    return sorted_nodes[moved], sorted_nodes[label[moved]]


def _solve(batches):
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if got:
        u, v = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = label_min(len(nodes), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _mark(df: DataFrame) -> tuple:
    got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return got["n"], got["h"]


def _least(edges: DataFrame) -> Table:
    return Table(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-min")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (two long columns) -> (node, component = smallest node reachable), one row for each node in an edge.

    Self-edges and repeated edges are allowed; nulls are not. An empty table gives an empty result.
    """
    u, v = edges.columns
    first = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = Table(first, "cc")
    n, mark = _mark(now.df)
    if n <= ONE_TASK_EDGES:
        return now.df.coalesce(1).mapInArrow(_solve, "node long, component long")
    while True:
        both = Table(now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        least = _least(both.df)
        to_least = attach_groups(both.df, least.df, ["u"], "n", 2 * n).select("u", "v", F.least("u", "m").alias("m"))
        large = Table(to_least.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        n_large, _ = _mark(large.df)
        for t in (both, least, now):
            t.drop()
        least = _least(large.df)
        moved = attach_groups(large.df, least.df, ["u"], "n", n_large).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = Table(moved.unionByName(least.df.select("u", F.col("m").alias("v"))).distinct(), "cc")
        last, (n, mark) = mark, _mark(now.df)
        large.drop()
        least.drop()
        if mark == last:
            break
    # Every edge is now (node, smallest of its component).
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component")))
