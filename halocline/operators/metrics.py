"""Quality of a clustering, from one aggregate over the points and k rows of centre statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions import mercer
from halocline.functions.divergences import Divergence, array_sum, make
from halocline.operators.assign import assign, distances, features_of
from halocline.operators.pairs import block_pairs, squares, tiles


@dataclass
class Quality:
    sizes: np.ndarray
    wcss: float
    bcss: float
    calinski_harabasz: float
    davies_bouldin: float
    dunn: float
    balance_ratio: float
    size_stddev: float


def cluster_sizes(df: DataFrame, prediction: str, k: int) -> DataFrame:
    """(cluster, n) for every cluster, empty ones too."""
    own = df.groupBy(F.col(prediction).cast("int").alias("cluster")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(own, "cluster", "left").fillna(0, ["n"])


def quality(df: DataFrame, features: str, centres: np.ndarray, div: Divergence) -> Quality:
    k = len(centres)
    rows = assign(df, features, centres, div, cluster="_c", distance="_dist").groupBy("_c").agg(F.count("*").alias("n"), F.sum("_dist").alias("s"), F.max("_dist").alias("m")).collect()
    n, s, far = np.zeros(k), np.zeros(k), 0.0
    for r in rows:
        n[r["_c"]], s[r["_c"]], far = r["n"], r["s"], max(far, r["m"])
    total, wcss = n.sum(), float(s.sum())
    middle = (n[:, None] * centres).sum(0) / max(total, 1)
    bcss = float((n * div.matrix(centres, middle[None])[:, 0]).sum())
    ch = bcss / (k - 1) / (wcss / (total - k)) if k > 1 and total > k and wcss > 0 else 0.0
    between = div.matrix(centres, centres)
    i, j = np.triu_indices(k, 1)
    mirrored = np.zeros((k, k))
    mirrored[i, j] = mirrored[j, i] = between[i, j]
    spread = s / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(mirrored > 0, (spread[:, None] + spread) / mirrored, 0.0)
    db = float(ratio.max(1).mean()) if k > 1 else 0.0
    dunn = float(between[i, j].min() / far) if k > 1 and far > 0 else 0.0
    return Quality(n.astype(int), wcss, bcss, ch, db, dunn, float(n.min() / n.max()) if total else 0.0, float(n.std()))


def simplified_silhouette(df: DataFrame, features: str, centres: np.ndarray, div: Divergence) -> DataFrame:
    """One row: the mean of (b - a) / max(a, b) with distances to the nearest two centres."""
    d = df.select(F.sort_array(distances(df, features, centres, div)).alias("d"))
    a, b = F.col("d")[0], F.col("d")[1]
    return d.agg(F.avg(F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)).alias("silhouette"))


def _by_cluster(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows in the order of their clusters, cluster codes in that order, the cluster of each code); null is a cluster too."""
    codes = table["c"].combine_chunks().dictionary_encode("encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    code = codes.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    return order, code[order], codes.dictionary


def silhouette(df: DataFrame, features: str, prediction: str, id_col: str, most: int | None = None) -> DataFrame:
    """(id, cluster, silhouette) by all distances, in blocks over the executors; an error above ``most`` rows, if given.

    The work grows with the square of the rows, the memory of a task does not.
    """
    rows = df.select(F.lit(0).alias("g"), F.col(id_col).alias("id"), F.col(prediction).alias("c"), features_of(df, features).alias("x")).where("id is not null")
    if most is not None and rows.count() > most:
        raise ValueError(f"more than {most} rows: use simplified_silhouette")

    def sums(x: np.ndarray, y: np.ndarray, same: bool, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [_by_cluster(left), _by_cluster(right)]
        (o, c, names), (p, e, others) = sides
        x, y = x[o], y[p]
        ids = np.unique(np.array(left["id"].to_pylist()), return_inverse=True)[1].ravel() if same else None
        total = [np.zeros((len(x), len(others))), np.zeros((len(y), len(names)))]
        count = [np.tile(np.bincount(e, minlength=len(others)), (len(x), 1)), np.tile(np.bincount(c, minlength=len(names)), (len(y), 1))]
        for i, j in tiles(len(x), len(y)):
            d = np.sqrt(squares(x[i], y[j]))
            at = np.flatnonzero(np.diff(e[j], prepend=-1))
            if same:  # a row does not meet itself, nor others of its id
                own = ids[o[i]][:, None] == ids[p[j]]
                if own.any():
                    d[own] = 0.0
                    count[0][i, e[j][at]] -= np.add.reduceat(own, at, axis=1, dtype=int)
            total[0][i, e[j][at]] += np.add.reduceat(d, at, axis=1)
            if not same:
                at = np.flatnonzero(np.diff(c[i], prepend=-1))
                total[1][j, c[i][at]] += np.add.reduceat(d, at, axis=0).T
        out = []
        for table, order, s, n, met in ((left, o, total[0], count[0], others), (right, p, total[1], count[1], names))[: 1 if same else 2]:
            r, k = np.nonzero(n)
            own = table.select(["id", "c"]).take(pa.array(order[r]))
            out.append(pa.table({"id": own["id"], "c": own["c"], "c2": met.take(pa.array(k)), "s": s[r, k], "n": n[r, k]}))
        return pa.concat_tables(out)

    kind = {n: rows.schema[n].dataType.simpleString() for n in ("id", "c")}
    parts = block_pairs(rows, sums, f"id {kind['id']}, c {kind['c']}, c2 {kind['c']}, s double, n long")
    means = parts.groupBy("id", "c", "c2").agg((F.sum("s") / F.sum("n")).alias("m"))
    ab = means.groupBy("id", "c").agg(F.coalesce(F.max(F.when(F.col("c") == F.col("c2"), F.col("m"))), F.lit(0.0)).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("m"))).alias("b"))
    value = F.when(F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    # Rows without a point have no distances; a single id has no value.
    found = ab.select(F.col("id").alias("_id"), F.col("c").alias("_c"), value.alias("silhouette"))
    ids = rows.select("id", "c").distinct().crossJoin(F.broadcast(rows.agg((F.min("id") < F.max("id")).alias("many")))).where("many")
    return ids.join(found, (F.col("id") == F.col("_id")) & F.col("c").eqNullSafe(F.col("_c")), "left").select("id", F.col("c").alias("cluster"), F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"))


def gram_sums(df: DataFrame, features: str, group: str, id_col: str, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> DataFrame:
    """(id, n, total): the number of rows in a row's group and the sum of its kernel values with them, itself included."""
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), features_of(df, features).alias("x")).where("g is not null")

    def value(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * squares(x, y)) if kind == "rbf" else mercer.gram(x, y, kind, gamma, degree, coef0)

    def sums(x: np.ndarray, y: np.ndarray, same: bool, left: pa.Table, right: pa.Table) -> pa.Table:
        total = [np.zeros(len(x)), np.zeros(len(y))]
        for i, j in tiles(len(x), len(y)):
            k = value(x[i], y[j])
            total[0][i] += k.sum(1)
            if not same:
                total[1][j] += k.sum(0)
        return pa.concat_tables([pa.table({"id": t["id"], "s": s}) for t, s in ((left, total[0]), (right, total[1]))[: 1 if same else 2]])

    total = block_pairs(rows, sums, f"id {rows.schema['id'].dataType.simpleString()}, s double").groupBy(F.col("id").alias("_id")).agg(F.sum("s").alias("total"))
    counts = rows.groupBy("g", "id").agg(F.count("*").alias("own")).join(rows.groupBy("g").agg(F.count("*").alias("all")), "g").groupBy("id").agg(F.sum(F.col("own") * F.col("all")).alias("n"))
    return counts.join(total, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "n", "total")


def inertia(df: DataFrame, features: str, prediction: str) -> DataFrame:
    """Sum of squared distances to the arithmetic mean of each cluster, from sums alone."""
    long = df.select(F.col(prediction).alias("c"), F.posexplode(features_of(df, features)).alias("p", "v"))
    per = long.groupBy("c", "p").agg((F.var_pop("v") * F.count("v")).alias("ss"))
    return per.agg(F.sum("ss").alias("inertia"))


def mean_centres(df: DataFrame, features: str, prediction: str) -> tuple[list[int], np.ndarray]:
    """(cluster numbers, arithmetic means): a mean for each cluster and position is all that reaches the driver."""
    long = df.select(F.col(prediction).alias("c"), F.posexplode(features_of(df, features)).alias("p", "v"))
    rows = long.groupBy("c", "p").agg(F.avg("v").alias("m")).collect()
    names = sorted({r["c"] for r in rows})
    out = np.zeros((len(names), max((r["p"] for r in rows), default=-1) + 1))
    for r in rows:
        out[names.index(r["c"]), r["p"]] = r["m"]
    return names, out


def approximate_silhouette(df: DataFrame, features: str, prediction: str) -> DataFrame:
    """One row: the silhouette with Euclidean distances to the clusters' means in place of all their points.

    All rows count, in one pass after the means. A row in the only cluster has the value 0.
    """
    names, means = mean_centres(df, features, prediction)
    if len(names) < 2:
        return df.agg(F.when(F.count("*") > 0, 0.0).alias("silhouette"))
    apart = F.transform(distances(df, features, means, make("se")), lambda d: F.sqrt(2 * F.greatest(d, F.lit(0.0))))
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(prediction)).cast("int") - 1
    rows = df.select(apart.alias("d"), at.alias("i")).select(F.get("d", F.col("i")).alias("a"), F.array_min(F.filter("d", lambda v, i: i != F.col("i"))).alias("b"))
    return rows.agg(F.avg(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).alias("silhouette"))


def effective_clusters(df: DataFrame, probabilities: str, least: float = 1e-10) -> DataFrame:
    """One row: the mean of e to the entropy of each row's memberships (1: hard, k: even)."""
    entropy = array_sum(F.transform(probabilities, lambda p: F.when(p > least, -p * F.log(p)).otherwise(0.0)))
    return df.agg(F.avg(F.exp(entropy)).alias("effective_clusters"))
