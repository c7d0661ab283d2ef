"""Near-duplicate vectors by product quantisation with an exact cosine check.

* Coarse lists: centroids of a bounded sample of unit vectors; a vector belongs to its nearest centroid's list.
* Residual codes: a vector's offset from its centroid is cut into SUBSPACES parts, each replaced by the nearest of CODES
  sample residuals; what is lost (the code's error) is kept with the code.
* Search: vectors at cosine c or more are no further apart than r = sqrt(2 - 2c). A neighbour of x can only be in lists
  whose side of the bisector with x's own list comes within r of x, so exactly these lists are probed. There, distances
  from x to all codes come from lookup tables; a vector is dropped only if that distance, less its code's error, exceeds
  r. The rest are compared exactly, in double precision. Nothing within the threshold is lost: probes are sufficient by
  the triangle inequality, not by measurement.

Vectors are only compared under equal labels (and equal dimension). The index is fitted on at most about SAMPLE vectors
and holds every vector.

Scale: equal vectors are folded into one with its count. A vector goes to its own list and to those probed lists that
come after it (two lists' vectors meet in the later one's task, which counts their links for both), as wide as it was
given: 4 bytes a component of float vectors. Lists are keyed by (label, list); a list with more than its share of vectors
is cut into chunks of MOST_ROWS at most that different tasks search. A task sends each vector's count of links and a star
for each connected set, never pairs; ``connected_components`` joins the stars. The number of lists stops at MOST_LISTS
(the fit sees SAMPLE vectors); beyond, lists grow longer and are cut, and no pair is missed. Spread evenly over 64
dimensions, vectors probe most lists, and the search tends to all pairs of a label; data in clusters prune.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label,
link with nothing; of equal vectors each counts the others; ids must be whole numbers (others are an error); rows with a
null id count as neighbours of equal vectors only, and have a null component and null kept; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import SMALL_IDS, Table, attach_groups
from halocline.llm._components import connected_components, star_edges

THRESHOLD = 0.98
SAMPLE = 8192
#: Lists are the square root of the vectors over FEWER, MOST_LISTS at most.
FEWER, MOST_LISTS = 16, 1024
SUBSPACES, CODES = 8, 64
#: Vectors of one list that are searched together, at least and at most; between them, longer lists number LONG_LISTS.
LIST_ROWS, MOST_ROWS, LONG_LISTS = 4096, 1 << 16, 20_000
QUERIES = 512
SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Fitted for one dimension: coarse centroids and, for each subspace, the codebook of residuals."""

    centroids: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    @staticmethod
    def fit(unit: np.ndarray, lists: int) -> Index:
        rng = np.random.default_rng(5)
        centroids = _kmeans(unit, lists, 8, rng)
        residual = unit - centroids[Index.distances(unit, centroids).argmin(1)]
        cuts = [round(i * unit.shape[1] / SUBSPACES) for i in range(SUBSPACES + 1)]
        return Index(centroids, cuts, [_kmeans(residual[:, a:b], CODES, 6, rng) for a, b in zip(cuts, cuts[1:], strict=False)])

    @staticmethod
    def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T)

    def probes(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(own list, mask of lists to probe) of each vector."""
        d = self.distances(unit, self.centroids)
        own = d.argmin(1)
        apart = np.sqrt(self.distances(self.centroids, self.centroids))[own]
        return own, d - d[np.arange(len(d)), own][:, None] <= 2 * (radius + SLACK) * apart + SLACK

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error: distance from the residual to its code)."""
        codes, lost = np.empty((len(residual), SUBSPACES), dtype=np.int64), np.zeros(len(residual))
        for m, book in enumerate(self.books):
            if not book.shape[1]:
                codes[:, m] = 0
                continue
            d = self.distances(residual[:, self.cuts[m] : self.cuts[m + 1]], book)
            codes[:, m] = d.argmin(1)
            lost += d.min(1)
        return codes, np.sqrt(lost)

    def lookup(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances (queries, codes) by table lookup."""
        out = np.zeros((len(residual), len(codes)))
        for m, book in enumerate(self.books):
            if book.shape[1]:
                out += self.distances(residual[:, self.cuts[m] : self.cuts[m + 1]], book)[:, codes[:, m]]
        return out


def _unit(raw: list[bytes], width: int = 8) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=f"<f{width}").reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _place(indexes: dict[int, Index], radius: float, width: int, batches):
    """(label, dim, rep, n, vector) -> a row in its own list (role 0) and one in each later list to probe (role 1)."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        vectors = batch.column(4)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(f"<f{width}").tobytes()
            step = int(dim) * width
            data = [flat[i : i + step] for i in range(0, len(flat), step)]
            own, probe = indexes[int(dim)].probes(_unit(data, width), radius)
            probe &= np.arange(probe.shape[1]) >= own[:, None]
            which, lists = np.nonzero(probe)
            # A vector looks for partners in its own list as well.
            which, lists = np.r_[np.arange(len(rows)), which], np.r_[own, lists]
            role = np.r_[np.zeros(len(rows), dtype=np.int32), np.ones(len(which) - len(rows), dtype=np.int32)]
            for at in range(0, len(which), 4096):
                w = which[at : at + 4096]
                taken = batch.take(pa.array(rows[w]))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), pa.array(lists[at : at + 4096].astype(np.int32)), pa.array(role[at : at + 4096]), pa.array(own[w].astype(np.int32)), taken.column(2), taken.column(3), pa.array([data[i] for i in w], pa.binary())],
                    names=["label", "dim", "list", "role", "home", "rep", "n", "vector"],
                )


def _search(indexes: dict[int, Index], threshold: float, width: int, batches):
    """Rows sorted by (label, dim, list, chunk, role) -> (u, v, links): counts have a null v, star edges no links."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    now, base = None, None
    held: list = []

    def columns(table):
        return table.column("rep").to_numpy(), table.column("n").to_numpy(), _unit(table.column("vector").to_pylist(), width)

    for batch in batches:
        keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "dim", "list", "chunk", "role")], strict=True))
        at = 0
        while at < len(keys):
            stop = at
            while stop < len(keys) and keys[stop] == keys[at] and stop - at < QUERIES:
                stop += 1
            key, part = keys[at], batch.slice(at, stop - at)
            at = stop
            if key[:4] != now:
                now, base, held = key[:4], None, []
            index = indexes[key[1]]
            centre = index.centroids[key[2]]
            if key[4] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if base is None:
                reps, counts, unit = columns(pa.Table.from_batches(held))
                base = reps, counts, unit, *index.encode(unit - centre)
            reps, counts, unit, codes, error = base
            own, own_counts, query = columns(part)
            i, j = np.nonzero(index.lookup(query - centre, codes) <= (radius + error) ** 2 + SLACK)
            # One formula for every pair, whichever of the two asks: products are added in the order of components.
            cosine = np.concatenate([(query[i[k : k + 65536]] * unit[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            keep = (cosine >= threshold) & (own[i] != reps[j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            nodes, place = np.unique(np.r_[own[i], reps[j]], return_inverse=True)
            # Vectors of one list find each other both ways; of two lists, only the earlier one's ask.
            foreign = (part.column("home").to_numpy() != key[2])[i]
            links = np.bincount(place[: len(i)], weights=counts[j], minlength=len(nodes))
            links += np.bincount(place[len(i) :], weights=own_counts[i] * foreign, minlength=len(nodes))
            u, v = star_edges(nodes, place[: len(i)], place[len(i) :])
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[nodes[found], u]), pa.array(np.r_[np.zeros(len(found), dtype=np.int64), v], mask=np.r_[np.ones(len(found), dtype=bool), np.zeros(len(u), dtype=bool)]), pa.array(np.r_[links[found].astype(np.int64), np.zeros(len(u), dtype=np.int64)])],
                names=["u", "v", "links"],
            )


def _usable(vector: str, label: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    width = 4 if rows.schema[vector_col].dataType.simpleString() == "array<float>" else 8
    kept_as = "array<float>" if width == 4 else "array<double>"
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kept_as).alias("vector"))
    usable = given.where(_usable("vector", "label"))
    # Adding zero turns -0.0 into 0.0, so that equal vectors are equal keys.
    keyed = Table(usable.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast("float" if width == 4 else "double"))), "vectors")
    # A group of rows without any id has no name to link by.
    folded = Table(keyed.df.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null"), "vectors-folded")
    total, different = folded.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    share = min(1.0, SAMPLE / max(different, 1))
    sample = folded.df.where(F.pmod(F.xxhash64("rep", F.lit("vector sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    by_dim: dict[int, list] = {}
    for r in sample.select("vector").collect():
        by_dim.setdefault(len(r[0]), []).append(r[0])
    for r in folded.df.groupBy(F.size("vector").alias("dim")).agg(F.first("vector").alias("v")).collect():
        by_dim.setdefault(r["dim"], [r["v"]])
    lists = max(1, min(MOST_LISTS, math.ceil(math.sqrt(different) / FEWER)))
    indexes = {k: Index.fit(_unit([np.asarray(x, dtype="<f8").tobytes() for x in v]), lists) for k, v in by_dim.items()}
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    kind = given.schema["label"].dataType.simpleString()
    placed = folded.df.select("label", F.size("vector").alias("dim"), "rep", "n", "vector").mapInArrow(
        functools.partial(_place, indexes, radius, width), f"label {kind}, dim int, list int, role int, home int, rep long, n long, vector binary"
    )
    most = min(MOST_ROWS, max(LIST_ROWS, different // LONG_LISTS))
    long = Table(placed.where("role = 0").groupBy("label", "dim", "list").agg(F.count("*").alias("rows")).where(F.col("rows") > most), "vectors-long")
    group = ["label", "dim", "list", "chunk"]
    chunked = (
        placed.join(F.broadcast(long.df) if long.df.count() <= SMALL_IDS else long.df, ["label", "dim", "list"], "left")
        .withColumn("chunks", F.ceil(F.coalesce("rows", F.lit(1)) / most).cast("int"))
        .withColumn("chunk", F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        .select(*group, "role", "home", "rep", "n", "vector")
    )
    found = Table(chunked.repartition(*group).sortWithinPartitions(*group, "role").mapInArrow(functools.partial(_search, indexes, threshold, width), "u long, v long, links long"), "vectors-found")
    counts = found.df.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    components = connected_components(found.df.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    labelled = Table(
        folded.df.join(counts, "rep", "left").join(components, "rep", "left").select("label", "vector", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")),
        "vectors-labels",
    )
    linked = attach_groups(keyed.df, labelled.df, ["label", "vector"], "n", total).select("id", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    others = given.where(~_usable("vector", "label")).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(others).select(
        F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
