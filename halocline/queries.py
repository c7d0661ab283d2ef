"""A query for each operator over the star-schema tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.functions import divergences, infotheory, transforms, vectors
from halocline.functions.divergences import array_sum
from halocline.operators import metrics, outliers, validate
from halocline.operators.assign import assign, distances
from halocline.operators.update import cluster_sums, hard, soft, weighted_medians
from halocline.plans import bounded, constrained, elkan, estimators, presets, sampled, sparse, tabular
from halocline.plans.lloyd import first_points, lloyd
from halocline.sources import persistence
from halocline.streaming.kmeans import StreamingKMeans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings shifted into (0, 1), the domain of every divergence."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: 0.5 + 0.45 * v)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("features"))


POINTS = "p AS (SELECT vec_id, label, list_transform(embedding, lambda v: 0.5 + 0.45 * v::double) AS x FROM embeddings)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scaled, positive measures of each line item."""
    c = lambda name, f: F.col(name).cast("double") * f + 0.01
    x = F.array(c("l_quantity", 0.019), c("l_extendedprice", 8e-6), c("l_discount", 5.0), c("l_tax", 5.0))
    return table(spark, sf_dir, "lineitem").select(x.alias("features"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("double").alias("w"))


LINES = "p AS (SELECT [l_quantity::double * 0.019::double + 0.01::double, l_extendedprice::double * 8e-6::double + 0.01::double, l_discount::double * 5.0::double + 0.01::double, l_tax::double * 5.0::double + 0.01::double] AS x, l_returnflag, l_linestatus, l_linenumber::double AS w FROM lineitem)"
#: Fixed centres in the space of ``lines``.
LINE_CENTRES = np.array([[0.2, 0.2, 0.1, 0.1], [0.5, 0.4, 0.3, 0.2], [0.9, 0.6, 0.5, 0.4], [0.4, 0.8, 0.2, 0.3], [0.7, 0.3, 0.4, 0.1]])
LINE_VALUES = ", ".join(f"({i}, [{', '.join(f'{v}::double' for v in c)}])" for i, c in enumerate(LINE_CENTRES))

E = "1e-10::double"
CLIP = f"greatest({E}, least(1::double - {E}, %s))"
_x, _c = CLIP % "z[1]", CLIP % "z[2]"
TERMS = {
    "se": "0.5::double * (z[1] - z[2]) * (z[1] - z[2])",
    "kl": f"(z[1] + {E}) * ln((z[1] + {E}) / (z[2] + {E}))",
    "is": f"(z[1] + {E}) / (z[2] + {E}) - ln((z[1] + {E}) / (z[2] + {E})) - 1",
    "geni": f"(z[1] + {E}) * ln((z[1] + {E}) / (z[2] + {E})) - (z[1] + {E}) + (z[2] + {E})",
    "logistic": f"{_x} * ln({_x} / {_c}) + (1 - {_x}) * ln((1 - {_x}) / (1 - {_c}))",
    "l1": "abs(z[1] - z[2])",
}
GRADS = {"se": ("v", "m"), "kl": (f"ln(v + {E}) + 1", "exp(m - 1)"), "is": (f"-1 / (v + {E})", "-1 / m"), "geni": (f"ln(v + {E})", "exp(m)"), "logistic": (f"ln({CLIP % 'v'} / (1 - {CLIP % 'v'}))", "1 / (1 + exp(-m))")}


def d_sql(kind: str, x: str = "x", c: str = "c") -> str:
    if kind == "views":  # the first half by squared Euclidean distance, the second by KL at half the weight
        return f"({d_sql('se', f'{x}[1:32]', f'{c}[1:32]')} * (1 / 1.5::double) + {d_sql('kl', f'{x}[33:64]', f'{c}[33:64]')} * (0.5::double / 1.5::double))"
    if kind == "spherical":
        return f"1 - greatest(-1, least(1, list_cosine_similarity({x}, {c})))"
    return f"list_sum(list_transform(list_zip({x}, {c}), lambda z: {TERMS[kind]}))"


def near_sql(kind: str, points: str = "p", centres: str = "c0", key: str = "vec_id") -> str:
    return f"SELECT {key}, any_value(x) AS x, (arg_min(cid, (d, cid)))::int AS cluster, min(d) AS d FROM (SELECT {key}, x, cid, {d_sql(kind)} AS d FROM {points}, {centres}) GROUP BY {key}"


def first_sql(k: int) -> str:
    return f"c0 AS (SELECT vec_id::int AS cid, x AS c FROM p WHERE vec_id < {k})"


def lloyd_sql(kind: str, k: int, rounds: int) -> str:
    g, inv = GRADS[kind]
    out = [POINTS, first_sql(k)]
    for i in range(rounds):
        out.append(f"a{i} AS ({near_sql(kind, centres=f'c{i}')})")
        out.append(f"m{i} AS (SELECT cid, pos, avg({g}) AS m FROM (SELECT cluster AS cid, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY cid, pos)")
        out.append(f"n{i} AS (SELECT cid, list({inv} ORDER BY pos) AS c FROM m{i} GROUP BY cid)")
        out.append(f"c{i + 1} AS (SELECT o.cid, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (cid))")
    out.append(f"z AS ({near_sql(kind, centres=f'c{rounds}')})")
    return f"WITH {', '.join(out)} SELECT cid AS cluster, count(z.vec_id) AS n, round(coalesce(sum(d), 0), 5) AS cost, round(list_sum(any_value(c)), 5) AS centre_sum FROM c{rounds} LEFT JOIN z ON z.cluster = cid GROUP BY cid"


def _assign(kind: str) -> None:
    @query(f"assign_{kind}", f"WITH {POINTS}, {first_sql(5)}, a AS ({near_sql(kind)}) SELECT vec_id, cluster, round(d, 6) AS distance FROM a")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir)
        out = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make(kind), distance="distance")
        return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))

    keyed = LINES.replace("SELECT [", "SELECT row_number() OVER () AS id, [")
    @query(f"line_assign_{kind}", f"WITH {keyed}, c0(cid, c) AS (VALUES {LINE_VALUES}), a AS ({near_sql(kind, key='id')}) SELECT cluster, count(*) AS n, round(sum(d), 4) AS cost FROM a GROUP BY cluster")
    def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = assign(lines(spark, sf_dir), "features", LINE_CENTRES, divergences.make(kind), distance="d")
        return out.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("cost"))


def _lloyd(kind: str) -> None:
    @query(f"lloyd3_{kind}", lloyd_sql(kind, 4, 3))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, div = points(spark, sf_dir), divergences.make(kind)
        r = lloyd(p, "features", first_points(p, "features", 4, "vec_id"), div, max_iter=3, tol=0.0)
        centres = spark.createDataFrame([(i, float(c.sum())) for i, c in enumerate(r.centres)], "cluster int, s double")
        own = assign(p, "features", r.centres, div, distance="d").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d").alias("cost"))
        return centres.join(own, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("cost", F.lit(0.0)), 5).alias("cost"), F.round("s", 5).alias("centre_sum"))


for _kind in ("se", "kl", "is", "geni", "logistic", "l1", "spherical"):
    _assign(_kind)
for _kind in ("se", "kl", "is", "geni", "logistic"):
    _lloyd(_kind)


@query("assign_cross_join", SQL["assign_se"])
def assign_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"), strategy="crossJoin", distance="distance")
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("dual_and_mean_centroids", f"WITH {POINTS}, l AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM p), m AS (SELECT label, pos, avg(v) AS a, exp(avg(ln(v + {E}) + 1) - 1) AS g FROM l GROUP BY label, pos) SELECT label, round(sum(a), 6) AS mean_sum, round(sum(g), 6) AS dual_sum FROM m GROUP BY label")
def dual_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = points(spark, sf_dir).select("label", F.posexplode("features").alias("pos", "v"))
    div = divergences.make("kl")
    m = long.groupBy("label", "pos").agg(F.avg("v").alias("a"), F.exp(F.avg(div.grad_column(F.col("v"))) - 1).alias("g"))
    return m.groupBy("label").agg(F.round(F.sum("a"), 6).alias("mean_sum"), F.round(F.sum("g"), 6).alias("dual_sum"))


@query("weighted_medians", f"""WITH {LINES}, l AS (SELECT l_returnflag AS cluster, (generate_subscripts(x, 1) - 1)::int AS pos, unnest(x) AS v, w FROM p),
g AS (SELECT cluster, pos, v, sum(w) AS w FROM l GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY cluster, pos ORDER BY v) AS upto, sum(w) OVER (PARTITION BY cluster, pos) AS total, lead(v) OVER (PARTITION BY cluster, pos ORDER BY v) AS nxt FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY cluster, pos ORDER BY v) AS i FROM r WHERE upto >= total / 2 - 1e-10)
SELECT cluster, pos, round(CASE WHEN abs(upto - total / 2) <= 1e-10 AND nxt IS NOT NULL THEN (v + nxt) / 2 ELSE v END, 6) AS median FROM f WHERE i = 1""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_medians(lines(spark, sf_dir), "features", "l_returnflag", "w").select("cluster", "pos", F.round("median", 6).alias("median"))


SOFT = f"{POINTS}, {first_sql(4)}, d AS (SELECT vec_id, any_value(x) AS x, list({d_sql('se')} ORDER BY cid) AS d FROM p, c0 GROUP BY vec_id), e AS (SELECT vec_id, x, d, list_transform(d, lambda v: exp(-2 * (v - list_min(d)))) AS q FROM d), s AS (SELECT vec_id, x, d, list_transform(q, lambda v: v / list_sum(q)) AS q FROM e)"


@query("soft_memberships", f"WITH {SOFT} SELECT vec_id, (list_position(q, list_max(q)) - 1)::int AS prediction, round(list_max(q), 6) AS top FROM s")
def soft_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = estimators.SoftModel(first_points(p, "features", 4, "vec_id"), beta=2.0)
    return m.transform(p).select("vec_id", "prediction", F.round(F.array_max("probabilities"), 6).alias("top"))


@query("soft_step", f"WITH {SOFT}, u AS (SELECT unnest(q) AS w, generate_subscripts(q, 1) AS cid, x FROM s) SELECT (cid - 1)::int AS cluster, round(sum(w), 5) AS weight, round(sum(w * list_sum(x)) / sum(w), 5) AS centre_sum FROM u GROUP BY cid")
def soft_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    s = cluster_sums(p, "features", 4, soft(first_points(p, "features", 4, "vec_id"), divergences.make("se"), 2.0), lambda x: x)
    rows = [(i, float(w), float(m.sum())) for i, (w, m) in enumerate(zip(s.weight, s.mean(), strict=True))]
    return spark.createDataFrame(rows, "cluster int, weight double, centre_sum double").select("cluster", F.round("weight", 5).alias("weight"), F.round("centre_sum", 5).alias("centre_sum"))


@query("mixture_likelihood", f"WITH {SOFT} SELECT round(sum(list_max(list_transform(d, lambda v: ln(0.25::double) - v)) + ln(list_sum(list_transform(d, lambda v: exp((ln(0.25::double) - v) - (ln(0.25::double) - list_min(d))))))), 4) AS log_likelihood FROM s")
def mixture_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = estimators.MixtureModel(first_points(p, "features", 4, "vec_id"), weights=np.full(4, 0.25))
    return spark.createDataFrame([(m.log_likelihood(p),)], "v double").select(F.round("v", 4).alias("log_likelihood"))


NEAR = f"{POINTS}, {first_sql(5)}, a AS ({near_sql('se')})"


@query("quality", f"""WITH {NEAR}, k AS (SELECT cid, c, count(a.vec_id) AS n, coalesce(sum(d), 0) AS s FROM c0 LEFT JOIN a ON cluster = cid GROUP BY cid, c),
t AS (SELECT sum(n) AS n, sum(s) AS wcss, min(n) / max(n) AS balance, stddev_pop(n) AS sd FROM k),
m AS (SELECT list(v ORDER BY pos) AS m FROM (SELECT pos, sum(n * v) / sum(n) AS v FROM (SELECT n, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM k) GROUP BY pos)),
b AS (SELECT sum(n * {d_sql('se', 'c', 'm')}) AS bcss FROM k, m),
e AS (SELECT i.cid AS i, (i.s / greatest(i.n, 1) + j.s / greatest(j.n, 1)) / {d_sql('se', 'i.c', 'j.c')} AS r, {d_sql('se', 'i.c', 'j.c')} AS dd FROM k i, k j WHERE i.cid <> j.cid),
db AS (SELECT avg(r) AS db FROM (SELECT i, max(r) AS r FROM e GROUP BY i)), du AS (SELECT min(dd) / (SELECT max(d) FROM a) AS du FROM e)
SELECT round(wcss, 5) AS wcss, round(bcss, 5) AS bcss, round(bcss / 4 / (wcss / (n - 5)), 5) AS calinski_harabasz, round(db, 6) AS davies_bouldin, round(du, 6) AS dunn, round(balance, 6) AS balance_ratio, round(sd, 6) AS size_stddev FROM t, b, db, du""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    q = metrics.quality(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"))
    names = {"wcss": 5, "bcss": 5, "calinski_harabasz": 5, "davies_bouldin": 6, "dunn": 6, "balance_ratio": 6, "size_stddev": 6}
    row = spark.createDataFrame([tuple(float(getattr(q, n)) for n in names)], ", ".join(f"{n} double" for n in names))
    return row.select([F.round(n, r).alias(n) for n, r in names.items()])


@query("cluster_sizes", f"WITH {NEAR} SELECT cid AS cluster, count(vec_id) AS n FROM c0 LEFT JOIN a ON cluster = cid GROUP BY cid")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return metrics.cluster_sizes(assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se")), "cluster", 5)


@query("silhouette_simplified", f"WITH {POINTS}, {first_sql(5)}, d AS (SELECT vec_id, list_sort(list({d_sql('se')})) AS d FROM p, c0 GROUP BY vec_id) SELECT round(avg((d[2] - d[1]) / greatest(d[1], d[2])), 6) AS silhouette FROM d")
def silhouette_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return metrics.simplified_silhouette(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se")).select(F.round("silhouette", 6).alias("silhouette"))


@query("silhouette_exact", f"""WITH {POINTS}, m AS (SELECT a.vec_id, a.label AS l, b.label AS l2, avg(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS m FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, l, coalesce(max(m) FILTER (l = l2), 0) AS a, min(m) FILTER (l <> l2) AS b FROM m GROUP BY ALL)
SELECT vec_id AS id, l AS cluster, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s""")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.silhouette(points(spark, sf_dir), "features", "label", "vec_id").select("id", "cluster", F.round("silhouette", 6).alias("silhouette"))


@query("inertia", f"WITH {POINTS}, l AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM p) SELECT round(sum(s), 5) AS inertia FROM (SELECT var_pop(v) * count(*) AS s FROM l GROUP BY label, pos)")
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.inertia(points(spark, sf_dir), "features", "label").select(F.round("inertia", 5).alias("inertia"))


JOINT = "j AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) / (SELECT count(*) FROM lineitem)::double AS p FROM lineitem GROUP BY ALL), px AS (SELECT x, sum(p) AS p FROM j GROUP BY x), py AS (SELECT y, sum(p) AS p FROM j GROUP BY y)"


@query("joint_distribution", f"WITH {JOINT} SELECT x, y, round(p, 9) AS p FROM j")
def joint_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infotheory.joint(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select("x", "y", F.round("p", 9).alias("p"))


@query("mutual_information", f"WITH {JOINT}, h AS (SELECT (SELECT -sum(p * ln(p)) FROM px) AS hx, (SELECT -sum(p * ln(p)) FROM py) AS hy, (SELECT -sum(p * ln(p)) FROM j) AS hxy) SELECT round(hx, 8) AS h_x, round(hy, 8) AS h_y, round(hxy, 8) AS h_xy, round(hx + hy - hxy, 8) AS mutual_information, round(hxy - hx, 8) AS h_y_given_x FROM h")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infotheory.mutual_information(infotheory.joint(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))
    return out.select([F.round(c, 8).alias(c) for c in out.columns])


@query("entropy_bits", f"WITH {JOINT} SELECT round(-sum(p * log2(p)), 8) AS entropy FROM px")
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = infotheory.joint(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").groupBy("x").agg(F.sum("p").alias("p"))
    return infotheory.entropy(p, bits=True).select(F.round("entropy", 8).alias("entropy"))


SHARES = "a AS (SELECT l_returnflag AS k, count(*) / sum(count(*)) OVER ()::double AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_returnflag AS k, count(*) / sum(count(*)) OVER ()::double AS p FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)"


def _shares(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").where(side).groupBy(F.col("l_returnflag").alias("k")).count()
    total = n.agg(F.sum("count")).first()[0]
    return n.select("k", (F.col("count") / F.lit(total)).alias("p"))


@query("kl_of_shares", f"WITH {SHARES} SELECT round(sum(a.p * ln(a.p / b.p)), 9) AS kl FROM a JOIN b USING (k)")
def kl_of_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infotheory.kl_divergence(_shares(spark, sf_dir, "l_linenumber <= 3"), _shares(spark, sf_dir, "l_linenumber > 3"), "k").select(F.round("kl", 9).alias("kl"))


@query("js_of_shares", f"WITH {SHARES} SELECT round(sum(0.5 * a.p * ln(a.p / ((a.p + b.p) / 2)) + 0.5 * b.p * ln(b.p / ((a.p + b.p) / 2))), 9) AS js FROM a JOIN b USING (k)")
def js_of_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infotheory.js_divergence(_shares(spark, sf_dir, "l_linenumber <= 3"), _shares(spark, sf_dir, "l_linenumber > 3"), "k").select(F.round("js", 9).alias("js"))


TRANSFORMS = {
    "log1p": "list_transform(x, lambda v: ln(1 + v))",
    "epsilon_shift": f"list_transform(x, lambda v: v + {E})",
    "normalize_l2": "list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u))))",
    "normalize_l1": "list_transform(x, lambda v: v / list_sum(x))",
    "kl": f"list_transform(x, lambda v: (v + {E}) / list_sum(list_transform(x, lambda u: u + {E})))",
    "derivative": "list_transform(list_zip(x[2:], x[:-2]), lambda z: z[1] - z[2])",
}


def _transform(name: str, sql: str) -> None:
    @query(f"transform_{name}", f"WITH {POINTS}, t AS (SELECT vec_id, {sql} AS t FROM p) SELECT vec_id, round(t[1], 8) AS first, round(list_sum(t), 6) AS total FROM t")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply = transforms.derivative if name == "derivative" else transforms.make(name).apply
        t = points(spark, sf_dir).select("vec_id", apply(F.col("features")).alias("t"))
        return t.select("vec_id", F.round(F.col("t")[0], 8).alias("first"), F.round(array_sum(F.col("t")), 6).alias("total"))


for _name, _sql in TRANSFORMS.items():
    _transform(_name, _sql)


@query("standard_scale", f"WITH {LINES}, l AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM p), m AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY pos) SELECT (pos - 1)::int AS pos, round(sum(abs((v - m) / s)), 3) AS spread FROM l JOIN m USING (pos) GROUP BY pos")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lines(spark, sf_dir)
    stats = p.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).orderBy("pos").collect()
    scale = transforms.standard_scale([r["m"] for r in stats], [r["s"] for r in stats])
    return p.select(F.posexplode(scale.apply(F.col("features"))).alias("pos", "v")).groupBy("pos").agg(F.round(F.sum(F.abs("v")), 3).alias("spread"))


@query("input_check", f"WITH {POINTS} SELECT count(*) AS rows, count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (len(list_filter(x, lambda v: isnan(v))) > 0) AS with_nan, count(*) FILTER (len(list_filter(x, lambda v: isinf(v))) > 0) AS with_infinite, count(*) FILTER (len(list_filter(x, lambda v: v <= 0)) > 0) AS not_positive, count(DISTINCT len(x)) AS dimensions, count(*) FILTER (len(list_filter(x, lambda v: NOT (v > 0 AND v < 1))) > 0) AS outside_domain, 0::bigint AS bad_weights FROM p")
def input_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check(points(spark, sf_dir), "features", divergences.make("logistic"))


@query("outlier_scores", f"WITH {NEAR}, q AS (SELECT quantile_cont(d, 0.5) AS m FROM a) SELECT vec_id, round(d / m, 6) AS outlier_score, d / m > 1.3 AS is_outlier FROM a, q")
def outlier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"), distance="d")
    return outliers.outlier_scores(near, "d", 1.3).select("vec_id", F.round("outlier_score", 6).alias("outlier_score"), "is_outlier")


@query("trimmed_sizes", f"WITH {NEAR}, q AS (SELECT quantile_cont(d, 0.9) AS m FROM a) SELECT cluster, count(*) FILTER (d <= m) AS kept, count(*) FILTER (d > m) AS trimmed FROM a, q GROUP BY cluster")
def trimmed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"), distance="d")
    return outliers.trimmed(near, "d", 0.1).groupBy("cluster").agg(F.count_if(~F.col("is_outlier")).alias("kept"), F.count_if("is_outlier").alias("trimmed"))


def _multiview(how: str, sql: str) -> None:
    views = [estimators.View("left", 0.7, "se"), estimators.View("right", 0.3, "kl")]
    d = f"{sql.format(a='0.7::double * ' + d_sql('se', 'x[:32]', 'c[:32]'), b='0.3::double * ' + d_sql('kl', 'x[33:]', 'c[33:]'))}"

    @query(f"multiview_{how}", f"WITH {POINTS}, {first_sql(4)}, d AS (SELECT vec_id, cid, {d} AS d FROM p, c0) SELECT vec_id, arg_min(cid, (d, cid))::int AS prediction, round(min(d), 6) AS distance FROM d GROUP BY vec_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir).withColumns({"left": F.slice("features", 1, 32), "right": F.slice("features", 33, 32)})
        c = first_points(p, "features", 4, "vec_id")
        out = p.withColumn("d", estimators.multiview_distances(p, views, [c[:, :32], c[:, 32:]], how)).withColumn("m", F.array_min("d"))
        return out.select("vec_id", (F.array_position("d", F.col("m")) - 1).cast("int").alias("prediction"), F.round("m", 6).alias("distance"))


for _name, _sql in {"weighted": "{a} + {b}", "max": "greatest({a}, {b})", "min": "least({a}, {b})"}.items():
    _multiview(_name, _sql)

_dot = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))"
_sq = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
KERNELS = {"rbf": f"exp(-0.5::double * {_sq})", "linear": _dot, "polynomial": f"pow(0.5::double * {_dot} + 1, 3)", "sigmoid": f"tanh(0.5::double * {_dot} + 1)", "laplacian": "exp(-0.5::double * list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))))"}


def _gram(kind: str, sql: str) -> None:
    @query(f"gram_{kind}", f"WITH {POINTS} SELECT a.vec_id AS i, count(*) AS n, round(sum({sql}), 4) AS total FROM p a JOIN p b ON a.label = b.label GROUP BY a.vec_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = metrics.gram_sums(points(spark, sf_dir), "features", "label", "vec_id", kind, 0.5, 3, 0.0 if kind in ("rbf", "laplacian", "linear") else 1.0)
        return out.select(F.col("id").alias("i"), "n", F.round("total", 4).alias("total"))


for _name, _sql in KERNELS.items():
    _gram(_name, _sql)


@query("balanced_assignment", f"""WITH {POINTS}, {first_sql(4)}, d AS (SELECT vec_id, cid, {d_sql('se')} AS d FROM p, c0), n AS (SELECT cid, count(*) AS n FROM (SELECT arg_min(cid, (d, cid)) AS cid FROM d GROUP BY vec_id) GROUP BY cid),
m AS (SELECT ceil(1.1::double * count(*) / 4) AS m FROM p), q AS (SELECT vec_id, d.cid, d * (1 + 0.5::double * greatest(0, coalesce(n, 0) - m) / m) AS d FROM d LEFT JOIN n USING (cid), m)
SELECT cluster, count(*) AS n FROM (SELECT arg_min(cid, (d, cid))::int AS cluster FROM q GROUP BY vec_id) GROUP BY cluster""")
def balanced_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, div = points(spark, sf_dir), divergences.make("se")
    c = first_points(p, "features", 4, "vec_id")
    sizes = cluster_sums(p, "features", 4, hard(c, div), lambda x: x).points
    grow = estimators.BalancedKMeans(k=4).penalties(sizes, int(sizes.sum()))
    d = F.zip_with(distances(p, "features", c, div), F.array(*[F.lit(float(g)) for g in grow]), lambda a, b: a * b)
    return p.withColumn("d", d).select((F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"))


@query("coreset_sensitivity", f"WITH {POINTS}, {first_sql(5)}, d AS (SELECT vec_id, min(2 * {d_sql('se')}) AS d FROM p, c0 GROUP BY vec_id), m AS (SELECT max(d) AS m FROM d) SELECT vec_id, round(0.5 * d / m + 0.5 * (1 + 1 / (d + 0.1)), 5) AS sensitivity FROM d, m")
def coreset_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return estimators.CoresetKMeans().sensitivities(p, first_points(p, "features", 5, "vec_id")).select("vec_id", F.round("_s", 5).alias("sensitivity"))


@query("furthest_point", f"WITH {NEAR} SELECT vec_id, round(d, 6) AS distance FROM a ORDER BY d DESC, vec_id LIMIT 1")
def furthest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"), distance="d")
    return near.orderBy(F.desc("d"), "vec_id").limit(1).select("vec_id", F.round("d", 6).alias("distance"))


@query("bic_score", f"WITH {NEAR}, t AS (SELECT sum(d) AS cost, count(*) AS n FROM a), v AS (SELECT *, greatest(cost / n, 1e-10) AS v FROM t) SELECT round(-2 * (-cost / (2 * v) - n * ln(sqrt(v)) - n * ln(2 * pi()) / 2) + (5 * 64 + 1) * ln(n), 4) AS bic FROM v")
def bic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = estimators.CentreModel(first_points(p, "features", 5, "vec_id"))
    return spark.createDataFrame([(estimators.information_score(m.compute_cost(p), p.count(), 5, 64),)], "v double").select(F.round("v", 4).alias("bic"))


def means_sql(i: int, rows: str, value: str = "avg(v)") -> str:
    """Centres c{i+1} as means of ``rows`` (cid, x); a slot without rows keeps its centre."""
    long = f"SELECT cid, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM ({rows})"
    return f"n{i} AS (SELECT cid, list(v ORDER BY pos) AS c FROM (SELECT cid, pos, {value} AS v FROM ({long}) GROUP BY cid, pos) GROUP BY cid), c{i + 1} AS (SELECT o.cid, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (cid))"


@query("streaming_update", f"""WITH {POINTS}, c0 AS (SELECT (vec_id)::int AS cid, x AS c FROM p WHERE vec_id < 3), a AS ({near_sql('se')}), {means_sql(0, 'SELECT cluster AS cid, x FROM a')}
SELECT cid AS cluster, count(*) AS weight, round(any_value(list_sum(c)), 5) AS centre_sum FROM c1 JOIN a ON a.cluster = cid GROUP BY cid""")
def streaming_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = StreamingKMeans(first_points(p, "features", 3, "vec_id"))
    m.update(p, 0)
    rows = [(i, int(w), float(c.sum())) for i, (w, c) in enumerate(zip(m.weights, m.centres, strict=True)) if w]
    return spark.createDataFrame(rows, "cluster int, weight long, s double").select("cluster", "weight", F.round("s", 5).alias("centre_sum"))


def _fit(name: str, make: Callable[[], estimators.KMeans], source: Callable = points) -> None:
    """Starts by hashes of the points, which SQL does not have: sizes only."""

    @query(f"fit_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        out = make().fit(df).transform(df)
        return out.groupBy("prediction").agg(F.count("*").alias("n"))


for _name, _make in {
    "bisecting": lambda: estimators.BisectingKMeans(k=4),
    "minibatch": lambda: estimators.MiniBatchKMeans(k=4, max_iter=8),
    "coreset": lambda: estimators.CoresetKMeans(k=4, coreset_size=100, max_iter=5),
}.items():
    _fit(_name, _make)


def fitted_sql(parts: list[str], predictions: str, centres: str) -> str:
    return f"WITH {', '.join(parts)}, z AS ({predictions}) SELECT cid AS cluster, round(list_sum(c), 5) AS centre_sum, count(z.prediction) AS n FROM {centres} LEFT JOIN z ON z.prediction = cid GROUP BY cid, c"


def lloyd_steps(kind: str, start: int, rounds: int) -> list[str]:
    g, inv = GRADS[kind]
    value = f"avg({g})" if inv == "m" else inv.replace("m", f"avg({g})", 1)
    return [f"a{i} AS ({near_sql(kind, centres=f'c{i}')}), {means_sql(i, f'SELECT cluster AS cid, x FROM a{i}', value)}" for i in range(start, start + rounds)]


def near_predictions(kind: str, centres: str) -> str:
    return f"SELECT cluster AS prediction FROM ({near_sql(kind, centres=centres)})"


def sizes_and_sums(spark: SparkSession, centres: np.ndarray, labelled: DataFrame) -> DataFrame:
    sizes = labelled.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))
    sums = spark.createDataFrame([(i, float(c.sum())) for i, c in enumerate(centres)], "cluster int, s double")
    return sums.join(sizes, "cluster", "left").select("cluster", F.round("s", 5).alias("centre_sum"), F.coalesce("n", F.lit(0)).alias("n"))


def _fitted(name: str, sql: str, make: Callable[[DataFrame], estimators.KMeans]) -> None:
    """From the points of the first ids, for a fixed number of rounds: each cluster's size and the sum of its centre."""

    @query(f"fit_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir)
        model = make(p).fit(p)
        return sizes_and_sums(spark, model.centres, model.transform(p))


def _first(k: int) -> Callable[[DataFrame], np.ndarray]:
    return lambda p: first_points(p, "features", k, "vec_id")


_fixed = {"max_iter": 3, "tol": 0.0}
for _name, _kind in (("kmeans", "se"), ("kmeans_kl", "kl"), ("kmeans_is", "is"), ("kmeans_geni", "geni")):
    _fitted(_name, fitted_sql([POINTS, first_sql(5), *lloyd_steps(_kind, 0, 3)], near_predictions(_kind, "c3"), "c3"), lambda p, kind=_kind: estimators.KMeans(k=5, divergence=kind, initial_centres=_first(5)(p), empty="keep", **_fixed))


def joint_sql(i: int, share: str) -> str:
    """Rows q{i}: each point's shares of the clusters, from distances ``d`` and centres' weights ``w``."""
    return f"d{i} AS (SELECT vec_id, any_value(x) AS x, list({share} ORDER BY cid) AS l FROM (SELECT vec_id, x, cid, w, {d_sql('se')} AS d FROM p, c{i}) GROUP BY vec_id), q{i} AS (SELECT x, list_transform(e, lambda v: v / list_sum(e)) AS q FROM (SELECT x, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM d{i}))"


def shares_sql(share: str, rounds: int) -> str:
    out = [POINTS, f"c0 AS (SELECT vec_id::int AS cid, x AS c, 0.25::double AS w FROM p WHERE vec_id < 4)"]
    for i in range(rounds):
        each = f"SELECT unnest(q) AS u, generate_subscripts(q, 1) - 1 AS cid, x FROM q{i}"
        long = f"SELECT u, cid, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM ({each})"
        out.append(joint_sql(i, share))
        out.append(f"m{i} AS (SELECT cid, pos, sum(u * v) / sum(u) AS v, sum(u) / count(*) AS w FROM ({long}) GROUP BY cid, pos), c{i + 1} AS (SELECT cid::int AS cid, list(v ORDER BY pos) AS c, any_value(w) AS w FROM m{i} GROUP BY cid)")
    out.append(joint_sql(rounds, share))
    return fitted_sql(out, f"SELECT (list_position(q, list_max(q)) - 1)::int AS prediction FROM q{rounds}", f"c{rounds}")


_fitted("soft", shares_sql("-2 * d", 3), lambda p: estimators.SoftKMeans(k=4, beta=2.0, initial_centres=_first(4)(p), **_fixed))
_fitted("mixture", shares_sql("ln(w) - d", 3), lambda p: estimators.BregmanMixture(k=4, initial_centres=_first(4)(p), **_fixed))


def robust_sql(noise: bool) -> str:
    out = [POINTS, first_sql(4)]
    for i in range(3):
        out.append(f"a{i} AS ({near_sql('se', centres=f'c{i}')}), {means_sql(i, f'SELECT cluster AS cid, x FROM a{i} WHERE d <= (SELECT quantile_cont(d, 0.95) FROM a{i})')}")
    out.append(f"f AS ({near_sql('se', centres='c3')})")
    return fitted_sql(out, f"SELECT {'CASE WHEN d / (SELECT quantile_cont(d, 0.5) FROM f) > 1.2 THEN -1 ELSE cluster END' if noise else 'cluster'} AS prediction FROM f", "c3")


_fitted("robust", robust_sql(False), lambda p: estimators.RobustKMeans(k=4, initial_centres=_first(4)(p), **_fixed))
_fitted("robust_noise", robust_sql(True), lambda p: estimators.RobustKMeans(k=4, mode="noise_cluster", threshold=1.2, initial_centres=_first(4)(p), **_fixed))


def balanced_sql(rounds: int) -> str:
    out = [POINTS, first_sql(4)]
    for i in range(rounds):
        out.append(f"s{i} AS (SELECT cluster AS cid, count(*) AS n FROM ({near_sql('se', centres=f'c{i}')}) GROUP BY cluster)")
        out.append(f"g{i} AS (SELECT cid, c, 1 + 0.5::double * greatest(0, coalesce(n, 0) - m) / m AS g FROM c{i} LEFT JOIN s{i} USING (cid), (SELECT ceil(1.1::double * count(*) / 4) AS m FROM p))")
        out.append(f"a{i} AS (SELECT vec_id, any_value(x) AS x, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, x, cid, g * {d_sql('se')} AS d FROM p, g{i}) GROUP BY vec_id)")
        out.append(means_sql(i, f"SELECT cid, x FROM a{i}"))
    return fitted_sql(out, near_predictions("se", f"c{rounds}"), f"c{rounds}")


_fitted("balanced", balanced_sql(3), lambda p: estimators.BalancedKMeans(k=4, initial_centres=_first(4)(p), **_fixed))

_dp = [POINTS, first_sql(1)]
for _i in range(3):  # three furthest points, all further than lam, then two updates
    _dp.append(f"a{_i} AS ({near_sql('se', centres=f'c{_i}')}), c{_i + 1} AS (SELECT cid, c FROM c{_i} UNION ALL SELECT {_i + 1}, (SELECT x FROM a{_i} ORDER BY d DESC LIMIT 1))")
_fitted("dpmeans", fitted_sql([*_dp, *lloyd_steps("se", 3, 2)], near_predictions("se", "c5"), "c5"), lambda p: estimators.DPMeans(lam=0.02, max_k=4, max_iter=1, tol=0.0, initial_centres=_first(1)(p)))


_views = [POINTS, first_sql(4)]
for _i in range(3):
    _views.append(f"a{_i} AS ({near_sql('views', centres=f'c{_i}')}), {means_sql(_i, f'SELECT cluster AS cid, x FROM a{_i}', f'CASE WHEN pos <= 32 THEN avg(v) ELSE exp(avg(ln(v + {E}) + 1) - 1) END')}")


@query("fit_multiview", fitted_sql(_views, near_predictions("views", "c3"), "c3"))
def fit_multiview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"left": F.slice("features", 1, 32), "right": F.slice("features", 33, 32)})
    c = first_points(p, "features", 4, "vec_id")
    m = estimators.MultiViewKMeans([estimators.View("left"), estimators.View("right", 0.5, "kl")], k=4, max_iter=3, tol=0.0).fit(p, [c[:, :32], c[:, 32:]])
    return sizes_and_sums(spark, np.hstack(m.centres), m.transform(p))


def per_k(name: str, value: str, low: int = 2, high: int = 4) -> str:
    """A row for each k: ``value`` over z (vec_id, x, cluster, d) after three rounds from the first k points."""
    each = [f"SELECT {k} AS k, (WITH {', '.join([POINTS, first_sql(k), *lloyd_steps('se', 0, 3)])}, z AS ({near_sql('se', centres='c3')}) {value.replace('$k', str(k))}) AS {name}" for k in range(low, high + 1)]
    return " UNION ALL ".join(each)


BIC = "SELECT -2 * (-cost / (2 * v) - n * ln(sqrt(v)) - n * ln(2 * pi()) / 2) + ($k * 64 + 1) * ln(n) FROM (SELECT cost, n, greatest(cost / n, 1e-10) AS v FROM (SELECT sum(d) AS cost, count(*) AS n FROM z))"


@query("fit_xmeans", f"WITH s AS ({per_k('score', BIC)}) SELECT k::int AS k, round(score, 4) AS score, score = (SELECT min(score) FROM s) AS chosen FROM s")
def fit_xmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    e = estimators.XMeans(max_k=4, initial_centres=_first(4)(p), empty="keep", **_fixed)
    chosen = e.fit(p).k
    return spark.createDataFrame([(k, v, k == chosen) for k, v in e.scores.items()], "k int, score double, chosen boolean").withColumn("score", F.round("score", 4))


def _bounded(name: str, make: Callable) -> None:
    """These need all pairs, so they run over suppliers (a dimension table), by their nation and balance."""

    @query(f"fit_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_nationkey") / 25.0, F.col("s_acctbal").cast("double") / 1e4, F.pmod("s_suppkey", F.lit(7)) / 7.0).alias("features"))
        return make().fit_transform(s, "features", "s_suppkey").groupBy("prediction").agg(F.count("*").alias("n"))


for _name, _make in {
    "kmedoids": lambda: bounded.KMedoids(k=3),
    "kernel": lambda: bounded.KernelKMeans(k=3, gamma=2.0),
    "spectral": lambda: bounded.SpectralClustering(k=3, gamma=2.0),
    "timeseries": lambda: bounded.TimeSeriesKMeans(k=3),
    "agglomerative": lambda: bounded.Agglomerative(clusters=3),
}.items():
    _bounded(_name, _make)


@query("assign_accelerated", SQL["assign_se"])
def assign_accelerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"), "accelerated", distance="distance")
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("lloyd3_bounded", SQL["lloyd3_se"])
def lloyd3_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, div = points(spark, sf_dir), divergences.make("se")
    r = elkan.bounded_lloyd(p, "features", first_points(p, "features", 4, "vec_id"), max_iter=3, tol=0.0)
    centres = spark.createDataFrame([(i, float(c.sum())) for i, c in enumerate(r.centres)], "cluster int, s double")
    own = assign(p, "features", r.centres, div, distance="d").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d").alias("cost"))
    return centres.join(own, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("cost", F.lit(0.0)), 5).alias("cost"), F.round("s", 5).alias("centre_sum"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Must-links between neighbours of one label, cannot-links between rows two apart of different labels."""
    p = points(spark, sf_dir).select(F.col("vec_id").alias("i"), "label")
    pair = lambda gap: p.join(p.select((F.col("i") - gap).alias("i"), F.col("i").alias("j"), F.col("label").alias("other")).hint("merge"), "i")
    must = pair(1).where("label = other").select("i", "j", F.lit(1.0).alias("w"), F.lit("must").alias("kind"))
    return must.union(pair(2).where("label <> other").select("i", "j", F.lit(2.0), F.lit("cannot")))


LINKS = """k AS (SELECT a.vec_id AS i, b.vec_id AS j, 1.0::double AS w, 'must' AS kind FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.label = b.label
UNION ALL SELECT a.vec_id, b.vec_id, 2.0::double, 'cannot' FROM p a JOIN p b ON b.vec_id = a.vec_id + 2 AND a.label <> b.label)"""


@query("must_link_components", f"""WITH RECURSIVE {POINTS}, {LINKS}, ids AS (SELECT i AS id FROM k UNION SELECT j FROM k), e AS (SELECT i, j FROM k WHERE kind = 'must' UNION SELECT j, i FROM k WHERE kind = 'must'),
r(id, component) AS (SELECT id, id FROM ids UNION SELECT e.j, r.component FROM r JOIN e ON e.i = r.id) SELECT id, min(component) AS component FROM r GROUP BY id""")
def must_link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained.must_link_components(constrained.canonical(links(spark, sf_dir)))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se")).select(F.col("vec_id").alias("id"), "cluster")


@query("constraint_violations", f"""WITH {NEAR}, {LINKS}, b AS (SELECT kind, w, (x.cluster <> y.cluster) = (kind = 'must') AS bad FROM k JOIN a x ON x.vec_id = i JOIN a y ON y.vec_id = j)
SELECT kind, count(*) AS pairs, count(*) FILTER (bad) AS violated, sum(CASE WHEN bad THEN w ELSE 0 END)::double AS penalty FROM b GROUP BY kind""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained.violations(_near(spark, sf_dir), constrained.canonical(links(spark, sf_dir)))


@query("constraint_penalties", f"""WITH {NEAR}, {LINKS}, e AS (SELECT i AS id, j AS other, w, kind FROM k UNION ALL SELECT j, i, w, kind FROM k)
SELECT id, j::int AS cluster, sum(CASE WHEN (a.cluster <> j) = (kind = 'must') THEN w ELSE 0 END)::double AS penalty FROM e JOIN a ON a.vec_id = other, range(5) t(j) GROUP BY id, j""")
def constraint_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = constrained.partners(constrained.canonical(links(spark, sf_dir)))
    return constrained.penalties(_near(spark, sf_dir), pairs, 5).select("id", F.posexplode("penalty").alias("cluster", "penalty"))


def _constrained(mode: str) -> None:
    @query(f"fit_constrained_{mode}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, c = points(spark, sf_dir), links(spark, sf_dir)
        e = constrained.ConstrainedKMeans(k=4, id_col="vec_id", mode=mode, max_iter=2, init_mode="random")
        c = c.where("kind = 'must'") if mode == "hard" else c
        return e.labels(e.fit(p, c), p, c).groupBy("prediction").agg(F.count("*").alias("n"))


for _name in ("soft", "hard"):
    _constrained(_name)

LARGER = "AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0.05 THEN v::double ELSE 0 END) AS x FROM embeddings)"
SPARSE = f"{POINTS}, {first_sql(5)}, s {LARGER}"
_p, _q = f"greatest(z[1], {E})", f"greatest(z[2], {E})"
TERMS["sparse_kl"] = f"{_p} * ln({_p} / {_q}) - {_p} + {_q}"
#: How a component of a centre follows from those of its rows.
SPARSE_MEANS = {"kl": f"exp(avg(ln(greatest(v, {E})) + 1) - 1)", "l1": "median(v)"}


def sparse_fit_sql(kind: str, term: str) -> str:
    unit = "list_transform(x, lambda v: v / sqrt(list_dot_product(x, x)))" if kind == "spherical" else "x"
    out = [f"p {LARGER}", first_sql(4)]
    for i in range(3):
        out.append(f"a{i} AS ({near_sql(term, centres=f'c{i}')}), {means_sql(i, f'SELECT cluster AS cid, {unit} AS x FROM a{i}', SPARSE_MEANS.get(kind, 'avg(v)'))}")
    return fitted_sql(out, near_predictions(term, "c3"), "c3")


def sparse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with all but their larger positive components set to zero."""
    x = F.transform("embedding", lambda v: F.when(v > F.lit(0.05).cast("float"), v.cast("double")).otherwise(0.0))  # DuckDB compares floats
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("features"))


def _sparse(kind: str, sql: str) -> None:
    @query(f"sparse_assign_{kind}", f"WITH {SPARSE}, a AS ({near_sql(sql, 's')}) SELECT vec_id, cluster, round(d, 6) AS distance FROM a")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = first_points(points(spark, sf_dir), "features", 5, "vec_id")
        out = sparse.assign_sparse(sparse_points(spark, sf_dir), "features", c, sparse.make(kind), distance="distance")
        return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))

    @query(f"fit_sparse_{kind}", sparse_fit_sql(kind, sql))
    def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sparse_points(spark, sf_dir)
        m = sparse.SparseKMeans(k=4, divergence=kind, mode="force", initial_centres=_first(4)(df), **_fixed).fit(df)
        return sizes_and_sums(spark, m.summary.centres, m.transform(df))


for _name, _sql in {"se": "se", "kl": "sparse_kl", "l1": "l1", "spherical": "spherical"}.items():
    _sparse(_name, _sql)


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quantities of parts by suppliers, and a first clustering of both."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("r"), F.col("l_suppkey").alias("c"), F.col("l_quantity").cast("double").alias("v"))
    return v, v.select("r").distinct().withColumn("rc", F.pmod("r", F.lit(3)).cast("int")), v.select("c").distinct().withColumn("cc", F.pmod("c", F.lit(2)).cast("int"))


BLOCKS = "v AS (SELECT l_partkey AS r, l_suppkey AS c, l_quantity::double AS v, (l_partkey % 3)::int AS rc, (l_suppkey % 2)::int AS cc FROM lineitem), b AS (SELECT rc, cc, avg(v) AS m FROM v GROUP BY rc, cc)"


@query("cocluster_blocks", f"WITH {BLOCKS} SELECT rc, cc, round(m, 6) AS mean FROM b")
def cocluster_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tabular.CoClustering(3, 2).block_means(*cells(spark, sf_dir))
    return spark.createDataFrame([(i, j, float(b[i, j])) for i in range(3) for j in range(2)], "rc int, cc int, m double").select("rc", "cc", F.round("m", 6).alias("mean"))


@query("cocluster_row_costs", f"WITH {BLOCKS} SELECT r, b.rc AS cluster, round(sum(0.5::double * (v - m) * (v - m)), 4) AS cost FROM v JOIN b USING (cc) GROUP BY r, b.rc")
def cocluster_row_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tabular.CoClustering(3, 2)
    v, rows, cols = cells(spark, sf_dir)
    costs = m.move(v, "r", cols, "cc", m.block_means(v, rows, cols))
    return costs.select("r", F.posexplode("cost").alias("cluster", "cost")).withColumn("cost", F.round("cost", 4))


def cocluster_sql(rounds: int) -> str:
    """Rows r{i} (r, rc) and columns k{i} (c, cc) after i rounds; both sides move with the same block means."""
    out = ["v AS (SELECT l_partkey AS r, l_suppkey AS c, l_quantity::double AS v FROM lineitem), r0 AS (SELECT DISTINCT r, (r % 3)::int AS rc FROM v), k0 AS (SELECT DISTINCT c, (c % 2)::int AS cc FROM v)"]
    for i in range(rounds):
        out.append(f"b{i} AS (SELECT rc, cc, coalesce(m, 0.01::double) AS m FROM (SELECT x::int AS rc, y::int AS cc FROM range(3) t(x), range(2) u(y)) LEFT JOIN (SELECT rc, cc, avg(v) AS m FROM v JOIN r{i} USING (r) JOIN k{i} USING (c) GROUP BY rc, cc) USING (rc, cc))")
        for side, to, other, key, at in (("r", "rc", "k", "c", "cc"), ("c", "cc", "r", "r", "rc")):
            cost = f"SELECT v.{side}, b{i}.{to}, sum(0.5::double * (v - m) * (v - m)) AS cost FROM v JOIN {other}{i} USING ({key}) JOIN b{i} USING ({at}) GROUP BY v.{side}, b{i}.{to}"
            out.append(f"{'r' if side == 'r' else 'k'}{i + 1} AS (SELECT {side}, arg_min({to}, (cost, {to})) AS {to} FROM ({cost}) GROUP BY {side})")
    return f"WITH {', '.join(out)} SELECT 'row' AS side, rc AS cluster, count(*) AS n FROM r{rounds} GROUP BY rc UNION ALL SELECT 'column', cc, count(*) FROM k{rounds} GROUP BY cc"


@query("fit_cocluster", cocluster_sql(3))
def fit_cocluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, rows, cols = cells(spark, sf_dir)
    m = tabular.CoClustering(3, 2, "r", "c", "v", max_iter=3, tolerance=0.0).fit(v, rows, cols)
    sides = m.rows.select(F.lit("row").alias("side"), F.col("rc").alias("cluster")).union(m.cols.select(F.lit("column"), "cc"))
    return sides.groupBy("side", "cluster").agg(F.count("*").alias("n"))


@query("fit_information_bottleneck")
def fit_information_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    return tabular.InformationBottleneck(k=3, relevance="l_returnflag", beta=5.0).fit(df).transform(df).groupBy("prediction").agg(F.count("*").alias("n"))


@query("fit_clara")
def fit_clara(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir)
    return sampled.Clara(k=4).fit(df).transform(df).groupBy("prediction").agg(F.count("*").alias("n"))


@query("fit_nystrom")
def fit_nystrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled.NystromSpectral(k=4, landmarks=100).fit_transform(points(spark, sf_dir)).groupBy("prediction").agg(F.count("*").alias("n"))


_bounded("hard_balanced", lambda: sampled.HardBalancedKMeans(k=3, max_iter=10))


_means = "m AS (SELECT cluster AS cid, list(v ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a) GROUP BY cluster, pos) GROUP BY cluster)"


@query("silhouette_approximate", f"""WITH {NEAR}, {_means}, d AS (SELECT vec_id, cluster, cid, sqrt(2 * {d_sql('se', 'x', 'm.c')}) AS d FROM a, m),
s AS (SELECT vec_id, min(d) FILTER (cid = cluster) AS a, min(d) FILTER (cid <> cluster) AS b FROM d GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def silhouette_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = assign(p, "features", first_points(p, "features", 5, "vec_id"), divergences.make("se"))
    return metrics.approximate_silhouette(near, "features", "cluster").select(F.round("silhouette", 6).alias("silhouette"))


@query("effective_clusters", f"WITH {SOFT} SELECT round(avg(exp(-list_sum(list_transform(q, lambda v: v * ln(v))))), 6) AS effective_clusters FROM s")
def effective_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = estimators.SoftModel(first_points(p, "features", 4, "vec_id"), beta=2.0)
    return metrics.effective_clusters(m.transform(p), "probabilities").select(F.round("effective_clusters", 6).alias("effective_clusters"))


INERTIA = f"SELECT sum(2 * {d_sql('se', 'z.x', 'm.c')}) FROM z JOIN (SELECT cluster, list(v ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM z) GROUP BY cluster, pos) GROUP BY cluster) m USING (cluster)"


@query("elbow_curve", f"SELECT k::int AS k, round(inertia, 5) AS inertia FROM ({per_k('inertia', INERTIA)})")
def elbow_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    base = estimators.KMeans(initial_centres=_first(4)(p), empty="keep", **_fixed)
    return presets.elbow_curve(p, "features", 2, 4, base).withColumn("inertia", F.round("inertia", 5))


@query("vector_algebra", f"""WITH {POINTS}, s AS (SELECT vec_id, list_sum(x) AS total, list_sum(list_transform(x, lambda v: v * v)) AS sq, list_max(x) AS largest, x FROM p)
SELECT vec_id, round(total, 6) AS total, round(largest, 6) AS largest, round(sq, 6) AS squared_norm, round(sqrt(sq), 6) AS norm2, round(list_sum(list_transform(x, lambda v: abs(v - 0.5::double))), 6) AS norm1,
round(list_sum(list_transform(x, lambda v: v * (2 * v + 1))), 6) AS dot, round(list_sum(list_transform(x, lambda v: v / sqrt(sq))), 6) AS unit_total FROM s""")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, x = points(spark, sf_dir), F.col("features")
    return p.select(
        "vec_id",
        F.round(vectors.total(x), 6).alias("total"),
        F.round(vectors.largest(x), 6).alias("largest"),
        F.round(vectors.squared_norm(x), 6).alias("squared_norm"),
        F.round(vectors.norm2(x), 6).alias("norm2"),
        F.round(vectors.norm1(vectors.trans(x, lambda v: v - 0.5)), 6).alias("norm1"),
        F.round(vectors.dot(x, vectors.axpy(2.0, x, vectors.trans(x, lambda v: F.lit(1.0)))), 6).alias("dot"),
        F.round(vectors.total(vectors.normalised(x)), 6).alias("unit_total"),
    )


@query("safe_logs", "SELECT l_returnflag, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE ln(l_discount::double) END), 4) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def safe_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = vectors.safe_log(F.col("l_discount").cast("double"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(log), 4).alias("total"), F.count("*").alias("n"))


@query("rule_report", f"""WITH {LINES} SELECT rule, count_if(bad)::BIGINT AS broken FROM (
SELECT unnest(['not_null', 'no_nan', 'finite', 'domain_logistic', 'weight', 'small']) AS rule,
       unnest([x IS NULL, len(list_filter(x, lambda v: isnan(v))) > 0, len(list_filter(x, lambda v: isinf(v))) > 0, len(list_filter(x, lambda v: v <= 0 OR v >= 1)) > 0, w < 0, x[1] >= 0.5::double]) AS bad FROM p) GROUP BY rule""")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lines(spark, sf_dir)
    given = validate.rules(p, "features", divergences.make("logistic"), "w") | {"small": F.get("features", 0) >= 0.5}
    found = validate.examine(p, given, "features")
    return spark.createDataFrame([(name, found.broken.get(name, 0)) for name in given], "rule string, broken long")


@query("dendrogram")
def dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_nationkey") / 25.0, F.col("s_acctbal").cast("double") / 1e4).alias("features"))
    fitted = bounded.Agglomerative(clusters=1, linkage="ward")
    fitted.fit_transform(s, "features", "s_suppkey")
    return persistence.dendrogram(spark, fitted.merges)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, n, wcss) after three iterations from the ten first embeddings."""
    p, div = points(spark, sf_dir), divergences.make("se")
    r = lloyd(p, "features", first_points(p, "features", 10, "vec_id"), div, max_iter=3, tol=0.0)
    return assign(p, "features", r.centres, div, distance="d").groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("d"), 5).alias("wcss"))
