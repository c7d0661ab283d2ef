"""Estimators: ``fit(df)`` gives a model, ``model.transform(df)`` appends its columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.errors import OutOfRange
from halocline.functions import divergences
from halocline.functions.divergences import Divergence
from halocline.operators.assign import assign, distances, features_of, nearest, stack
from halocline.operators.metrics import Quality, quality
from halocline.operators.update import added_up, cluster_sums, hard, soft
from halocline.operators.validate import require_valid
from halocline.plans.elkan import BOUNDED_FROM, bounded_lloyd
from halocline.plans.lloyd import LloydResult, hashed_points, initial, lloyd


@dataclass
class CentreModel:
    """Centres under a divergence."""

    centres: np.ndarray
    divergence: str = "squaredEuclidean"
    features: str = "features"
    prediction: str = "prediction"
    distance: str | None = None
    smoothing: float = divergences.EPSILON
    strategy: str = "auto"
    summary: LloydResult | None = None

    @property
    def div(self) -> Divergence:
        return divergences.make(self.divergence, self.smoothing)

    @property
    def k(self) -> int:
        return len(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        return assign(df, self.features, self.centres, self.div, self.strategy, self.prediction, self.distance)

    def predict(self, point) -> int:
        return int(nearest(np.asarray(point, dtype=float)[None], self.centres, self.div)[0][0])

    def compute_cost(self, df: DataFrame, weight: str | None = None) -> float:
        d = assign(df, self.features, self.centres, self.div, distance="_d")
        return float(d.agg(F.sum(F.col("_d") * (F.col(weight) if weight else F.lit(1.0)))).first()[0] or 0.0)

    def quality(self, df: DataFrame) -> Quality:
        return quality(df, self.features, self.centres, self.div)


@dataclass
class KMeans:
    """Lloyd's loop with a pluggable divergence."""

    k: int = 2
    divergence: str = "squaredEuclidean"
    smoothing: float = divergences.EPSILON
    max_iter: int = 20
    tol: float = 1e-4
    init_mode: str = "k-means||"
    init_steps: int = 2
    initial_centres: np.ndarray | None = None
    n_init: int = 1
    seed: int = 0
    features: str = "features"
    prediction: str = "prediction"
    distance: str | None = None
    weight: str | None = None
    strategy: str = "auto"
    centroid: str = "dual"
    empty: str = "reseed"
    validate: bool = True
    #: Bounds by the triangle inequality, where they give the same result: squared Euclidean, five clusters or more, ``empty="keep"``.
    accelerate: bool = False

    def __post_init__(self) -> None:
        for name, least in (("k", 1), ("max_iter", 0), ("tol", 0), ("init_steps", 0), ("n_init", 1), ("smoothing", 0)):
            value = getattr(self, name)
            if not value >= least:
                raise OutOfRange(name, value, f"{least} or more")
        divergences.make(self.divergence)

    @property
    def div(self) -> Divergence:
        return divergences.make(self.divergence, self.smoothing)

    def model(self, centres: np.ndarray, summary: LloydResult | None = None) -> CentreModel:
        return CentreModel(np.asarray(centres, dtype=float), self.divergence, self.features, self.prediction, self.distance, self.smoothing, self.strategy, summary)

    def start(self, df: DataFrame, seed: int | None = None) -> np.ndarray:
        return self.initial_centres if self.initial_centres is not None else initial(df, self.features, self.k, self.div, self.init_mode, self.seed if seed is None else seed, self.init_steps)

    def fit(self, df: DataFrame) -> CentreModel:
        if self.validate:
            require_valid(df, self.features, self.div, self.weight)
        best = None
        for run in range(self.n_init):
            start = self.start(df, self.seed + run)
            if self.accelerate and self.empty == "keep" and self.div.name == "squaredEuclidean" and self.k >= BOUNDED_FROM:
                r = bounded_lloyd(df, self.features, start, self.max_iter, self.tol, self.weight)
                r.distortion.append(self.model(r.centres).compute_cost(df, self.weight))
            else:
                r = lloyd(df, self.features, start, self.div, self.max_iter, self.tol, self.weight, self.centroid, self.empty)
            if best is None or r.distortion[-1:] < best.distortion[-1:]:
                best = r
        return self.model(best.centres, best)


@dataclass
class BisectingKMeans(KMeans):
    """Splits the largest cluster in two until there are k."""

    min_divisible: int = 1

    def fit(self, df: DataFrame) -> CentreModel:
        require_valid(df, self.features, self.div, self.weight)
        centres = [lloyd(df, self.features, hashed_points(df, self.features, 1, self.seed), self.div, 1, 0.0, self.weight, self.centroid).centres[0]]
        # A cluster is the set of points sent down one path of splits: pairs of centres, in order.
        paths: list[list[tuple[np.ndarray, int]]] = [[]]
        sizes, stuck = [df.count()], set()
        inner = replace(_plain(self), k=2, validate=False, initial_centres=None)

        def part(path: list[tuple[np.ndarray, int]]) -> DataFrame:
            out = df
            for pair, side in path:
                out = assign(out, self.features, pair, self.div, cluster="_side").where(F.col("_side") == side).drop("_side")
            return out

        while len(centres) < self.k:
            open_ = [i for i in range(len(centres)) if i not in stuck and sizes[i] > max(1, self.min_divisible)]
            if not open_:
                break
            i = max(open_, key=lambda c: (sizes[c], -c))
            own = part(paths[i])
            seeds = hashed_points(own, self.features, 2, self.seed)
            if len(seeds) < 2:
                stuck.add(i)
                continue
            pair = replace(inner, initial_centres=seeds).fit(own).centres
            n = cluster_sums(own, self.features, 2, hard(pair, self.div), lambda p: p).points
            if n.min() == 0:
                stuck.add(i)
                continue
            base, sizes[i], centres[i] = paths[i], int(n[0]), pair[0]
            paths[i] = [*base, (pair, 0)]
            centres.append(pair[1])
            sizes.append(int(n[1]))
            paths.append([*base, (pair, 1)])
        return self.model(np.array(centres))


def first_of(centres: np.ndarray | None, k: int) -> np.ndarray | None:
    """The first ``k`` of given centres, for fits that try several k."""
    return None if centres is None else np.asarray(centres, dtype=float)[:k]


def _plain(e: KMeans) -> KMeans:
    return KMeans(**{f: getattr(e, f) for f in KMeans.__dataclass_fields__})


def information_score(cost: float, n: int, k: int, d: int, kind: str = "bic") -> float:
    """BIC or AIC of a clustering; lower is better."""
    variance = max(cost / n, 1e-10)
    log_l = -cost / (2 * variance) - n * math.log(math.sqrt(variance)) - n * math.log(2 * math.pi) / 2
    p = k * d + 1
    return -2 * log_l + (p * math.log(n) if kind == "bic" else 2 * p)


@dataclass
class XMeans(KMeans):
    """Fits every k from min_k to max_k and keeps the best score."""

    min_k: int = 2
    max_k: int = 20
    criterion: str = "bic"
    scores: dict[int, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> CentreModel:
        n, best = df.count(), None
        for k in range(self.min_k, min(self.max_k, n) + 1):
            m = replace(_plain(self), k=k, initial_centres=first_of(self.initial_centres, k)).fit(df)
            self.scores[k] = information_score(m.compute_cost(df), n, m.k, m.centres.shape[1], self.criterion)
            if best is None or self.scores[k] < best[0]:
                best = self.scores[k], m
        return best[1]


@dataclass
class SoftModel(CentreModel):
    beta: float = 1.0
    min_membership: float = 1e-10
    probability: str = "probabilities"

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_d", distances(df, self.features, self.centres, self.div)).withColumn("_low", F.array_min("_d"))
        raw = F.transform("_d", lambda d: F.exp(-self.beta * (d - F.col("_low"))))
        out = out.withColumn("_p", raw).withColumn("_s", divergences.array_sum(F.col("_p")))
        out = out.withColumn("_p", F.transform("_p", lambda p: F.greatest(F.when(F.col("_s") > 1e-100, p / F.col("_s")).otherwise(1.0 / self.k), F.lit(self.min_membership))))
        out = out.withColumn("_s", divergences.array_sum(F.col("_p"))).withColumn(self.probability, F.transform("_p", lambda p: p / F.col("_s")))
        return out.withColumn(self.prediction, (F.array_position(self.probability, F.array_max(self.probability)) - 1).cast("int")).drop("_d", "_low", "_p", "_s")


@dataclass
class SoftKMeans(KMeans):
    """Memberships in proportion to exp(-beta D); centres are arithmetic means."""

    beta: float = 1.0
    min_membership: float = 1e-10
    init_mode: str = "random"

    def fit(self, df: DataFrame) -> SoftModel:
        require_valid(df, self.features, self.div, self.weight)
        centres, last, history = self.start(df), None, []
        for _ in range(self.max_iter):
            s = cluster_sums(df, self.features, len(centres), soft(centres, self.div, self.beta, self.min_membership), lambda x: x, self.weight)
            centres = np.where((s.weight > 0)[:, None], s.mean(), centres)
            history.append(float(s.cost.sum()))
            if last is not None and (last - history[-1]) / max(abs(last), 1e-10) < self.tol:
                break
            last = history[-1]
        m = self.model(centres, LloydResult(centres, len(history), history))
        return SoftModel(**vars(m), beta=self.beta, min_membership=self.min_membership)


@dataclass
class MixtureModel(CentreModel):
    weights: np.ndarray = field(default_factory=lambda: np.ones(1))
    probability: str = "probability"

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.weights, 1e-300)) - self.div.matrix(x, self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        logs = F.array(*[F.lit(float(math.log(max(w, 1e-300)))) for w in self.weights])
        out = df.withColumn("_l", F.zip_with(logs, distances(df, self.features, self.centres, self.div), lambda w, d: w - d)).withColumn("_m", F.array_max("_l"))
        out = out.withColumn("_p", F.transform("_l", lambda v: F.exp(v - F.col("_m")))).withColumn("_s", divergences.array_sum(F.col("_p")))
        out = out.withColumn(self.probability, F.transform("_p", lambda p: p / F.col("_s")))
        return out.withColumn(self.prediction, (F.array_position("_l", F.col("_m")) - 1).cast("int")).drop("_l", "_m", "_p", "_s")

    def log_likelihood(self, df: DataFrame) -> float:
        logs = F.array(*[F.lit(float(math.log(max(w, 1e-300)))) for w in self.weights])
        l = F.zip_with(logs, distances(df, self.features, self.centres, self.div), lambda w, d: w - d)
        return float(df.select(l.alias("l")).withColumn("m", F.array_max("l")).agg(F.sum(F.col("m") + F.log(divergences.array_sum(F.transform("l", lambda v: F.exp(v - F.col("m"))))))).first()[0])


@dataclass
class BregmanMixture(KMeans):
    """Expectation maximisation for a mixture of the divergence's exponential family."""

    regularization: float = 0.0

    def fit(self, df: DataFrame) -> MixtureModel:
        require_valid(df, self.features, self.div, self.weight)
        centres = self.start(df)
        weights, last, history = np.full(len(centres), 1 / len(centres)), None, []
        to_dual = self.div.grad or (lambda x: x)
        for _ in range(self.max_iter):
            now = MixtureModel(centres, self.divergence, smoothing=self.smoothing, weights=weights)

            def share(x: np.ndarray, now: MixtureModel = now) -> tuple[np.ndarray, np.ndarray]:
                l = now.log_joint(x)
                m = l.max(1, keepdims=True)
                p = np.exp(l - m)
                total = p.sum(1, keepdims=True)
                return p / total, np.repeat(m + np.log(total), l.shape[1], axis=1)

            s = cluster_sums(df, self.features, len(centres), share, to_dual, self.weight)
            mean = s.mean()
            centres = np.where((s.weight > 1e-12)[:, None], self.div.inv_grad(mean) if self.div.inv_grad else mean, centres)
            weights = (s.weight + self.regularization) / (s.weight.sum() + self.regularization * len(centres))
            history.append(float(s.cost.sum()))
            if last is not None and 0 <= (history[-1] - last) / max(abs(last), 1e-10) < self.tol:
                break
            last = history[-1]
        m = self.model(centres, LloydResult(centres, len(history), history))
        return MixtureModel(**vars(m), weights=weights)


@dataclass
class MiniBatchKMeans(KMeans):
    """Hash-drawn batches; a centre moves by 1 / (its count) towards each new point."""

    batch_size: int = 1024
    max_iter: int = 100
    max_no_improvement: int = 10
    #: Share of all rows in a batch, if positive, instead of ``batch_size``; batches reach the driver, so ``max_batch`` at most.
    fraction: float = 0.0
    max_batch: int = 100_000

    def fit(self, df: DataFrame) -> CentreModel:
        n = require_valid(df, self.features, self.div, self.weight)
        centres = self.start(df).astype(float)
        count, best, idle = np.zeros(len(centres)), math.inf, 0
        x = df.select(features_of(df, self.features).alias("x"))
        size = min(self.max_batch, max(1, math.ceil(self.fraction * n))) if self.fraction > 0 else self.batch_size
        for turn in range(self.max_iter):
            share = min(1.0, 1.5 * size / n)
            # The smallest hashes, wherever their rows lie; the filter only spares the sort.
            drawn = x.withColumn("h", F.xxhash64("x", F.lit(self.seed), F.lit(turn))).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
            batch = np.array([r[0] for r in drawn.orderBy(F.xxhash64("h"), "x").limit(size).collect()], dtype=float)
            if not len(batch):
                continue
            c, d = nearest(batch, centres, self.div)
            for i, p in zip(c, batch, strict=True):
                count[i] += 1
                centres[i] += (p - centres[i]) / count[i]
            mean = float(d.mean())
            idle = 0 if mean < best - self.tol else idle + 1
            best = min(best, mean)
            if idle >= self.max_no_improvement:
                break
        return self.model(centres)


@dataclass
class DPMeans(KMeans):
    """Adds the furthest point as a centre while its D exceeds ``lam``; otherwise updates."""

    lam: float = 1.0
    max_k: int = 100

    def fit(self, df: DataFrame) -> CentreModel:
        require_valid(df, self.features, self.div, self.weight)
        centres = self.initial_centres if self.initial_centres is not None else hashed_points(df, self.features, 1, self.seed)
        steps = 0
        while steps < self.max_iter + max(self.max_k, 1):
            steps += 1
            far = assign(df.select(features_of(df, self.features).alias(self.features)), self.features, centres, self.div, distance="_d").agg(F.max("_d").alias("d"), F.max_by(self.features, F.struct("_d", self.features)).alias("x")).first()
            if far["d"] > self.lam and (self.max_k == 0 or len(centres) < self.max_k):
                centres = np.vstack([centres, np.asarray(far["x"], dtype=float)])
                continue
            r = lloyd(df, self.features, centres, self.div, 1, 0.0, self.weight, self.centroid)
            moved = max(float(self.div.matrix(a[None], b[None])[0, 0]) for a, b in zip(centres, r.centres, strict=True))
            centres = r.centres
            if moved < self.tol:
                break
        return self.model(centres)


@dataclass
class RobustModel(CentreModel):
    threshold: float = 3.0
    median: float = 1.0
    mode: str = "trim"

    def transform(self, df: DataFrame) -> DataFrame:
        out = assign(df, self.features, self.centres, self.div, self.strategy, self.prediction, "_d")
        out = out.withColumn("outlier_score", F.col("_d") / F.lit(self.median)).withColumn("is_outlier", F.col("outlier_score") > self.threshold).drop("_d")
        return out.withColumn(self.prediction, F.when(F.col("is_outlier"), -1).otherwise(F.col(self.prediction))) if self.mode == "noise_cluster" else out


@dataclass
class RobustKMeans(KMeans):
    """Leaves the furthest ``outlier_fraction`` (trim, noise_cluster) out of updates, or weighs points by Huber's rule."""

    mode: str = "trim"
    outlier_fraction: float = 0.05
    threshold: float = 3.0

    def fit(self, df: DataFrame) -> RobustModel:
        require_valid(df, self.features, self.div, self.weight)
        centres = self.start(df)
        near = None
        for _ in range(self.max_iter):
            near = assign(df, self.features, centres, self.div, distance="_d")
            cut, median = near.agg(F.percentile("_d", 1 - self.outlier_fraction), F.percentile("_d", 0.5)).first()
            own = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
            if self.mode == "m_estimator":
                delta = max(self.threshold * max(median, 1e-10), 1e-10)
                use, weight = near.withColumn("_w", own * F.when(F.col("_d") <= delta, 1.0).otherwise(F.lit(delta) / F.col("_d"))), "_w"
            else:
                use, weight = near.where(F.col("_d") <= F.lit(cut)).withColumn("_w", own), "_w"
            new = lloyd(use, self.features, centres, self.div, 1, 0.0, weight, self.centroid).centres
            moved = float(np.sqrt(((new - centres) ** 2).sum(1)).max())
            centres = new
            if moved < self.tol:
                break
        median = assign(df, self.features, centres, self.div, distance="_d").agg(F.percentile("_d", 0.5)).first()[0]
        return RobustModel(**vars(self.model(centres)), threshold=self.threshold, median=median if median > 1e-10 else 1.0, mode=self.mode)


@dataclass
class BalancedKMeans(KMeans):
    """Distances grow by penalty * oversize / max size (soft balance); centres are arithmetic means."""

    max_cluster_size: int = 0
    penalty: float = 0.5
    max_iter: int = 50
    centroid: str = "mean"

    def penalties(self, sizes: np.ndarray, n: int) -> np.ndarray:
        most = self.max_cluster_size or math.ceil(1.1 * n / self.k)
        return 1 + self.penalty * np.maximum(0, sizes - most) / most

    def fit(self, df: DataFrame) -> CentreModel:
        n = require_valid(df, self.features, self.div, self.weight)
        centres = self.start(df)
        for _ in range(self.max_iter):
            sizes = cluster_sums(df, self.features, len(centres), hard(centres, self.div), lambda x: x).points
            grow = self.penalties(sizes, n)

            def member(x: np.ndarray, centres: np.ndarray = centres, grow: np.ndarray = grow) -> tuple[np.ndarray, np.ndarray]:
                d = self.div.matrix(x, centres) * grow
                part = np.zeros_like(d)
                part[np.arange(len(x)), d.argmin(1)] = 1.0
                return part, d

            s = cluster_sums(df, self.features, len(centres), member, lambda x: x, self.weight)
            new = np.where((s.weight > 0)[:, None], s.mean(), centres)
            moved = float(np.sqrt(((new - centres) ** 2).sum(1)).max())
            centres = new
            if moved < self.tol:
                break
        return self.model(centres)


@dataclass
class CoresetKMeans(KMeans):
    """Clusters an importance sample with weights, then refines on all points from those centres."""

    coreset_size: int = 1000
    strategy_sensitivity: str = "hybrid"
    distance_weight: float = 0.5
    refinement: int = 3
    min_probability: float = 1e-6
    max_weight: float = 1e6
    sample_centres: int = 10

    def sensitivities(self, df: DataFrame, seeds: np.ndarray) -> DataFrame:
        """Adds _s; the distance is squared Euclidean without the half, whatever the divergence."""
        near = assign(df, self.features, seeds, divergences.make("se"), distance="_d").drop("cluster").withColumn("_d", 2 * F.greatest("_d", F.lit(0.0)))
        most = near.agg(F.max("_d")).first()[0] or 1.0
        by_distance, density = F.col("_d") / F.lit(most if most > 0 else 1.0), 1 + 1 / (F.col("_d") + 0.1)
        s = {"uniform": F.lit(1.0), "distance": by_distance, "density": density, "hybrid": self.distance_weight * by_distance + (1 - self.distance_weight) * density}[self.strategy_sensitivity]
        return near.withColumn("_s", s)

    def coreset(self, df: DataFrame) -> DataFrame:
        """Sampled rows with their weight _w, chosen by a hash of the point."""
        scored = self.sensitivities(df, hashed_points(df, self.features, self.sample_centres, self.seed))
        total = scored.agg(F.sum("_s")).first()[0]
        p = F.least(F.lit(1.0), F.greatest(F.lit(self.min_probability), self.coreset_size * F.col("_s") / F.lit(total)))
        draw = F.pmod(F.xxhash64(features_of(df, self.features), F.lit(self.seed), F.lit("coreset")), F.lit(1 << 53)) / F.lit(float(1 << 53))
        return scored.withColumn("_p", p).where(draw < F.col("_p")).withColumn("_w", F.least(F.lit(self.max_weight), 1 / F.col("_p")))

    def fit(self, df: DataFrame) -> CentreModel:
        n = require_valid(df, self.features, self.div, self.weight)
        if n <= 2 * self.coreset_size:
            return _plain(self).fit(df)
        small = replace(_plain(self), weight="_w", validate=False).fit(self.coreset(df))
        return self.model(lloyd(df, self.features, small.centres, self.div, self.refinement, self.tol, self.weight, self.centroid).centres) if self.refinement else small


@dataclass(frozen=True)
class View:
    features: str
    weight: float = 1.0
    divergence: str = "squaredEuclidean"


def multiview_distances(df: DataFrame, views: list[View], centres: list[np.ndarray], combine: str = "weighted"):
    """Array column: the combined distance to every centre (sum, greatest or least of weighted views)."""
    total = sum(v.weight for v in views)
    join = {"weighted": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}[combine]

    def weighed(view: View, own: np.ndarray):
        return F.transform(distances(df, view.features, own, divergences.make(view.divergence)), lambda d: d * (view.weight / total))

    out, *rest = [weighed(v, c) for v, c in zip(views, centres, strict=True)]
    for part in rest:
        out = F.zip_with(out, part, join)
    return out


@dataclass
class MultiViewKMeans:
    views: list[View]
    k: int = 2
    combine: str = "weighted"
    max_iter: int = 20
    tol: float = 1e-4
    seed: int = 0
    prediction: str = "prediction"
    centres: list[np.ndarray] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        d = multiview_distances(df, self.views, self.centres, self.combine)
        return df.withColumn("_d", d).withColumn(self.prediction, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")

    def fit(self, df: DataFrame, initial_centres: list[np.ndarray] | None = None) -> MultiViewKMeans:
        """Each round is one job: a partition adds up all views' values by cluster before anything is shuffled."""
        self.centres = self.start(df) if initial_centres is None else [np.asarray(c, dtype=float) for c in initial_centres]
        divs = [divergences.make(v.divergence) for v in self.views]
        both = [d.grad is not None and d.inv_grad is not None for d in divs]
        k, names = len(self.centres[0]), [f"v{i}" for i in range(len(self.views))]
        cuts = np.cumsum([1] + [c.shape[1] for c in self.centres])

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros((k, cuts[-1]))
            for b in batches:
                if len(b):
                    values = [d.grad(stack(b[n])) if dual else stack(b[n]) for d, dual, n in zip(divs, both, names, strict=True)]
                    np.add.at(held, b["c"].to_numpy(), np.column_stack([np.ones(len(b)), *values]))
            yield pd.DataFrame({"c": np.arange(k, dtype=np.int32), "s": list(held)})

        for _ in range(self.max_iter):
            labelled, moved = self.transform(df), 0.0
            columns = [features_of(df, v.features).alias(n) for v, n in zip(self.views, names, strict=True)]
            sums = added_up(labelled.select(F.col(self.prediction).alias("c"), *columns).mapInPandas(partial, "c int, s array<double>"), k)
            if sums is None:
                break
            full = sums[:, 0] > 0
            for i, d in enumerate(divs):
                mean, new = sums[full, cuts[i] : cuts[i + 1]] / sums[full, :1], self.centres[i].copy()
                new[full] = d.inv_grad(mean) if both[i] else mean
                moved = max(moved, float(np.sqrt(((new - self.centres[i]) ** 2).sum(1)).max()))
                self.centres[i] = new
            if moved < self.tol:
                break
        return self

    def start(self, df: DataFrame) -> list[np.ndarray]:
        columns = [features_of(df, v.features).alias(f"v{i}") for i, v in enumerate(self.views)]
        seeds = df.select(*columns).withColumn("h", F.xxhash64(*[f"v{i}" for i in range(len(columns))], F.lit(self.seed))).orderBy("h").limit(self.k).collect()
        return [np.array([r[f"v{i}"] for r in seeds], dtype=float) for i in range(len(self.views))]
