"""Parts by name, settings as a value, guards, and scopes."""

import subprocess
import sys

import numpy as np
import pytest

import halocline
from halocline import guards
from halocline.errors import OutOfRange, UnknownName
from halocline.functions import divergences
from halocline.operators import assign as assignments
from halocline.operators.assign import adaptive_chunk, assign, memory_bytes
from halocline.plans import strategies
from halocline.plans.config import Config, from_preset
from halocline.plans.estimators import KMeans, MiniBatchKMeans, MultiViewKMeans, View
from halocline.plans.lloyd import lloyd


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).random((80, 3)) + np.repeat(np.arange(4), 20)[:, None]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").cache()


def test_every_strategy_agrees(table, monkeypatch):
    x, df = table
    monkeypatch.setattr(assignments, "CHUNKED", 2)
    monkeypatch.setattr(assignments, "ADAPTIVE_MOST", 10)
    centres, div = np.vstack([x[:12], x[:1]]), divergences.make("se")
    want = div.matrix(x, centres).argmin(1)
    for name in assignments.STRATEGIES:
        got = strategies.assignment(name)(df, "features", centres, div).orderBy("id").toPandas()["cluster"]
        assert (got == want).all(), name
    with pytest.raises(UnknownName):
        strategies.assignment("other")


def test_chunk_follows_memory(table):
    assert [memory_bytes(t) for t in ("2g", "512m", "1024", "3GB", "64k")] == [2 << 30, 512 << 20, 1 << 30, 3 << 30, 64 << 10]
    assert adaptive_chunk(table[1], 10) == 1000 and adaptive_chunk(table[1], 10**9) == 10 and 10 < adaptive_chunk(table[1], 20_000) < 1000


def test_named_updates_and_empties(table):
    x, df = table
    div = divergences.make("l1")
    own = div.matrix(x, x[[0, 70]]).argmin(1)
    assert np.allclose(strategies.update("manhattan")(df, "features", x[[0, 70]], div, None), [np.median(x[own == c], 0) for c in (0, 1)])
    se = divergences.make("se")
    one = lloyd(df, "features", x[[0, 70]], se, max_iter=1, tol=0.0).centres
    assert np.allclose(strategies.update("se")(df, "features", x[[0, 70]], se, None), one)
    far, none = np.vstack([x[:2], [[99.0] * 3]]), np.array([False, False, True])
    assert len(strategies.empty_handler("drop")(df, "features", far, none, se)) == 2
    assert (strategies.empty_handler("keep")(df, "features", far, none, se) == far).all()
    assert (strategies.empty_handler("reseedRandom")(df, "features", far, none, se)[2] != 99).any()


def test_loops(table):
    x, df = table
    assert strategies.loop(divergences.make("se"), 5, accelerate=True) is strategies.bounded_lloyd
    for given in ((divergences.make("kl"), 5, True), (divergences.make("se"), 4, True), (divergences.make("se"), 5, False)):
        assert strategies.loop(*given) is not strategies.bounded_lloyd
    settings = {"k": 5, "initial_centres": x[::16], "empty": "keep", "max_iter": 4, "tol": 0.0}
    fast, plain = KMeans(accelerate=True, **settings).fit(df), KMeans(**settings).fit(df)
    assert np.allclose(fast.centres, plain.centres) and np.isclose(fast.summary.distortion[-1], plain.compute_cost(df))
    halves = strategies.iterate(1.0, lambda s: (s / 2, 1 + s / 2), tol=1e-3)
    assert halves.converged and halves.iterations < 20 and halves.costs[0] == 1.5
    costs = iter([5.0, 4.999, 4.999])
    assert strategies.iterate(0, lambda s: (s, next(costs)), max_iter=3, tol=0.01, improving=True).iterations == 3


def test_views_without_rows_and_ties(spark, table):
    x, df = table
    m = MultiViewKMeans([View("features"), View("features", 0.5, "kl")], k=2, max_iter=1, tol=0.0).fit(df, [x[[0, 70]], x[[0, 70]]])
    d = (divergences.make("se").matrix(x, x[[0, 70]]) + 0.5 * divergences.make("kl").matrix(x, x[[0, 70]])) / 1.5
    own = d.argmin(1)
    assert np.allclose(m.centres[0], [x[own == c].mean(0) for c in (0, 1)])
    assert np.allclose(m.centres[1], [np.exp(np.log(x[own == c]).mean(0)) for c in (0, 1)])
    still = MultiViewKMeans([View("features")], k=2).fit(df.limit(0), [x[:2]])
    assert (still.centres[0] == x[:2]).all()


def test_settings():
    c = Config().but(k=7, kernel="kl", weight_col="w", reseed_policy="drop")
    e = c.estimator()
    assert type(e) is KMeans and (e.k, e.divergence, e.weight, e.empty, e.init_mode) == (7, "kl", "w", "drop", "k-means||")
    assert Config().k == 5 and c.but(weight_col=None).weight_col is None and "kernel: kl" in c.summary
    assert isinstance(Config(mini_batch_fraction=0.2).estimator(), MiniBatchKMeans)
    for wrong in ({"k": 0}, {"max_iter": 0}, {"tolerance": -1}, {"seed": -1}, {"mini_batch_fraction": 0.0}, {"checkpoint_interval": 0}, {"kernel": "x"}, {"init_mode": "x"}, {"reseed_policy": "x"}):
        assert not Config(**wrong).validate().ok, wrong
    assert Config().validate().ok and from_preset("streaming", k=3).mini_batch_fraction == 0.01 and from_preset("topic_modeling").kernel == "kl"
    with pytest.raises(UnknownName):
        Config().but(depth=3)


@pytest.mark.parametrize("on", [True, False])
def test_telemetry_of_settings(table, caplog, on):
    caplog.set_level("INFO", "halocline")
    Config(k=2, max_iter=2, enable_telemetry=on).fit(table[1])
    assert any("finished" in r.getMessage() for r in caplog.records) == on


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (guards.finite, 1.0, float("nan")), (guards.positive, 1, 0), (guards.non_negative, 0, -1), (guards.probability, 1.0, 1.1), (guards.weight, 0.0, float("inf")), (guards.present, 0, None), (guards.filled, [1], []),
        (guards.finite_vector, [1.0], [float("inf")]), (guards.positive_vector, [1.0], [1.0, 0.0]), (guards.non_negative_vector, [0.0], [-1.0]), (guards.distribution, [0.5, 0.5], [0.5, 0.6]),
        (lambda i: guards.index(i, 2), 1, 2), (lambda x: guards.same_length(x, [1.0]), [2.0], [2.0, 3.0]), (lambda x: guards.add(x, x), [1.0], [1e308]), (lambda x: guards.scale(x, 1e10), [1.0], [1e300]),
    ],
)
def test_guards(check, good, bad):
    check(good)
    with pytest.raises(OutOfRange):
        check(bad)


def test_scopes_and_names(spark, table):
    with strategies.cached(spark.range(3)) as held:
        assert held.is_cached
    assert not held.is_cached
    with strategies.shared(spark, [1, 2]) as value:
        assert value.value == [1, 2]
    for name in halocline.__all__:
        assert getattr(halocline, name) is not None
    out = subprocess.run([sys.executable, "-c", "import sys, halocline; print('pyspark' in sys.modules)"], capture_output=True, text=True, check=True, cwd=halocline.__path__[0] + "/..")
    assert out.stdout.strip() == "False"


def test_recommended_strategies(table):
    x, df = table
    for name, k, want in (("se", 5, "accelerated"), ("se", 4, "crossJoin"), ("spherical", 999, "crossJoin"), ("spherical", 1000, "adaptive"), ("kl", 3, "adaptive")):
        assert divergences.traits(name).assignment(k) == want
    assert [divergences.traits(n).broadcast_below for n in ("se", "l1", "kl")] == [1000, 800, 500]
