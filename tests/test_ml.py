"""Estimators as stages of pipelines."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from halocline.plans import estimators, summary
from halocline.plans.ml import ClusterStage, FittedStage


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.03, (40, 2)) for c in (0.2, 0.5, 0.8)])
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")


def test_pipeline_with_vectors_comes_back(spark, table, tmp_path):
    x, df = table
    stage = ClusterStage(estimators.KMeans(k=3, initial_centres=x[[0, 50, 100]], prediction="c"))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), stage])
    model = pipeline.fit(df)
    want = [r["c"] for r in model.transform(df).orderBy("id").collect()]
    assert want == [0] * 40 + [1] * 40 + [2] * 40
    model.write().overwrite().save(f"file://{tmp_path}/model")
    pipeline.write().overwrite().save(f"file://{tmp_path}/pipeline")
    again = PipelineModel.load(f"file://{tmp_path}/model")
    assert [r["c"] for r in again.transform(df).orderBy("id").collect()] == want
    refit = Pipeline.load(f"file://{tmp_path}/pipeline").fit(df)
    assert np.allclose(refit.stages[1].model.centres, model.stages[1].model.centres)


def test_params(table):
    x, df = table
    points = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    stage = ClusterStage(estimators.BisectingKMeans(k=2, seed=1))
    assert isinstance(stage.fit(points), FittedStage) and stage.fit(points, {stage.k: 3}).model.k == 3
    assert stage.getOrDefault("k") == 2 and stage.copy({stage.k: 5}).wrapped() == estimators.BisectingKMeans(k=5, seed=1)
    with pytest.raises(ValueError):
        stage.fit(points, {stage.k: 0})


def test_summary_file(spark, table, tmp_path):
    x, df = table
    points = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    row = summary.summary_frame(spark, estimators.KMeans(k=3).fit(points), "KMeans", 3, 120, 10)
    summary.write_summary(row, f"file://{tmp_path}/m")
    got, want = summary.read_summary(spark, f"file://{tmp_path}/m").first(), row.first()
    assert got["k"] == 3 and got["distortionHistory"] == want["distortionHistory"] and got["algorithm"] == "KMeans"
