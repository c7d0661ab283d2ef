"""Models written and read again. Run from the repository's root: python -m examples.round_trips"""

import tempfile

import numpy as np
from pyspark.sql import SparkSession

from halocline import KMeans, MiniBatchKMeans, SoftKMeans, StreamingKMeans, XMeans
from halocline.sources import persistence


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    x = np.random.default_rng(0).random((60, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    live = StreamingKMeans(x[:2])
    live.update(df, 0)
    models = [e.fit(df) for e in (KMeans(k=3), SoftKMeans(k=3), MiniBatchKMeans(k=3, max_iter=5), XMeans(max_k=3))] + [live]
    with tempfile.TemporaryDirectory() as folder:
        for i, model in enumerate(models):
            persistence.save(model, spark, f"{folder}/{i}")
            back = persistence.load(spark, f"{folder}/{i}")
            print(type(back).__name__, np.allclose(back.centres, model.centres))
    spark.stop()


if __name__ == "__main__":
    main()
