"""Bisecting, soft, spherical and x-means on the same blobs. Run from the repository's root: python -m examples.estimators"""

import numpy as np
from pyspark.sql import SparkSession

from halocline import BisectingKMeans, KMeans, SoftKMeans, XMeans


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    rng = np.random.default_rng(0)
    rows = [((rng.normal(0, 0.2, 2) + c).tolist(),) for c in ([1.0, 1.0], [6.0, 1.0], [1.0, 8.0]) for _ in range(40)]
    df = spark.createDataFrame(rows, "features array<double>")
    for name, estimator in {"bisecting": BisectingKMeans(k=3), "soft": SoftKMeans(k=3, beta=2.0), "spherical": KMeans(k=3, divergence="spherical"), "x-means": XMeans(max_k=5)}.items():
        model = estimator.fit(df)
        print(name, np.round(model.centres, 2).tolist())
        model.transform(df).groupBy("prediction").count().orderBy("prediction").show()
    spark.stop()


if __name__ == "__main__":
    main()
