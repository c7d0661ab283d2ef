"""Ready-made settings, the curve of inertia by k, and estimators as JSON."""

from __future__ import annotations

import json
from dataclasses import fields, replace

import numpy as np
from pyspark.sql import DataFrame

from halocline.errors import UnknownName
from halocline.operators.metrics import inertia
from halocline.plans import estimators
from halocline.plans.estimators import KMeans, first_of

#: The settings by name.
PRESETS = {
    "default": {},
    "fast": {"max_iter": 10, "tol": 1e-3},
    "high_quality": {"max_iter": 100, "tol": 1e-6},
    "debug": {"validate": True},
    "production": {"validate": True, "max_iter": 20},
    "text_clustering": {"k": 20, "divergence": "cosine", "max_iter": 30},
    "image_clustering": {"k": 10, "max_iter": 50},
    "topic_modeling": {"k": 50, "divergence": "kl", "max_iter": 100, "tol": 1e-5},
    "anomaly_detection": {"k": 3, "max_iter": 100, "tol": 1e-6},
    "robust": {"k": 5, "divergence": "manhattan", "max_iter": 100, "tol": 1e-6},
    "large_dataset": {"k": 10, "fraction": 0.1, "max_iter": 100},
    "streaming": {"k": 10, "fraction": 0.01, "max_iter": 1000},
}
#: Of these, mini-batches.
MINI_BATCH = ("large_dataset", "streaming")


def preset(name: str, k: int | None = None, **more) -> KMeans:
    """An estimator with the settings of a name; ``k`` and ``more`` go over them."""
    if name not in PRESETS:
        raise UnknownName("preset", name, sorted(PRESETS))
    kind = estimators.MiniBatchKMeans if name in MINI_BATCH else KMeans
    return kind(**{**PRESETS[name], **({} if k is None else {"k": k}), **more})


def elbow_curve(df: DataFrame, features: str, min_k: int = 2, max_k: int = 10, base: KMeans | None = None) -> DataFrame:
    """(k, inertia): squared distances to the clusters' means after a fit for each k. Given centres are used k at a time, from the first."""
    base, rows = base or KMeans(), []
    for k in range(min_k, max_k + 1):
        out = replace(base, k=k, features=features, initial_centres=first_of(base.initial_centres, k)).fit(df).transform(df)
        rows.append((k, float(inertia(out, features, base.prediction).first()[0] or 0.0)))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def to_json(estimator: KMeans) -> str:
    """Name and settings of an estimator; the histories of fits are no settings."""
    kept = {f.name: getattr(estimator, f.name) for f in fields(estimator) if f.name != "scores"}
    return json.dumps({"class": type(estimator).__name__, "settings": {n: v.tolist() if isinstance(v, np.ndarray) else v for n, v in kept.items()}}, sort_keys=True)


def from_json(text: str) -> KMeans:
    data = json.loads(text)
    kind = getattr(estimators, data["class"], None)
    if not (isinstance(kind, type) and issubclass(kind, KMeans)):
        raise ValueError(f"no estimator {data['class']!r}")
    own = data["settings"]
    if own.get("initial_centres") is not None:
        own["initial_centres"] = np.array(own["initial_centres"])
    return kind(**own)
