"""Clustering analytics and training-data operators on Spark DataFrames. Names below are imported when first used."""

from importlib import import_module
from typing import Any

_HOMES = {
    "halocline.plans.estimators": ["BalancedKMeans", "BisectingKMeans", "BregmanMixture", "CentreModel", "CoresetKMeans", "DPMeans", "KMeans", "MiniBatchKMeans", "MultiViewKMeans", "RobustKMeans", "SoftKMeans", "View", "XMeans"],
    "halocline.plans.bounded": ["Agglomerative", "KMedoids", "KernelKMeans", "SpectralClustering", "TimeSeriesKMeans"],
    "halocline.plans.constrained": ["ConstrainedKMeans"],
    "halocline.plans.sampled": ["Clara", "HardBalancedKMeans", "NystromSpectral"],
    "halocline.plans.sparse": ["SparseKMeans"],
    "halocline.plans.tabular": ["CoClustering", "InformationBottleneck"],
    "halocline.plans.config": ["Config"],
    "halocline.streaming.kmeans": ["StreamingKMeans"],
    "halocline.functions.divergences": ["Divergence"],
    "halocline.functions.transforms": ["Transform"],
    "halocline.operators.update": ["Membership"],
    "halocline.plans.strategies": ["Update"],
}
_WHERE = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(f"module 'halocline' has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
