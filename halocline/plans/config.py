"""Settings of a fit as a value: changed by copies, checked as a whole, turned into an estimator."""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from halocline.errors import Outcome, OutOfRange, UnknownName, attempt
from halocline.functions import divergences
from halocline.plans import estimators
from halocline.plans.presets import PRESETS
from halocline.plans.strategies import EMPTY
from halocline.telemetry import Log, listen

#: Ways to find the first centres, by name. All distributed seeding is k-means||.
INIT_MODES = {"kmeans++": "k-means||", "k-means||": "k-means||", "random": "random"}


@dataclass(frozen=True)
class Config:
    k: int = 5
    max_iter: int = 20
    tolerance: float = 1e-4
    seed: int = 42
    kernel: str = "squaredEuclidean"
    init_mode: str = "kmeans++"
    features_col: str = "features"
    prediction_col: str = "prediction"
    weight_col: str | None = None
    distance_col: str | None = None
    #: Below 1, mini-batches of this share of all rows.
    mini_batch_fraction: float = 1.0
    reseed_policy: str = "random"
    validate_data: bool = True
    #: Kept for callers; the loop carries no lineage from round to round, so there is nothing to cut.
    checkpoint_interval: int = 10
    #: ``fit`` logs its events.
    enable_telemetry: bool = False

    def but(self, **changes: Any) -> Config:
        """A copy with some settings changed; None takes an optional column away."""
        unknown = sorted(set(changes) - set(asdict(self)))
        if unknown:
            raise UnknownName("setting", unknown[0], sorted(asdict(self)))
        return replace(self, **changes)

    def checked(self) -> Config:
        """Itself, or the error about the first setting that is out of range."""
        wanted = {
            "k": (self.k >= 1, "1 or more"), "max_iter": (self.max_iter >= 1, "1 or more"),
            "tolerance": (self.tolerance >= 0, "0 or more"), "seed": (self.seed >= 0, "0 or more"),
            "mini_batch_fraction": (0 < self.mini_batch_fraction <= 1, "above 0, at most 1"), "checkpoint_interval": (self.checkpoint_interval >= 1, "1 or more"),
        }
        for name, (good, range_) in wanted.items():
            if not good:
                raise OutOfRange(name, getattr(self, name), range_)
        divergences.make(self.kernel)
        for what, name, known in (("init mode", self.init_mode, INIT_MODES), ("reseed policy", self.reseed_policy, EMPTY)):
            if name not in known:
                raise UnknownName(what, name, sorted(known))
        return self

    def validate(self) -> Outcome:
        return attempt(self.checked)

    def estimator(self) -> estimators.KMeans:
        self.checked()
        own = {
            "k": self.k, "divergence": self.kernel, "max_iter": self.max_iter, "tol": self.tolerance, "seed": self.seed, "init_mode": INIT_MODES[self.init_mode],
            "features": self.features_col, "prediction": self.prediction_col, "weight": self.weight_col, "distance": self.distance_col,
            "empty": EMPTY[self.reseed_policy], "validate": self.validate_data,
        }
        return estimators.KMeans(**own) if self.mini_batch_fraction == 1 else estimators.MiniBatchKMeans(**own, fraction=self.mini_batch_fraction)

    def fit(self, df: DataFrame) -> estimators.CentreModel:
        with listen(Log()) if self.enable_telemetry else nullcontext():
            return self.estimator().fit(df)

    @property
    def summary(self) -> str:
        return "\n".join(f"{name}: {value}" for name, value in asdict(self).items() if value is not None)


def from_preset(name: str, **changes: Any) -> Config:
    """The settings of a preset under this module's names."""
    if name not in PRESETS:
        raise UnknownName("preset", name, sorted(PRESETS))
    names = {"divergence": "kernel", "tol": "tolerance", "fraction": "mini_batch_fraction", "validate": "validate_data"}
    return Config().but(**{names.get(n, n): v for n, v in PRESETS[name].items()} | changes)
