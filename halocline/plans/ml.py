"""Estimators as stages of ``pyspark.ml`` pipelines: every setting is a Param; stages and pipelines can be written and read."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from halocline.plans.estimators import CentreModel, KMeans
from halocline.sources import persistence


class _Writer(MLWriter):
    """The metadata that pipelines expect, and beside it what the stage wraps."""

    def __init__(self, stage: ClusterStage | FittedStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        persistence.save(self.stage.wrapped(), self.sparkSession, f"{path}/wrapped")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return self.kind(persistence.load(self.sparkSession, f"{path}/wrapped"))._resetUid(meta["uid"])


class _Stage(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class ClusterStage(Estimator, _Stage):
    """An estimator with its settings as Params of the same names, so that grids and ``fit(df, params)`` can set them."""

    def __init__(self, estimator: KMeans):
        super().__init__()
        self.kind = type(estimator)
        for f in fields(estimator):
            if f.name == "scores":  # the history of a fit
                continue
            value = getattr(estimator, f.name)
            setattr(self, f.name, Param(self, f.name, f"{f.name} of {self.kind.__name__}"))
            self._setDefault(**{f.name: value.tolist() if isinstance(value, np.ndarray) else value})

    def wrapped(self) -> KMeans:
        """The estimator with the settings as they are now; bad ones raise here."""
        own = {p.name: self.getOrDefault(p) for p in self.params}
        if own.get("initial_centres") is not None:
            own["initial_centres"] = np.array(own["initial_centres"], dtype=float)
        return self.kind(**own)

    def _fit(self, dataset: DataFrame) -> FittedStage:
        return FittedStage(self.wrapped().fit(dataset))


class FittedStage(Model, _Stage):
    """A fitted model; ``transform`` appends the model's columns."""

    def __init__(self, model: CentreModel):
        super().__init__()
        self.model = model

    def wrapped(self) -> CentreModel:
        return self.model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)
