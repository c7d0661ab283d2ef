"""Streaming k-means: each micro-batch discounts the old weights and pulls the centres towards its means."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from halocline.functions import divergences
from halocline.operators.update import cluster_sums, hard
from halocline.plans.estimators import CentreModel


@dataclass
class StreamingKMeans:
    centres: np.ndarray
    weights: np.ndarray | None = None
    divergence: str = "squaredEuclidean"
    features: str = "features"
    decay: float = 1.0
    half_life: float | None = None
    time_unit: str = "batches"
    weight: str | None = None
    done: set[int] = field(default_factory=set)

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Takes one batch in; a batch id that has been taken in already changes nothing."""
        if batch_id is not None and batch_id in self.done or batch.isEmpty():
            return
        self.weights = np.zeros(len(self.centres)) if self.weights is None else self.weights
        s = cluster_sums(batch, self.features, len(self.centres), hard(self.centres, divergences.make(self.divergence)), lambda x: x, self.weight)
        decay = 0.5 ** (1 / self.half_life) if self.half_life else self.decay
        old = self.weights * (decay if self.time_unit == "batches" else decay ** s.weight.sum())
        pull = s.weight / np.maximum(old + s.weight, 1e-16)
        self.centres = np.where((s.weight > 0)[:, None], (1 - pull)[:, None] * self.centres + pull[:, None] * s.mean(), self.centres)
        self.weights = old + s.weight
        if batch_id is not None:
            self.done.add(batch_id)
        self._split_dying()

    def _split_dying(self) -> None:
        """A centre of hardly any weight takes half of the heaviest."""
        low, high = int(self.weights.argmin()), int(self.weights.argmax())
        if self.weights[low] < 1e-8 * self.weights[high]:
            half = self.weights[high] / 2
            shift = 1e-14 * np.maximum(np.abs(self.centres[high]), 1.0)
            self.centres[low], self.centres[high] = self.centres[high] + shift, self.centres[high] - shift
            self.weights[low] = self.weights[high] = half

    def model(self) -> CentreModel:
        return CentreModel(self.centres, self.divergence, self.features)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """A query that updates this model with every micro-batch."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
