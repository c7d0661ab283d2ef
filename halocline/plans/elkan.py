"""Lloyd's loop for squared Euclidean distance with bounds carried from round to round.

A row keeps its cluster, an upper bound of the distance to its centre and a lower bound of that to any other (Hamerly's
form of Elkan's bounds). A row whose bounds do not meet after the centres' moves is not measured again. The results are
those of ``lloyd``; the state costs a write each round, so this pays only for many centres of many dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions import divergences
from halocline.operators.assign import features_of, stack
from halocline.operators.graph import cut
from halocline.operators.update import added_up
from halocline.plans.lloyd import LloydResult

#: Clusters from which on the bounds can spare distances.
BOUNDED_FROM = 5
STATE = "x array<double>, w double, c int, upper double, lower double"


def measure(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, distance, distance to the second nearest)."""
    d = np.sqrt(2 * divergences.make("se").matrix(x, centres))
    c = d.argmin(1)
    near = d[np.arange(len(x)), c]
    d[np.arange(len(x)), c] = np.inf
    return c, near, d.min(1)


def bounded_lloyd(df: DataFrame, features: str, centres: np.ndarray, max_iter: int = 20, tol: float = 1e-4, weight: str | None = None) -> LloydResult:
    """Empty clusters keep their centres. ``distortion`` stays empty: rows that are skipped have bounds, not distances."""
    r = LloydResult(np.asarray(centres, dtype=float), 0)
    state = df.select(features_of(df, features).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.lit(-1).alias("c"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    moves = np.zeros(len(centres))
    for _ in range(max_iter):
        now = r.centres
        apart = np.sqrt(2 * divergences.make("se").matrix(now, now))
        np.fill_diagonal(apart, np.inf)
        half = apart.min(1) / 2

        def step(batches: Iterator[pd.DataFrame], now: np.ndarray = now, half: np.ndarray = half, moves: np.ndarray = moves) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                c, upper, lower = b["c"].to_numpy().copy(), b["upper"].to_numpy().copy(), b["lower"].to_numpy().copy()
                old = c >= 0
                upper[old] += moves[c[old]]
                lower[old] -= moves.max()
                again = ~old | (upper > np.maximum(lower, half[np.maximum(c, 0)]) - 1e-9)
                if again.any():
                    c[again], upper[again], lower[again] = measure(stack(b["x"][again]), now)
                yield b.assign(c=c.astype(np.int32), upper=upper, lower=lower)

        def partial(batches: Iterator[pd.DataFrame], k: int = len(now)) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                if not len(b):
                    continue
                w, x = b["w"].to_numpy(), stack(b["x"])
                if held is None:
                    held = np.zeros((k, 1 + x.shape[1]))
                np.add.at(held, b["c"].to_numpy(), np.column_stack([w, x * w[:, None]]))
            if held is not None:
                yield pd.DataFrame({"c": np.arange(k, dtype=np.int32), "s": list(held)})

        state = cut(state.mapInPandas(step, STATE))
        sums = added_up(state.select("c", "w", "x").mapInPandas(partial, "c int, s array<double>"), len(now))
        new = now.copy()
        if sums is not None:
            full = sums[:, 0] > 0
            new[full] = sums[full, 1:] / sums[full, :1]
        moves = np.sqrt(((new - now) ** 2).sum(1))
        r.centres, r.iterations = new, r.iterations + 1
        r.movement.append(float(moves.max()))
        if moves.max() < tol:
            r.converged = True
            break
    return r
