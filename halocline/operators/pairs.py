"""All pairs of rows within groups, in blocks: what a task holds is bounded, and the pairs of blocks are dealt over the executors.

The work grows with the square of a group; the rows sent with its number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, and at least where a group has more than one; blocks a group is cut into if that keeps them in these limits.
BLOCK_MOST, BLOCK_LEAST, BLOCKS = 32_768, 1024, 12
#: Rows and columns of a tile, which is all that is held of a matrix; partitions that pairs of blocks are dealt to.
TILE, PARTS = 512, 256

#: (left points, right points, whether they are the same block, rows of the left, rows of the right) -> rows of the result
Reduce = Callable[[np.ndarray, np.ndarray, bool, pa.Table, pa.Table], pa.Table]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by a matrix product; those it would blur (near or not finite) from their differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        sizes = (x * x).sum(1)[:, None] + (y * y).sum(1)
        out = sizes - 2 * (x @ y.T)
        i, j = np.nonzero(~(out >= 1e-6 * sizes) | ~np.isfinite(out))
        for at in range(0, len(i), TILE * TILE // 16):
            a, b = i[at : at + TILE * TILE // 16], j[at : at + TILE * TILE // 16]
            out[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return out


def tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, TILE):
        for j in range(0, m, TILE):
            yield slice(i, min(i + TILE, n)), slice(j, min(j + TILE, m))


def block_pairs(df: DataFrame, reduce: Reduce, schema: str) -> DataFrame:
    """``reduce`` over every pair of blocks of the rows (g, id, x, more columns) of one g; rows of one id share a block.

    A pair of different blocks comes once, so ``reduce`` gives the results of both sides. Points of different lengths do
    not meet; null points and points that hold nulls are left out.
    """
    rows = df.where(F.col("x").isNotNull() & ~F.exists("x", F.isnull)).withColumn("dim", F.size("x"))
    n = F.count("*")
    parts = F.greatest(F.least(F.lit(BLOCKS), F.ceil(n / BLOCK_LEAST)), F.ceil(n / BLOCK_MOST)).cast("int")
    rows = rows.join(rows.groupBy("g", "dim").agg(parts.alias("parts")), ["g", "dim"]).withColumn("b", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("b", "o"), "hi": F.greatest("b", "o")}).drop("parts", "o")
    key = ["g", "dim", "lo", "hi"]

    def each(table: pa.Table) -> pa.Table:
        b, lo, hi = table["b"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
        sides = []
        for side in {lo: 0, hi: 1}:
            own = table.filter(pa.array(b == side)).combine_chunks()
            x = own["x"].combine_chunks() if own["x"].num_chunks != 1 else own["x"].chunk(0)
            sides.append((x.flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, table["dim"][0].as_py()), own))
        (x, left), (y, right) = sides[0], sides[-1]
        return reduce(x, y, lo == hi, left, right)

    return rows.repartition(PARTS, *key).groupBy(*key).applyInArrow(each, schema)
