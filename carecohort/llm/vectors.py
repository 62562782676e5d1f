"""Vectors of a table on an integer grid, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grid values beyond this would not fit 64-bit integers with room for sums of two.
LARGEST = 2.0**61


def _usable(vector: Column) -> Column:
    """True for a vector that is not null or empty and holds finite numbers only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def usable_vectors(df: DataFrame, vector_col: str, keep: list[str]) -> tuple[DataFrame, int, int]:
    """Rows with a usable vector, as ``vector`` (doubles) after the ``keep`` columns; their width and number.

    Vectors of another width than most (the larger of equally frequent ones) lie in another
    space and are left out like unusable ones.  Without any usable vector the width is 0.
    """
    rows = df.select(*keep, F.col(vector_col).cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    width = F.size("vector").alias("width")
    most = rows.groupBy(width).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not most:
        return rows.limit(0), 0, 0
    return rows.where(F.size("vector") == most[0]["width"]), most[0]["width"], most[0]["n"]


def on_grid(vectors: pa.Array, width: int, scale: float, shift: int = 0) -> np.ndarray:
    """``floor(scale * x) + shift`` as 64-bit integers, one row per vector."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore"):
        floors = np.floor(values * float(scale))
    if not np.all(np.abs(floors) < LARGEST):
        raise ValueError("a vector's entry is too large for the integer grid")
    return floors.astype(np.int64) + shift
