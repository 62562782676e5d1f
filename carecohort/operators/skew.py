"""Joining rows to a one-row-per-key lookup when a few keys hold most rows.

One patient, encounter or certificate may own a third of a table.  Such keys are
found by a pre-aggregated count, their rows are spread over several splits, and
the lookup row is repeated once per split.  Every other key is joined as usual,
and the result is the plain join's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 1_000_000
# A key is hot if it holds more than ROWS_PER_SPLIT rows and more than one in so many of the
# rows of all such keys.  Fewer keys than this number can, however large the table.
SHARES = 4096

_SPLIT = "_split"


def hot_keys(rows: DataFrame, keys, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The hot keys with the number of splits each needs: fewer than ``SHARES`` rows."""
    large = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > rows_per_split) & _known(keys))
    )
    # one row per rows_per_split rows of the table at most
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    return (
        large.withColumn("_limit", F.greatest(F.lit(rows_per_split), total / SHARES))
        .where(F.col("_n") > F.col("_limit"))
        .select(*keys, F.ceil(F.col("_n") / F.col("_limit")).cast("bigint").alias("_splits"))
    )


def _known(keys):
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys,
    how: str = "inner",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` on ``keys`` with hot keys split (inner or left).

    The split number is a hash of the row's place in its partition, so repeated rows
    are split as well.  ``rows`` should be read from files (or projected or filtered from
    them): then a re-run task finds the same rows in the same places.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = list(keys)
    hot = F.broadcast(hot_keys(rows, keys, rows_per_split))  # < SHARES rows
    place = F.xxhash64("_place")
    # Rows without a key match nothing; a left join keeps them, spread out.
    split = F.when(_known(keys), F.pmod(place, F.coalesce("_splits", F.lit(1)))).otherwise(place)
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    spread = placed.join(hot, keys, "left").withColumn(_SPLIT, split).drop("_splits", "_place")
    repeated = (
        lookup.join(hot, keys, "left")
        .withColumn(_SPLIT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_splits", F.lit(1)) - 1)))
        .drop("_splits")
    )
    return spread.join(repeated, [*keys, _SPLIT], how).drop(_SPLIT)


def join_both_split(left: DataFrame, right: DataFrame, keys, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Inner join of two tables that may both hold a third of their rows under one key.

    A key that is hot on a side is cut into as many parts there as it needs, and the other
    side's rows of that key are repeated once per part: the pairs of a hot key are worked out
    in a grid of parts, each task holding one part of either side.  Both tables should be
    read from files, as in ``join_lookup``.
    """
    keys = list(keys)
    mine = hot_keys(left, keys, rows_per_split).withColumnRenamed("_splits", "_left_parts")
    theirs = hot_keys(right, keys, rows_per_split).withColumnRenamed("_splits", "_right_parts")
    grid = F.broadcast(mine.join(theirs, keys, "full"))  # < 2 * SHARES rows

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        parts = lambda side: F.coalesce(f"_{side}_parts", F.lit(1).cast("bigint"))
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts(own))
        return (
            df.where(_known(keys)).join(grid, keys, "left").withColumn(f"_{own}", place)
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), parts(other) - 1)))
            .drop("_left_parts", "_right_parts")
        )

    parts = ["_left", "_right"]
    return dealt(left, "left", "right").join(dealt(right, "right", "left"), [*keys, *parts]).drop(*parts)


ROWS_PER_STEP = 4096


def numbered_copies(df: DataFrame, count: str, name: str, spread_by=None) -> DataFrame:
    """Repeat each row ``count`` times, numbered from 0 in ``name``.

    Works in two steps so that no single row ever builds an array of ``count``
    entries; with ``spread_by`` the steps are spread over the cluster in between.
    """
    n, step = F.col(count).cast("bigint"), F.lit(ROWS_PER_STEP).cast("bigint")
    starts = df.where(n > 0).withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, step))
    )
    if spread_by:
        starts = starts.repartition(*spread_by, "_start")
    last = F.least(F.col("_start") + step, n) - 1
    return starts.withColumn(name, F.explode(F.sequence(F.col("_start"), last))).drop("_start")
