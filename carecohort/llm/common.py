"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_split(
    rows: DataFrame, lookup: DataFrame, keys: list[str], count: str, spread: Column,
    how: str = "inner", per_split: int = 4096,
) -> DataFrame:
    """Join ``rows`` to a lookup that holds each key once and, in ``count``, its rows.

    ``rows`` must hold the same ``count`` beside the key.  Keys with more than
    ``per_split`` rows are spread by ``spread`` over as many splits as they need, and
    their lookup row is repeated for each.
    """
    splits = F.ceil(F.col(count) / per_split).cast("int")
    left = rows.withColumn("_split", F.pmod(F.xxhash64(spread), F.greatest(splits, F.lit(1))).cast("int"))
    right = lookup.withColumn(
        "_split", F.explode(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)) - 1))
    ).drop(count)
    return left.join(right, [*keys, "_split"], how).drop("_split")


def running_offsets(totals: DataFrame, order: list[str], total: str, name: str, within=()) -> DataFrame:
    """Add the sum of ``total`` over earlier rows of a table of one row per bucket.

    One task per ``within`` reads all its buckets, so buckets must be coarse.
    """
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.withColumn(name, F.coalesce(F.sum(total).over(earlier), F.lit(0)))
