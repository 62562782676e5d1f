"""Running totals and ranks over a whole table without a one-task sort.

Values are put into quantile buckets; bucket totals (a bounded, tiny table) are
accumulated and broadcast, and only the order inside a bucket is worked out row by
row.  Callers first collapse equal values into one cell, so a value shared by a
third of all rows is a single row here.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, eight at least."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_digits(df: DataFrame) -> int:
    """Leading hex digits of a hash that make at least sixteen even buckets per wanted one."""
    return len(f"{bucket_count(df) * 16 - 1:x}")


def bucket_edges(df: DataFrame, columns, buckets: int | None = None) -> list[list[float]]:
    """Approximate quantiles of each column, computed in one pass (bounded result)."""
    n = buckets or bucket_count(df)
    found = df.approxQuantile(list(columns), [i / n for i in range(1, n)], 1 / (4 * n))
    return [sorted(set(edges)) for edges in found]


def in_buckets(df: DataFrame, column: str, edges: list[float], name: str = "_bucket") -> DataFrame:
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)


def running_sums(
    cells: DataFrame, order: str, sums, edges: list[float] | None, within=(), bucket: str = "_bucket",
    many_groups: bool = False,
) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over cells with a smaller ``order``.

    ``cells`` hold each (within, order) once; ``within`` names few groups, unless
    ``many_groups`` says otherwise.  With ``edges`` None the cells already carry ``bucket``.
    """
    within = list(within)
    placed = cells if edges is None else in_buckets(cells, order, edges, bucket)
    totals = placed.groupBy(*within, bucket).agg(*[F.sum(s).alias(s) for s in sums])
    # A row per bucket and group: no group has more of them than there are buckets.
    groups = within or [F.lit(0)]
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within, bucket, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_offset_{s}") for s in sums]
    )
    inside = (
        Window.partitionBy(*within, bucket).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.withColumns(
        {f"_inside_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}
    )
    # few groups make a small table; many are joined where their cells already are
    joined = local.join(offsets if many_groups else F.broadcast(offsets), [*within, bucket])
    return joined.withColumns(
        {f"before_{s}": F.col(f"_offset_{s}") + F.col(f"_inside_{s}") for s in sums}
    ).drop(bucket, *[f"_offset_{s}" for s in sums], *[f"_inside_{s}" for s in sums])


def later_sums(
    cells: DataFrame, order: str, sums, edges: list[float], within=(), many_groups: bool = False
) -> DataFrame:
    """Add ``later_<s>``: the total of ``s`` over cells with a greater ``order``.

    It is added up from the far end, so that small totals keep their digits.
    """
    turned = cells.withColumn("_down", -F.col(order))
    placed = running_sums(turned, "_down", sums, [-e for e in reversed(edges)], within, many_groups=many_groups)
    return placed.withColumnsRenamed({f"before_{s}": f"later_{s}" for s in sums}).drop("_down")


def shuffle_key(subject: Column, seed: int = 0) -> Column:
    """Reproducible pseudo-random text key of a subject."""
    return F.md5(F.concat(subject.cast("string"), F.lit(f"|{seed}")))


def random_rank(rows: DataFrame, subject: str, within=(), seed: int = 0) -> DataFrame:
    """Add ``random_rank``: 1-based place of each row in a reproducible random order.

    Hashing spreads the rows evenly over buckets, whose number follows the session's
    partitions, so no bucket is hot even if all rows share one ``within`` group.
    ``within`` names few groups.
    """
    within, digits = list(within), hash_digits(rows)
    keyed = rows.withColumn("_key", shuffle_key(F.col(subject), seed))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    totals = keyed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    groups = within or [F.lit(0)]
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row per bucket and group.
    offsets = totals.select(
        *within, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*within, "_bucket").orderBy("_key", subject)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), [*within, "_bucket"])
        .withColumn("random_rank", F.col("_offset") + F.col("_inside"))
        .drop("_key", "_bucket", "_inside", "_offset")
    )
