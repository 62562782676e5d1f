"""Discrimination: area under the ROC curve and Harrell's concordance index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import BY, Z95, followed
from .fits import fitted_direction
from .ranking import bucket_edges, later_sums, running_sums


def auc(rows: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """AUC with DeLong's 95 % interval per series.

    Equal risks count one half.  If the controls' median risk is above the cases',
    the ROC curve is read the other way round, so that the AUC refers to the
    direction the medians suggest.  ``edges`` are cuts of the risk, worked out here if
    not given.
    """
    edges = bucket_edges(rows, ["risk"])[0] if edges is None else edges
    cells = rows.groupBy(BY, "risk").agg(
        F.sum("outcome").alias("n1"), F.sum(1 - F.col("outcome")).alias("n0")
    )
    placed = running_sums(cells, "risk", ["n1", "n0"], edges, [BY])
    totals = rows.groupBy(BY).agg(
        F.sum("outcome").alias("cases"), F.sum(1 - F.col("outcome")).alias("controls")
    )
    counted = placed.join(F.broadcast(totals), [BY])  # one row per series

    def at_position(k, n, position):
        """Risk of the row at a 1-based position among cases or controls."""
        here = (F.col(f"before_{n}") < position) & (position <= F.col(f"before_{n}") + F.col(n))
        return F.max(F.when(here, F.col("risk")))

    def median(k, n):
        size = F.col(k)
        return (at_position(k, n, F.ceil(size / 2)) + at_position(k, n, F.floor(size / 2) + 1)) / 2

    below = (F.col("before_n0") + F.col("n0") / 2) / F.col("controls")
    above = 1 - (F.col("before_n1") + F.col("n1") / 2) / F.col("cases")
    sums = counted.groupBy(BY, "cases", "controls").agg(
        F.sum(F.col("n1") * below).alias("s1"),
        F.sum(F.col("n1") * below * below).alias("q1"),
        F.sum(F.col("n0") * above * above).alias("q0"),
        median("cases", "n1").alias("m1"),
        median("controls", "n0").alias("m0"),
    )
    n1, n0 = F.col("cases").cast("double"), F.col("controls").cast("double")
    raw = F.try_divide("s1", n1)
    part1 = F.try_divide(F.col("q1") - n1 * F.col("raw") * F.col("raw"), (n1 - 1) * n1)
    part0 = F.try_divide(F.col("q0") - n0 * F.col("raw") * F.col("raw"), (n0 - 1) * n0)
    spread = Z95 * F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    return (
        sums.withColumn("raw", raw)
        .withColumn("variance", part1 + part0)
        .withColumn("auc", F.when(F.col("m0") <= F.col("m1"), F.col("raw")).otherwise(1 - F.col("raw")))
        .select(
            BY, "cases", "controls", "auc",
            F.greatest(F.col("auc") - spread, F.lit(0.0)).alias("auc_low"),
            F.least(F.col("auc") + spread, F.lit(1.0)).alias("auc_high"),
        )
    )


def concordance(
    rows: DataFrame, as_fitted: bool = True, edges: tuple[list[float], list[float]] | None = None
) -> DataFrame:
    """Harrell's c-index per series.

    A pair is usable when one member has an event and the other is followed
    strictly longer; it is concordant when the event member has the higher
    predictor, and an equal risk counts one half.  The predictor is the risk as a
    Cox model would use it: reversed if its coefficient came out negative.  With
    ``as_fitted`` False it is the risk itself.

    Pairs are never formed.  With risks replaced by their rank, the ranks below
    ``r`` are the disjoint union of one dyadic block per set bit of ``r``; each
    cell is counted in its blocks and each event reads the blocks below it.  Inside
    a block, who is followed longer is counted over buckets of time first and then
    inside a bucket, so no task holds a whole block, whatever the times look like.
    ``edges`` are cuts of risk and follow-up time, worked out here if not given.
    """
    rows = followed(rows)
    edges, times = edges or bucket_edges(rows, ["risk", "years"])
    cells = rows.groupBy(BY, "risk", "years").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("d")
    )
    scores = rows.groupBy(BY, "risk").agg(F.lit(1).cast("bigint").alias("one"))
    ranks = running_sums(scores, "risk", ["one"], edges, [BY]).select(
        BY, "risk", F.col("before_one").alias("rank")
    )
    levels = max(1, scores.count().bit_length())  # every rank is below this power of two
    ranked = cells.join(ranks, [BY, "risk"])

    blocks = (
        ranked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        .withColumn("bit", F.expr("shiftright(rank, level) & 1"))
        .withColumn("block", F.expr("shiftright(rank, level)") - F.col("bit"))
        .groupBy(BY, "level", "block", "years")
        .agg(
            F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n"),
            F.sum(F.when(F.col("bit") == 1, F.col("d")).otherwise(0)).alias("d"),
        )
    )
    whole = cells.groupBy(BY, "years").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))

    def pairs(table: DataFrame, keys, name: str) -> DataFrame:
        """Events times the members of the same group followed strictly longer."""
        placed = later_sums(table, "years", ["n"], times, keys, many_groups=len(keys) > 1)
        found = F.col("d") * F.col("later_n").cast("double")
        return placed.groupBy(BY).agg(F.sum(found).alias(name))

    counted = (
        pairs(whole, [BY], "usable")
        .join(pairs(blocks, [BY, "level", "block"], "below"), [BY], "left")
        .join(pairs(cells, [BY, "risk"], "tied"), [BY], "left")
    )
    concordant = F.col("below")
    if as_fitted:
        counted = counted.join(fitted_direction(rows, times), [BY], "left")
        above = F.col("usable") - F.col("below") - F.col("tied")
        concordant = F.when(F.col("direction") < 0, above).otherwise(F.col("below"))
    return (
        counted.withColumn("concordant", concordant)
        .withColumn(
            "cindex", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("usable"))
        )
        .select(BY, "usable", "concordant", "tied", "cindex")
    )
