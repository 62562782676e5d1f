"""Calibration: expected and observed cases, binned curves, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import significant
from .evaluation import BY
from .ranking import bucket_edges, random_rank, running_sums


def expected_observed(rows: DataFrame) -> DataFrame:
    """Expected and observed cases and risks, and calibration-in-the-large, per series.

    Expected cases come from the risk already rounded to two digits.
    """
    return (
        rows.groupBy(BY)
        .agg(
            F.count(F.lit(1)).alias("n_used"),
            significant(F.avg("risk"), 2).alias("expected_risk"),
            F.sum("outcome").alias("observed_cases"),
            significant(F.avg("outcome"), 2).alias("observed_risk"),
        )
        .withColumn("expected_cases", F.ceil(F.col("expected_risk") * F.col("n_used")))
        .withColumn(
            "in_the_large",
            significant(F.try_divide("expected_risk", "observed_risk"), 2),
        )
    )


def _bin_limits(rows: DataFrame, nbins: int) -> DataFrame:
    """Where bins end: (series, risk, bin, take) for the last row of every bin but the last.

    ``take`` is how many rows sharing that risk still belong to the bin.  At most
    ``nbins - 1`` rows per series.
    """
    edges = bucket_edges(rows, ["risk"])[0]
    cells = rows.groupBy(BY, "risk").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(cells, "risk", ["n"], edges, [BY])
    size = rows.groupBy(BY).agg(F.count(F.lit(1)).alias("total"))
    bins = F.explode(F.sequence(F.lit(1), F.lit(nbins - 1)))
    # the first (total mod nbins) bins hold one row more
    base, extra = F.floor(F.col("total") / nbins), F.col("total") % nbins
    ends = size.withColumn("bin", bins).withColumn(
        "end", F.col("bin") * base + F.least(F.col("bin"), extra)
    )
    inside = (F.col("before_n") < F.col("end")) & (F.col("end") <= F.col("before_n") + F.col("n"))
    return (
        placed.join(F.broadcast(ends), [BY])
        .where(inside)
        .select(BY, "risk", "bin", (F.col("end") - F.col("before_n")).alias("take"))
    )


def risk_bins(rows: DataFrame, nbins: int = 10, seed: int = 0) -> DataFrame:
    """Add ``bin``: equal-sized risk groups; rows tied across a limit are split at random.

    Bins are found from risk cells.  Only rows sharing one of the few limit risks
    need a rank, a reproducible random one, so no global sort takes place.
    """
    limits = _bin_limits(rows, nbins).collect()  # at most nbins - 1 rows per series
    if not limits:
        return rows.withColumn("bin", F.lit(1))
    tied, above = F.lit(False), F.lit(1)
    cut = F.lit(0)
    for r in limits:
        here = F.col(BY) == r[BY]
        tied = tied | (here & (F.col("risk") == r["risk"]))
        above = above + F.when(here & (F.col("risk") > r["risk"]), 1).otherwise(0)
        cut = cut + F.when(
            here & (F.col("risk") == r["risk"]) & (F.col("random_rank") > r["take"]), 1
        ).otherwise(0)
    plain = rows.where(~tied).withColumn("bin", above)
    split = random_rank(rows.where(tied), "pat_id", [BY, "risk"], seed)
    return plain.unionByName(split.withColumn("bin", above + cut).drop("random_rank"))


def binned_calibration(rows: DataFrame, nbins: int = 10, seed: int = 0) -> DataFrame:
    """Mean predicted against observed risk per bin, with a clamped 95 % interval."""
    se = F.sqrt(F.col("observed") * (1 - F.col("observed")) / F.col("n"))
    return (
        risk_bins(rows, nbins, seed)
        .groupBy(BY, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("risk").alias("predicted"),
            F.avg("outcome").alias("observed"),
        )
        .withColumn("se", se)
        .withColumn("high", F.col("observed") + 1.96 * F.col("se"))
        .withColumn("low", F.greatest(F.col("observed") - 1.96 * F.col("se"), F.lit(0.0)))
    )


def risk_histogram(rows: DataFrame, width: float) -> DataFrame:
    """Counts and shares of risks in bins ``(k*width, (k+1)*width]``; 0 is in the first.

    A risk within a hundred-millionth of a bin above a limit still counts below it.
    """
    position = F.ceil(F.col("risk") / F.lit(float(width)) - 1e-8)
    counts = (
        rows.withColumn("bin", F.greatest(position, F.lit(1)).cast("int"))
        .groupBy(BY, "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = rows.groupBy(BY).agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(F.broadcast(totals), [BY]).select(  # one row per series
        BY, "bin", ((F.col("bin") - 1) * width).alias("start"), "n",
        (F.col("n") / F.col("_total")).alias("share"),
    )
