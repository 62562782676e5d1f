"""The long table all performance measures read.

One row per patient and evaluated series: ``series, pat_id, outcome (0/1), risk,
lp (linear predictor), years (follow-up)``.  A series is one model, or one model
under one misclassification share; there are a dozen at most, so per-series
results always fit on the driver, and all series are evaluated in the same jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import random_rank

BY = "series"
Z95 = 1.959963984540054  # 97.5 % point of the standard normal distribution


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows_for(scored: DataFrame, series: str, outcome: str, risk: str, lp, years) -> DataFrame:
    """Evaluation rows of one model; patients without a risk or outcome are left out.

    ``lp`` and ``years`` are column names or expressions.
    """
    rows = scored.select(
        F.lit(series).alias(BY),
        "pat_id",
        F.col(outcome).cast("int").alias("outcome"),
        F.col(risk).cast("double").alias("risk"),
        _column(lp).cast("double").alias("lp"),
        _column(years).cast("double").alias("years"),
    )
    return rows.where(F.col("risk").isNotNull() & ~F.isnan("risk") & F.col("outcome").isNotNull())


def followed(rows: DataFrame) -> DataFrame:
    """Rows whose follow-up is known; survival measures use no others.

    Observation may end before the index visit: such negative times are follow-up like any other.
    """
    return rows.where(F.col("years").isNotNull() & ~F.isnan("years"))


def with_predictor(rows: DataFrame) -> DataFrame:
    """Rows whose linear predictor is known; fits on it use no others."""
    return rows.where(F.col("lp").isNotNull() & ~F.isnan("lp"))


def misclassified(rows: DataFrame, shares, seed: int = 0) -> DataFrame:
    """Copies of the rows in which a share of the non-cases is counted as cases.

    Per series and share, exactly ``ceil(share * non-cases)`` randomly picked
    non-cases change.  Adds ``share``; ``series`` becomes ``<series>|<share>``.
    """
    controls = rows.where(F.col("outcome") == 0)
    ranked = random_rank(controls, "pat_id", [BY], seed).unionByName(
        rows.where(F.col("outcome") != 0), allowMissingColumns=True
    )
    # One row per series: bounded, broadcast.
    sizes = controls.groupBy(BY).agg(F.count(F.lit(1)).alias("_controls"))
    copies = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    flips = F.col("random_rank") <= F.ceil(F.col("_controls") * F.col("share"))
    return (
        ranked.join(F.broadcast(sizes), [BY], "left")
        .withColumn("share", copies)
        .withColumn("outcome", F.when(flips, 1).otherwise(F.col("outcome")))
        .withColumn(BY, F.concat_ws("|", BY, F.col("share").cast("string")))
        .drop("random_rank", "_controls")
    )
