"""Characteristics of the analysis sets, overall and by outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import number_text
from .ranking import bucket_edges, running_sums

CONTINUOUS = ("age_yrs", "hdl_chol", "total_chol", "systolic_bp", "egfr")
CATEGORICAL = ("sex", "raceth", "insurance")
YES_NO = (
    "current_smoker_flag", "current_hypertensive_med_flag", "diabetes_flag", "hypertension_flag",
    "dyslipidemia_flag",
)

LABELS = {
    "age_yrs": "Age (yrs)",
    "sex": "Sex",
    "raceth": "Race/Ethnicity",
    "insurance": "Insurance",
    "current_smoker_flag": "Current smoker",
    "current_hypertensive_med_flag": "Current treatment for hypertension",
    "diabetes_flag": "Diabetes",
    "hypertension_flag": "Hypertension",
    "dyslipidemia_flag": "Dyslipidemia",
    "hdl_chol": "HDL cholesterol",
    "total_chol": "Total cholesterol",
    "systolic_bp": "Systolic blood pressure",
    "egfr": "Estimated GFR",
}


def grouped(people: DataFrame, outcome: str, label: str) -> DataFrame:
    """Every patient once under ``Overall`` and once under the outcome group."""
    side = F.when(F.col(outcome) == 1, f"Incident {label}").when(
        F.col(outcome) != 1, f"No {label}"
    )
    groups = F.array_compact(F.array(F.lit("Overall"), side))
    return people.select(
        *[F.col(c) for c in (*CONTINUOUS, *CATEGORICAL, *YES_NO)], F.explode(groups).alias("group")
    )


def continuous(groups: DataFrame) -> DataFrame:
    """Number known, median and quartiles of each measurement and group.

    A quantile is the value at position ``n*p``, averaged with the next one when
    ``n*p`` is whole.  Positions are found from running counts of distinct values.
    """
    values = groups.select("group", *[F.col(c).cast("double").alias(c) for c in CONTINUOUS])
    edges = bucket_edges(values, CONTINUOUS)
    long = values.select(
        "group",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in CONTINUOUS])
        ).alias("_v"),
    ).select("group", "_v.*").where(F.col("value").isNotNull())
    cells = long.groupBy("group", "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    pooled = sorted({e for cuts in edges for e in cuts})
    placed = running_sums(cells, "value", ["n"], pooled, ["group", "variable"])
    totals = cells.groupBy("group", "variable").agg(F.sum("n").alias("known"))

    def at(position):
        here = (F.col("before_n") < position) & (position <= F.col("before_n") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    def quantile(p: float):
        spot = F.col("known") * p
        return (at(F.ceil(spot)) + at(F.floor(spot) + 1)) / 2

    return placed.join(F.broadcast(totals), ["group", "variable"]).groupBy(  # 15 rows
        "group", "variable", "known"
    ).agg(
        quantile(0.5).alias("median"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3")
    )


def categorical(groups: DataFrame) -> DataFrame:
    """Count and percentage of each level among known values, all variables in one pass.

    Of a yes/no variable only "yes" is reported.
    """
    levels = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in (*CATEGORICAL, *YES_NO)]
    )
    counts = (
        groups.select("group", F.explode(levels).alias("_l")).select("group", "_l.*")
        .where(F.col("level").isNotNull())
        .groupBy("group", "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("group", "variable").agg(F.sum("n").alias("known"))
    return (
        counts.join(F.broadcast(totals), ["group", "variable"])  # 24 rows
        .where(~F.col("variable").isin(*YES_NO) | (F.col("level") == "1"))
        .withColumn("percent", F.lit(100.0) * F.col("n") / F.col("known"))
    )


def missing(groups: DataFrame) -> DataFrame:
    """Number of unknown values of each variable and group, in one pass."""
    names = (*CONTINUOUS, *CATEGORICAL, *YES_NO)
    counts = groups.groupBy("group").agg(
        *[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in names]
    )
    return counts.unpivot(["group"], list(names), "variable", "unknown")


def _percent_text() -> Column:
    """Whole percent from 10 on, one decimal below, tiny shares as ``<0.1``."""
    p = F.col("percent")
    rounded = F.when(p >= 10, F.round(p)).otherwise(F.round(p, 1))
    return F.when((p > 0) & (p < 0.1), "<0.1").otherwise(number_text(rounded))


def table_one(people: DataFrame, outcome: str, label: str, digits: int = 0) -> DataFrame:
    """Report table: one row per variable and level, one text column per group."""
    groups = grouped(people, outcome, label)
    median, q1, q3 = (number_text(F.round(c, digits)) for c in ("median", "q1", "q3"))
    medians = continuous(groups).select(
        "group", "variable", F.lit(0).alias("part"), F.lit("").alias("level"),
        F.concat(median, F.lit(" ("), q1, F.lit(", "), q3, F.lit(")")).alias("text"),
    )
    shares = categorical(groups).select(
        "group", "variable", F.lit(0).alias("part"),
        F.when(F.col("variable").isin(*YES_NO), "").otherwise(F.col("level")).alias("level"),
        F.concat(F.col("n").cast("string"), F.lit(" ("), _percent_text(), F.lit("%)")).alias("text"),
    )
    unknown = missing(groups).where(F.col("unknown") > 0).select(
        "group", "variable", F.lit(1).alias("part"), F.lit("Unknown").alias("level"),
        F.col("unknown").cast("string").alias("text"),
    )
    names = list(LABELS)
    place = F.array_position(F.array(*[F.lit(v) for v in names]), F.col("variable"))
    label_of = F.element_at(F.array(*[F.lit(LABELS[v]) for v in names]), place.cast("int"))
    columns = ["Overall", f"Incident {label}", f"No {label}"]
    return (
        medians.unionByName(shares).unionByName(unknown)
        .groupBy("variable", "part", "level").pivot("group", columns).agg(F.first("text"))
        .select(place.cast("int").alias("position"), "variable", label_of.alias("label"), "part", "level", *columns)
        .orderBy("position", "part", "level")
    )
