"""Death-index matching and cause classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import DEATH_PATTERN_ASCVD, DEATH_PATTERN_TOTAL_CVD
from ..functions.dates import date_from_parts
from ..schemas import DEATH_KEYS
from ..storage import written
from .skew import ROWS_PER_SPLIT, join_both_split


def any_column_matches(df: DataFrame, prefix: str, pattern: str) -> Column:
    """True when a column whose name starts with ``prefix`` matches the pattern."""
    hit = F.lit(False)
    for name in df.columns:
        if name.startswith(prefix):
            hit = hit | F.coalesce(F.col(name).rlike(pattern), F.lit(False))
    return hit


def match_deaths(
    manifest: DataFrame, causes: DataFrame, patients: DataFrame, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """(pat_id, death_date, death_cause) of every confirmed death-index match.

    A record number that many patients and many index entries share, such as a
    placeholder, matches each with each; both sides are split for it.

    The label is exclusive: ``ascvd`` wins over ``total cvd``, which is left for
    heart failure alone; every other cause is ``other``.
    """
    # written, since the split joins take their rows from files
    confirmed = written(manifest.where(F.col("ndi_status_code") == "1").select(*DEATH_KEYS).distinct(), "confirmed")
    people = written(patients.select("pat_id", "pat_mrn_id").distinct(), "numbers")
    matched = written(join_both_split(confirmed, people, ["pat_mrn_id"], rows_per_split), "matched")
    label = (
        F.when(any_column_matches(causes, "ndi_cause", DEATH_PATTERN_ASCVD), "ascvd")
        .when(any_column_matches(causes, "ndi_cause", DEATH_PATTERN_TOTAL_CVD), "total cvd")
        .otherwise("other")
    )
    return join_both_split(causes, matched, DEATH_KEYS, rows_per_split).select(
        "pat_id",
        date_from_parts(
            F.col("ndi_year_death_full"), F.col("ndi_month_death"), F.col("ndi_day_death")
        ).alias("death_date"),
        label.alias("death_cause"),
    )
