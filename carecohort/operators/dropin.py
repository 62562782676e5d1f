"""Treatment drop-in: statin starts during follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import plus_years


def statin_drop_in(
    people: DataFrame, model: str, outcome: str, within_years: int | None = None
) -> DataFrame:
    """Patients whose first statin falls on or before the end of follow-up.

    ``within_years`` first keeps patients with a statin within that many years of
    the index visit; the end of follow-up itself is not shortened.
    """
    if within_years is not None:
        limit = plus_years(F.col("contact_date"), within_years)
        people = people.where(F.col("statin_first_date") <= limit)
    started = F.col("statin_first_date") <= F.col(f"{outcome}_followup_end_date")
    return (
        people.withColumn("model", F.lit(model))
        .groupBy("model")
        .agg(F.sum(F.coalesce(started, F.lit(False)).cast("bigint")).alias("drop_in_count"))
    )
