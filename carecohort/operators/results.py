"""Laboratory results that the cohort reads, cleaned once for all their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.clean import result_value

VALUE = "result_value"
WATCHED = tuple(dict.fromkeys((
    *codes.HDL, *codes.LDL, *codes.TOTAL_CHOLESTEROL,
    *(c for components, _ in codes.DYSLIPIDEMIA_LIMITS for c in components),
    *codes.EGFR_ANYONE, *codes.EGFR_FEMALE, *codes.EGFR_MALE, *codes.EGFR_BLACK, *codes.EGFR_NOT_BLACK,
)))


def watched_results(labs: DataFrame) -> DataFrame:
    """Numeric results of the watched components: pat_id, component_id, result_time, result_value.

    A table that holds ``result_value`` already, as written by an earlier call, stays as it is.
    """
    if VALUE in labs.columns:
        return labs
    return (
        labs.where(F.col("component_id").isin(*WATCHED))
        .select("pat_id", "component_id", "result_time", result_value(F.col("ord_value")).alias(VALUE))
        .where(F.col(VALUE).isNotNull())
    )
