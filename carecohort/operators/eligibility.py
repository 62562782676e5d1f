"""Clinic visits and the eligible-encounter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.clean import recode
from ..functions.dates import within_lookback, year_gap
from .skew import ROWS_PER_SPLIT, join_lookup, numbered_copies

OUTCOMES = ("ascvd", "total_cvd")

ELIGIBLE_COLUMNS = (
    "pat_id", "pat_mrn_id", "pat_enc_csn_id", "contact_date", "department_name", "insurance",
    "sex", "raceth", "language_primary", "relationship_status", "death_date", "ndi_death_date",
    "statin_first_date", "ascvd_first_date", "dyslipidemia_date", "diabetes_dx_date",
    "diabetes_med_date", "diabetes_date", "hypertension_dx_date", "hypertension_med_date",
    "hypertension_date", "smoking_status_date", "age_yrs", "last_discharge_or_contact_date",
)


def clinic_visits(encounters: DataFrame) -> DataFrame:
    """Visits inside the study window with the payer recoded."""
    day = F.col("contact_date")
    first, last = F.lit(codes.STUDY_START).cast("date"), F.lit(codes.STUDY_END).cast("date")
    return encounters.where(day.between(first, last)).select(
        "pat_id",
        "pat_enc_csn_id",
        "contact_date",
        "department_name",
        recode(F.col("product_type_nm"), codes.INSURANCE, "unknown").alias("insurance"),
    )


def has_known_onset() -> Column:
    """Some risk-factor onset is known, whenever it was."""
    return (
        F.col("dyslipidemia_date").isNotNull()
        | F.col("diabetes_date").isNotNull()
        | F.col("hypertension_date").isNotNull()
    )


def visit_allowed() -> Column:
    """Age, no earlier statin, and no risk-factor onset after the visit.

    Dates count as midnight: a result at 10:00 on the visit day is an onset after
    the visit, a statin order at 10:00 one after it too.
    """
    day = F.col("contact_date")

    def since(onset):
        return (day >= F.col(onset)) | F.col(onset).isNull()

    return (
        year_gap(F.col("birth_date"), day).between(codes.MIN_AGE, codes.MAX_AGE)
        & visit_before("statin_first_date")
        & since("dyslipidemia_date")
        & since("diabetes_date")
        & since("hypertension_date")
    )


def visit_before(limit: str) -> Column:
    """The visit precedes the date, or the date never came."""
    return (F.col("contact_date") < F.col(limit)) | F.col(limit).isNull()


def observation_end() -> Column:
    """Last contact, replaced by an earlier registry death, else an earlier index death."""
    last = F.col("last_discharge_or_contact_date")
    return (
        F.when(last > F.col("death_date"), F.col("death_date"))
        .when(last > F.col("ndi_death_date"), F.col("ndi_death_date"))
        .otherwise(last)
    )


def eligible_encounters(
    tables: dict[str, DataFrame],
    profile: DataFrame,
    outcome: str,
    rows_per_split: int = ROWS_PER_SPLIT,
    expand: bool = False,
) -> DataFrame:
    """Eligible visits, one row per visit and smoking day of the patient.

    The published table repeats a visit per smoking record: ``published_rows`` says how
    many of its rows, equal in every column, a row stands for.  They are not made
    unless ``expand`` asks for them.  Cohort building (``index_visit``) works from
    patient-days and needs neither.  A patient's smoking days travel in the profile row (one
    entry per calendar day), so there is a single join.
    """
    event = f"_{outcome}_dx"
    visits = join_lookup(
        clinic_visits(tables["encounters"]), profile, ["pat_id"], rows_per_split=rows_per_split
    ).where(visit_allowed() & visit_before(event))

    recent = F.filter(
        "smoking",
        lambda s: within_lookback(s["smoking_status_date"], F.col("contact_date"), codes.LOOKBACK_DAYS),
    )
    listed = F.when(has_known_onset(), F.col("smoking")).otherwise(F.col("recent"))
    listings = (
        visits.withColumn("recent", recent)
        .where(has_known_onset() | (F.size("recent") > 0))
        .withColumn("record", F.explode_outer(listed))
        .withColumn("published_rows", F.coalesce("record.n_records", F.lit(1)).cast("bigint"))
    )
    if expand:
        listings = numbered_copies(listings, "published_rows", "copy")
    return (
        listings.withColumns(
            {
                "smoking_status_date": F.col("record.smoking_status_date"),
                "ascvd_first_date": F.col(event),
                "age_yrs": year_gap(F.col("birth_date"), F.col("contact_date")),
                "last_discharge_or_contact_date": observation_end(),
            }
        )
        .select(*ELIGIBLE_COLUMNS, *([] if expand else ["published_rows"]))
    )
