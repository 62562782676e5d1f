"""Index visits: the first eligible visit with every predictor at hand.

Everything is reduced to patient-days first.  The study window has 2,010 days and
look-back adds 180, so however many rows one patient owns in the source tables,
here the patient has a few thousand at most.  The newest earlier panel, eGFR and
smoking record of each visit day come from one ordered pass over those days; no
visit is paired with every panel of its patient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import codes
from ..functions.dates import day_gap, not_after, plus_years, within_lookback, year_gap
from .eligibility import (
    ELIGIBLE_COLUMNS, clinic_visits, has_known_onset, observation_end, visit_allowed,
    visit_before,
)
from .predictors import (
    LIPIDS, active_antihypertensive, antihypertensive_courses, complete_panels, egfr_days,
    systolic_pressure,
)
from .phenotypes import smoking_days
from .skew import ROWS_PER_SPLIT, join_lookup

_VISIT_FIELDS = ("pat_enc_csn_id", "department_name", "insurance", "systolic_bp_time", "systolic_bp")


def _usable(day: str):
    """Days that can lie inside the look-back of some study visit."""
    first = F.date_sub(F.lit(codes.STUDY_START).cast("date"), codes.LOOKBACK_DAYS)
    return F.col(day).between(first, F.lit(codes.STUDY_END).cast("date"))


def visit_days(
    encounters: DataFrame, vitals: DataFrame, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """First visit (lowest encounter id) with a blood pressure of each patient and day."""
    measured = join_lookup(
        clinic_visits(encounters), systolic_pressure(vitals), ["pat_enc_csn_id"],
        rows_per_split=rows_per_split,
    )
    return measured.groupBy("pat_id", "contact_date").agg(
        F.min(F.struct(*_VISIT_FIELDS)).alias("visit")
    )


def visit_timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """Every measured visit day with the newest panel, eGFR and smoking day up to it."""
    panels = complete_panels(tables["labs"]).where(_usable("chol_date"))
    egfrs = egfr_days(tables["labs"], tables["patients"]).where(_usable("egfr_date"))
    smoking = smoking_days(tables["social_history"]).where(_usable("smoking_status_date"))
    days = (
        visit_days(tables["encounters"], tables["vitals"])
        .withColumnRenamed("contact_date", "day").withColumn("is_visit", F.lit(1))
    )
    for source, day, payload in (
        (panels, "chol_date", F.struct("chol_date", *LIPIDS).alias("panel")),
        (egfrs, "egfr_date", F.struct("result_time", "egfr_date", "egfr").alias("egfr_row")),
        (smoking, "smoking_status_date", F.col("smoking_status_date").alias("smoked_on")),
    ):
        part = source.select("pat_id", F.col(day).alias("day"), F.lit(0).alias("is_visit"), payload)
        days = days.unionByName(part, allowMissingColumns=True)
    so_far = (
        Window.partitionBy("pat_id").orderBy("day", "is_visit", "egfr_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # a day may hold several eGFRs: the order ends with the latest, then the highest
    newest = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("panel", "egfr_row", "smoked_on")}
    return days.withColumns(newest).where(F.col("is_visit") == 1).select(
        "pat_id", F.col("day").alias("contact_date"),
        *[F.col(f"visit.{c}").alias(c) for c in _VISIT_FIELDS],
        "panel", "egfr_row", "smoked_on",
    )


def screened_days(timeline: DataFrame, profile: DataFrame) -> DataFrame:
    """Visit days that satisfy everything the two outcomes have in common.

    The timeline is already partitioned by patient, so only the profile moves; most
    days drop out here, before anything is written or ranked.
    """
    visit = F.col("contact_date")
    smoked = within_lookback(F.col("smoked_on"), visit, codes.LOOKBACK_DAYS)
    fresh_egfr = within_lookback(F.col("egfr_row.egfr_date"), visit, codes.LOOKBACK_DAYS)
    ready = timeline.where(within_lookback(F.col("panel.chol_date"), visit, codes.LOOKBACK_DAYS))
    return (
        ready.join(profile.drop("smoking"), ["pat_id"])
        .where(visit_allowed() & (has_known_onset() | smoked))
        .withColumns(
            {
                "smoking_status_date": F.when(smoked, F.col("smoked_on")).otherwise(F.col("last_smoking_date")),
                "age_yrs": year_gap(F.col("birth_date"), visit),
                "last_discharge_or_contact_date": observation_end(),
                "egfr_row": F.when(fresh_egfr, F.col("egfr_row")),
            }
        )
        .select("*", "panel.*")
        .drop("panel", "smoked_on", "last_smoking_date", "birth_date")
    )


def candidate_days(screened: DataFrame, outcome: str) -> DataFrame:
    """Days on which an index visit could fall, one row per patient and day.

    Only total CVD demands an eGFR.  Choice within a day: lowest encounter id,
    newest panel, newest eGFR, newest smoking day in the look-back (else the newest
    of all).
    """
    event = f"_{outcome}_dx"
    kept = screened.where(visit_before(event))
    if outcome == "total_cvd":
        kept = kept.where(F.col("egfr_row").isNotNull())
    return kept.withColumns(
        {"ascvd_first_date": F.col(event), f"{outcome}_date": F.col(f"_{outcome}_outcome")}
    ).select(
        *ELIGIBLE_COLUMNS, "systolic_bp_time", "systolic_bp", "chol_date", *LIPIDS, "egfr_row",
        f"{outcome}_date",
    )


def first_visits(candidates: DataFrame) -> DataFrame:
    """The earliest candidate day of each patient: the index visit."""
    by_date = Window.partitionBy("pat_id").orderBy("contact_date")
    return candidates.withColumn("patient_encounter_row_num", F.row_number().over(by_date)).where(
        F.col("patient_encounter_row_num") == 1
    )


def with_flags(index_visits: DataFrame, outcome: str) -> DataFrame:
    """0/1 predictors and outcomes as of the index visit."""
    visit, event = F.col("contact_date"), F.col(f"{outcome}_date")
    return index_visits.withColumns(
        {
            "diabetes_flag": not_after(F.col("diabetes_date"), visit),
            "hypertension_flag": not_after(F.col("hypertension_date"), visit),
            "dyslipidemia_flag": not_after(F.col("dyslipidemia_date"), visit),
            "current_smoker_flag": F.when(
                within_lookback(F.col("smoking_status_date"), visit, codes.LOOKBACK_DAYS), 1
            ).otherwise(0),
            "current_hypertensive_med_flag": F.col("current_hypertensive_med_start_date").isNotNull().cast("int"),
            # counted by calendar year; events before the visit would count too
            f"{outcome}_5yr_flag": F.when(year_gap(visit, event) <= 5, 1).otherwise(0),
            f"{outcome}_10yr_flag": F.when(year_gap(visit, event) <= 10, 1).otherwise(0),
        }
    )


def with_followup(index_visits: DataFrame, outcome: str) -> DataFrame:
    """End of follow-up and its length in years.

    An event recorded after the last observation (death index) ends follow-up
    itself, capped at ten years; everyone else is followed to the first of event,
    death, last observation and the cap.
    """
    event, visit = F.col(f"{outcome}_date"), F.col("contact_date")
    cap = plus_years(visit, codes.FOLLOWUP_CAP_YEARS)
    late_event = event > F.col("last_discharge_or_contact_date")
    end = F.when(late_event, F.least(event, cap)).otherwise(
        F.least(event, F.col("death_date"), F.col("ndi_death_date"),
                F.col("last_discharge_or_contact_date"), cap)
    )
    ended = index_visits.withColumn(f"{outcome}_followup_end_date", end)
    years = day_gap(visit, F.col(f"{outcome}_followup_end_date")) / F.lit(365.25)
    return ended.withColumn(f"{outcome}_followup_years", F.round(years, 2))


def complete_index(
    visits: DataFrame, medications: DataFrame, outcome: str, all_classes_checked: bool = False
) -> DataFrame:
    """Index visits with treatment, flags and follow-up attached."""
    treated = active_antihypertensive(
        visits, antihypertensive_courses(medications, all_classes_checked)
    )
    return with_followup(with_flags(visits.join(treated, ["pat_id"], "left"), outcome), outcome)


def with_egfr(index_table: DataFrame) -> DataFrame:
    """Keep patients whose eGFR is known and spell out its time, day and value."""
    return index_table.where(F.col("egfr_row").isNotNull()).select("*", "egfr_row.*").drop("egfr_row")


def without_egfr(index_table: DataFrame) -> DataFrame:
    return index_table.drop("egfr_row")


def analysis_set(index_table: DataFrame, by_race: bool = False) -> DataFrame:
    """Patients the equations apply to: known sex and, for PCE, Black or White."""
    kept = index_table.where(F.col("sex").isin("female", "male"))
    return kept.where(F.col("raceth").isin("nh black", "nh white")) if by_race else kept
