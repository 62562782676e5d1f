"""Predictor measurements: lipid panels, blood pressure, eGFR, antihypertensives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.clean import leading_digits
from ..functions.dates import day_gap
from .phenotypes import is_antihypertensive, started_on
from .results import VALUE, watched_results
from .skew import join_lookup

LIPIDS = ("hdl_chol", "ldl_chol", "total_chol")


def cholesterol_panels(labs: DataFrame) -> DataFrame:
    """One row per patient and day with the day's mean HDL, LDL and total cholesterol.

    Three conditional means in one aggregation: a pivot would group (and shuffle)
    once more by the lipid.
    """
    value = F.col(VALUE)
    ids = {"hdl_chol": codes.HDL, "ldl_chol": codes.LDL, "total_chol": codes.TOTAL_CHOLESTEROL}
    wanted = [c for components in ids.values() for c in components]
    return (
        watched_results(labs).where(F.col("component_id").isin(*wanted) & (value > 0))
        .withColumn("chol_date", F.to_date("result_time"))
        .groupBy("pat_id", "chol_date")
        .agg(
            *[
                F.avg(F.when(F.col("component_id").isin(*ids[name]), value)).alias(name)
                for name in LIPIDS
            ]
        )
    )


def complete_panels(labs: DataFrame) -> DataFrame:
    """Panel days on which all three lipids are known."""
    return cholesterol_panels(labs).dropna(subset=list(LIPIDS))


def systolic_pressure(vitals: DataFrame) -> DataFrame:
    """Rounded mean systolic pressure and first reading time per encounter.

    Single-digit and four-digit readings are errors and are left out.
    """
    digits = leading_digits(F.col("meas_value"))
    return (
        vitals.where((F.col("flo_meas_id") == codes.SYSTOLIC_FLOWSHEET) & F.length(digits).isin(2, 3))
        .groupBy("pat_enc_csn_id")
        .agg(
            F.min("recorded_time").alias("systolic_bp_time"),
            F.round(F.avg(digits.try_cast("int"))).alias("systolic_bp"),
        )
    )


# component group -> (component ids, who it applies to)
def _egfr_groups() -> dict[str, tuple]:
    black = F.col("patient_race").isin(*codes.RACE_BLACK)
    return {
        "anyone": (codes.EGFR_ANYONE, F.lit(True)),
        "female": (codes.EGFR_FEMALE, F.col("pat_sex") == "Female"),
        "male": (codes.EGFR_MALE, F.col("pat_sex") == "Male"),
        "black": (codes.EGFR_BLACK, black),
        "not_black": (codes.EGFR_NOT_BLACK, ~black),  # unknown race matches neither
    }


def _egfr_group() -> Column:
    """First group listing the component; "anyone" wins over a narrower one."""
    out = None
    for name, (components, _) in _egfr_groups().items():
        hit = F.col("component_id").isin(*components)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _applies() -> Column:
    ok = F.lit(False)
    for name, (_, who) in _egfr_groups().items():
        ok = ok | ((F.col("_group") == name) & who)
    return ok


def _numeric_egfr(labs: DataFrame) -> DataFrame:
    wanted = [c for components, _ in _egfr_groups().values() for c in components]
    return (
        watched_results(labs).where(F.col("component_id").isin(*wanted))
        .select(
            "pat_id",
            "result_time",
            F.to_date("result_time").alias("egfr_date"),
            F.col(VALUE).alias("egfr"),
            _egfr_group().alias("_group"),
        )
    )


_PERSON = ("pat_id", "pat_sex", "patient_race")


def egfr_results(labs: DataFrame, patients: DataFrame) -> DataFrame:
    """Every numeric eGFR whose component applies to the patient's sex or race.

    Results of unknown patients stay if their component applies to anyone.
    """
    rows = join_lookup(_numeric_egfr(labs), patients.select(*_PERSON), ["pat_id"], "left")
    return rows.where(_applies()).select("pat_id", "result_time", "egfr_date", "egfr")


def egfr_days(labs: DataFrame, patients: DataFrame) -> DataFrame:
    """Latest applicable eGFR of each patient, day and component group (five groups).

    Reduced to those few rows per day before patients are joined.
    """
    newest = (
        _numeric_egfr(labs)
        .groupBy("pat_id", "_group", "egfr_date")
        .agg(F.max(F.struct("result_time", "egfr")).alias("newest"))
    )
    return (
        newest.join(patients.select(*_PERSON), ["pat_id"], "left")
        .where(_applies())
        .select("pat_id", "egfr_date", "newest.result_time", "newest.egfr")
    )


def antihypertensive_courses(medications: DataFrame, all_classes_checked: bool = False) -> DataFrame:
    """(pat_id, end_date, earliest start) of antihypertensive orders.

    By default the 30-day supply rule reaches only one drug class, which is how
    the published cohort was built; ``all_classes_checked`` applies it to all.

    For a given end date only the earliest start can matter to "active on day D"
    and to the earliest active start, so one row per end date is enough.
    """
    long_enough = day_gap(F.col("order_inst"), F.col("end_date")) >= codes.MIN_SUPPLY_DAYS
    if all_classes_checked:
        counted = is_antihypertensive() & long_enough
    else:
        code = F.col("atc_code")
        counted = F.lit(False)
        for fragment in codes.ATC_ANTIHYPERTENSIVE:
            hit = code.contains(fragment)
            counted = counted | (hit & long_enough if fragment == codes.ATC_SUPPLY_CHECKED else hit)
    return (
        medications.where(counted & F.col("end_date").isNotNull())
        .select("pat_id", "end_date", started_on().alias("start"))
        .where(F.col("start").isNotNull())
        .groupBy("pat_id", "end_date")
        .agg(F.min("start").alias("start"))
    )


def active_antihypertensive(index_visits: DataFrame, courses: DataFrame) -> DataFrame:
    """Earliest start and end among the courses covering a patient's index visit."""
    visit = index_visits.select("pat_id", "contact_date")
    return (
        courses.join(visit, ["pat_id"])
        .where(F.col("contact_date").between(F.col("start"), F.col("end_date")))
        .groupBy("pat_id")
        .agg(
            F.min("start").alias("current_hypertensive_med_start_date"),
            F.min("end_date").alias("current_hypertensive_med_end_date"),
        )
    )
