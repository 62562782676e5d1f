"""Per-patient onset dates from diagnoses, medication orders and results.

Each definition is one filtered, pre-aggregated pass; a patient owning most rows
of a table is reduced to one row per map task before anything is shuffled.
``*_onsets`` compute several definitions over one scan for the cohort build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import codes
from ..functions.clean import contains_any, recode
from .results import VALUE, watched_results

_TS = "timestamp_ntz"


def _icd(fragments) -> Column:
    return contains_any(F.col("current_icd10_list"), fragments)


def _atc(fragments) -> Column:
    return contains_any(F.col("atc_code"), fragments)


def is_statin() -> Column:
    return _atc(codes.ATC_STATIN)


def is_diabetes_drug() -> Column:
    """Diabetes treatment other than metformin, which is often prescribed off-label."""
    return F.col("atc_code").contains(codes.ATC_DIABETES) & ~F.col("atc_code").contains(
        codes.ATC_METFORMIN
    )


def is_antihypertensive() -> Column:
    return _atc(codes.ATC_ANTIHYPERTENSIVE)


def is_event(outcome: str) -> Column:
    """Diagnosis list holds an event of the outcome (``ascvd`` or ``total_cvd``)."""
    extra = codes.ICD_HEART_FAILURE if outcome == "total_cvd" else ()
    return _icd((*codes.ICD_ASCVD, *extra))


def ordered_on() -> Column:
    """Order start for statin and diabetes drugs: unknown without an order time."""
    return F.when(F.col("order_inst").isNotNull(), F.least("order_inst", "start_date"))


def started_on() -> Column:
    """Order start for antihypertensives: whichever of both times is known, the earlier."""
    return F.least("order_inst", "start_date")


# --- single definitions ------------------------------------------------------


def first_statin(medications: DataFrame) -> DataFrame:
    return (
        medications.where(is_statin())
        .groupBy("pat_id").agg(F.min(ordered_on()).alias("statin_first_date"))
    )


def first_event(diagnoses: DataFrame, outcome: str) -> DataFrame:
    """Earliest event diagnosis.  The column name is the same for both outcomes."""
    return (
        diagnoses.where(is_event(outcome))
        .groupBy("pat_id").agg(F.min("contact_date").alias("ascvd_first_date"))
    )


def dyslipidemia_onset(labs: DataFrame) -> DataFrame:
    """Time of the first lipid result at or above its limit."""
    value = F.col(VALUE)
    high = F.lit(False)
    for components, limit in codes.DYSLIPIDEMIA_LIMITS:
        high = high | (F.col("component_id").isin(*components) & (value >= limit))
    watched = [c for components, _ in codes.DYSLIPIDEMIA_LIMITS for c in components]
    return (
        watched_results(labs).where(F.col("component_id").isin(*watched) & high)
        .groupBy("pat_id").agg(F.min("result_time").alias("dyslipidemia_date"))
    )


def second_antihypertensive(medications: DataFrame) -> DataFrame:
    """Start of the second antihypertensive order; one order alone does not count.

    Spark keeps the two earliest orders per patient on the map side
    (WindowGroupLimit), so the ranking never sees a patient's whole history.
    """
    nth = Window.partitionBy("pat_id").orderBy(
        F.col("order_inst").asc_nulls_last(), F.col("start_date").asc_nulls_last()
    )
    return (
        medications.where(is_antihypertensive())
        .select("pat_id", "order_inst", "start_date")
        .withColumn("_nth", F.row_number().over(nth))
        .where(F.col("_nth") == 2)
        .select("pat_id", started_on().alias("hypertension_med_date"))
    )


def _definition(by_diagnosis: DataFrame, by_drug: DataFrame, name: str) -> DataFrame:
    """Earlier of diagnosis and drug onset, keeping patients known to either source."""
    dx, med = f"{name}_dx_date", f"{name}_med_date"
    both = by_diagnosis.unionByName(by_drug, allowMissingColumns=True)
    return (
        both.groupBy("pat_id")
        .agg(F.min(dx).alias(dx), F.min(med).alias(med))
        .withColumn(f"{name}_date", F.least(F.col(dx).cast(_TS), F.col(med).cast(_TS)))
    )


def diabetes_definition(diagnoses: DataFrame, medications: DataFrame) -> DataFrame:
    dx = diagnoses.where(_icd(codes.ICD_DIABETES)).groupBy("pat_id").agg(
        F.min("contact_date").alias("diabetes_dx_date")
    )
    med = medications.where(is_diabetes_drug()).groupBy("pat_id").agg(
        F.min(ordered_on()).alias("diabetes_med_date")
    )
    return _definition(dx, med, "diabetes")


def hypertension_definition(diagnoses: DataFrame, medications: DataFrame) -> DataFrame:
    dx = diagnoses.where(_icd(codes.ICD_HYPERTENSION)).groupBy("pat_id").agg(
        F.min("contact_date").alias("hypertension_dx_date")
    )
    return _definition(dx, second_antihypertensive(medications), "hypertension")


def smoking_records(social_history: DataFrame) -> DataFrame:
    """Every record of current smoking, duplicates kept."""
    return social_history.where(F.col("smoking_tob_use_nm").isin(*codes.SMOKING_NOW)).select(
        "pat_id", F.col("contact_date").alias("smoking_status_date")
    )


def smoking_days(social_history: DataFrame) -> DataFrame:
    """Smoking records as (patient, day, number of records): at most one row per day."""
    return smoking_records(social_history).groupBy("pat_id", "smoking_status_date").agg(
        F.count(F.lit(1)).alias("n_records")
    )


def first_index_death(deaths: DataFrame) -> DataFrame:
    return deaths.groupBy("pat_id").agg(F.min("death_date").alias("ndi_death_date"))


def _death_counts(outcome: str, count_ascvd_deaths: bool) -> Column:
    labels = [outcome.replace("_", " ")]
    if count_ascvd_deaths:
        labels.append("ascvd")
    return F.col("death_cause").isin(*labels)


def first_outcome(
    diagnoses: DataFrame, deaths: DataFrame, outcome: str, count_ascvd_deaths: bool = False
) -> DataFrame:
    """Earliest outcome: event diagnosis or death-index death carrying the outcome's label.

    Labels exclude each other, so by default deaths labelled ``ascvd`` do not count
    towards total CVD, as in the published cohort; ``count_ascvd_deaths`` adds them.
    """
    by_diagnosis = diagnoses.where(is_event(outcome)).select("pat_id", F.col("contact_date").alias("day"))
    by_death = deaths.where(_death_counts(outcome, count_ascvd_deaths)).select(
        "pat_id", F.col("death_date").alias("day")
    )
    return (
        by_diagnosis.unionByName(by_death)
        .groupBy("pat_id").agg(F.min("day").alias(f"{outcome}_date"))
    )


def demographics(patients: DataFrame) -> DataFrame:
    """Reporting values of sex, race/ethnicity, language and relationship status."""
    race = F.col("patient_race")
    raceth = (
        F.when(F.col("ethnic_group_nm") == "Hispanic", "hispanic")
        .when(race.ilike("%black%"), "nh black")
        .when(
            race.like("asian%")  # case matters here, not in the others
            | race.ilike("%indian%") | race.ilike("%hawaiian%") | race.ilike("%other%"),
            "nh other",
        )
        .when(race.ilike("%caucasian%"), "nh white")
        .otherwise("unknown")
    )
    language = F.col("language_nm")
    return patients.select(
        "pat_id",
        "pat_mrn_id",
        "birth_date",
        "death_date",
        F.to_date("last_discharge_or_contact_date").alias("last_discharge_or_contact_date"),
        F.lower(F.coalesce("pat_sex", F.lit("unknown"))).alias("sex"),
        raceth.alias("raceth"),
        F.when(language.isNull(), "unknown")
        .otherwise(recode(language, codes.LANGUAGE, "other")).alias("language_primary"),
        recode(F.col("marital_status_nm"), codes.RELATIONSHIP, "unknown")
        .alias("relationship_status"),
    )


# --- several definitions in one scan -----------------------------------------


def diagnosis_onsets(diagnoses: DataFrame) -> DataFrame:
    """All diagnosis-based onsets in one pass instead of one scan per definition."""
    kinds = {
        "_ascvd_dx": is_event("ascvd"),
        "_total_cvd_dx": is_event("total_cvd"),
        "diabetes_dx_date": _icd(codes.ICD_DIABETES),
        "hypertension_dx_date": _icd(codes.ICD_HYPERTENSION),
    }
    wanted = (*codes.ICD_ASCVD, *codes.ICD_HEART_FAILURE, *codes.ICD_DIABETES, *codes.ICD_HYPERTENSION)
    return diagnoses.where(_icd(wanted)).groupBy("pat_id").agg(
        *[F.min(F.when(hit, F.col("contact_date"))).alias(name) for name, hit in kinds.items()]
    )


def medication_onsets(medications: DataFrame) -> DataFrame:
    """Statin and diabetes-drug onsets in one pass."""
    return medications.where(is_statin() | is_diabetes_drug()).groupBy("pat_id").agg(
        F.min(F.when(is_statin(), ordered_on())).alias("statin_first_date"),
        F.min(F.when(is_diabetes_drug(), ordered_on())).alias("diabetes_med_date"),
    )


def death_onsets(deaths: DataFrame, count_ascvd_deaths: bool = False) -> DataFrame:
    """First death-index date, overall and per outcome."""
    day = F.col("death_date")
    return deaths.groupBy("pat_id").agg(
        F.min(day).alias("ndi_death_date"),
        *[
            F.min(F.when(_death_counts(o, count_ascvd_deaths), day)).alias(f"_{o}_death")
            for o in ("ascvd", "total_cvd")
        ],
    )


def smoking_summary(social_history: DataFrame) -> DataFrame:
    """Latest smoking day and all smoking days with their record counts, per patient.

    The list has one entry per calendar day at most, however many records there are.
    """
    day = F.struct("smoking_status_date", "n_records")
    return smoking_days(social_history).groupBy("pat_id").agg(
        F.max("smoking_status_date").alias("last_smoking_date"),
        F.collect_list(day).alias("smoking"),
    )


def patient_profile(tables: dict[str, DataFrame], count_ascvd_deaths: bool = False) -> DataFrame:
    """One row per patient: demographics and every onset date of both outcomes.

    All inputs are already one row per patient and partitioned by patient, so the
    joins add no exchange of their own.
    """
    profile = demographics(tables["patients"])
    for part in (
        diagnosis_onsets(tables["diagnoses"]),
        medication_onsets(tables["medications"]),
        second_antihypertensive(tables["medications"]),
        dyslipidemia_onset(tables["labs"]),
        death_onsets(tables["ndi_cause_of_death"], count_ascvd_deaths),
        smoking_summary(tables["social_history"]),
    ):
        profile = profile.join(part, ["pat_id"], "left")
    return profile.withColumns(
        {
            "diabetes_date": F.least(
                F.col("diabetes_dx_date").cast(_TS), F.col("diabetes_med_date").cast(_TS)
            ),
            "hypertension_date": F.least(
                F.col("hypertension_dx_date").cast(_TS), F.col("hypertension_med_date").cast(_TS)
            ),
            "_ascvd_outcome": F.least("_ascvd_dx", "_ascvd_death"),
            "_total_cvd_outcome": F.least("_total_cvd_dx", "_total_cvd_death"),
        }
    ).drop("_ascvd_death", "_total_cvd_death")
