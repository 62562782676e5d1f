"""Every registered query: name -> function of (session, folder of test tables)."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import result_value
from ..operators import (
    calibration, discrimination, eligibility, evaluation, fits, index_visit, netbenefit,
    phenotypes, predictors, smoothing, tableone,
)
from ..operators.deaths import match_deaths
from ..operators.evaluation import BY
from ..sources import starschema
from ..schemas import DEATH_KEYS, EXTRACTS
from ..sources.extracts import (
    lower_names, read_by_prefix, read_extract, read_registry, stacked, table_names, write_report,
)
from ..storage import shared_folder
from .cohort import ASCVD_TABLE, PCE_TABLE, TOTAL_CVD_TABLE, CohortBuild
from .validation import ASCVD, PCE_5YR, PCE_10YR, SHARES, TOTAL_CVD, Validation

#: Weight of the curvature in ``smoothed_calibration_fixed``.
FIXED_STRENGTH = 0.001

_open: dict[tuple[str, str], Validation] = {}


def workspace(spark: SparkSession, folder: str) -> Validation:
    """Cohort and validation tables of one folder, built once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Validation(CohortBuild.over_written_base(starschema.read_registry(spark, folder)))
    return _open[key]


def presentable(df: DataFrame) -> DataFrame:
    """Dates and times as text, measurements to six decimals."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        columns.append(c.alias(f.name))
    return df.select(*columns)


QUERIES: dict = {}


def query(name: str):
    """Register a function of the workspace under a query name."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return presentable(fn(workspace(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


def _base(name: str, table: str, operator, *args):
    query(name)(lambda v: operator(v.build.base[table], *args))


# --- sources and per-patient definitions ----------------------------------------


def ingest_lowercase_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Header names to lower case, needed columns only, repeated rows dropped."""
    orders = starschema.read_star(spark, folder, "orders")
    items = starschema.read_star(spark, folder, "lineitem").select("l_orderkey")
    raw = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("PAT_ID"), F.col("o_orderkey").alias("PAT_ENC_CSN_ID"),
        F.col("o_orderdate").cast("date").alias("CONTACT_DATE"),
    )
    return presentable(lower_names(raw).distinct())


QUERIES["ingest_lowercase_distinct"] = ingest_lowercase_distinct


def ndi_match_cause(spark: SparkSession, folder: str) -> DataFrame:
    """Death-index records matched to patients, with their cause label."""
    return presentable(
        match_deaths(
            starschema.death_manifest(spark, folder), starschema.death_causes(spark, folder),
            starschema.patients(spark, folder),
        )
    )


QUERIES["ndi_match_cause"] = ndi_match_cause


def _as_text_file(df: DataFrame, name: str, sep: str) -> str:
    """Write a table the way extracts arrive: delimited, with an upper-case header line."""
    app = df.sparkSession.sparkContext.applicationId
    path = f"{shared_folder(df.sparkSession)}/{app}/{name}-{uuid.uuid4().hex[:12]}"
    df.toDF(*[c.upper() for c in df.columns]).write.option("header", True).option("sep", sep).csv(path)
    return path


#: Broken lines and values of the extract files that ``registry_load`` reads: every so many ids.
EXTRA_FIELD = {"labs": ("pat_enc_csn_id", 70, 1), "patients": ("pat_id", 41, 5), "encounters": ("pat_enc_csn_id", 60, 7)}
WRONG_VALUE = {
    "labs": ("pat_enc_csn_id", 50, 0, "component_id", "n/a"), "patients": ("pat_id", 37, 3, "birth_date", "1960-13-45"),
    "encounters": ("pat_enc_csn_id", 60, 2, "contact_date", "unknown"),
}


def _as_extract(df: DataFrame, name: str) -> str:
    """An extract file of all fields its schema knows, with broken lines and values where they are wanted."""
    spark, sep = df.sparkSession, "," if name == "patients" else "\t"
    fields = [f.name for f in EXTRACTS[name].fields]
    text = {f: F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string") for f in fields}
    every = lambda key, n, rest, *_: F.col(key) % n == rest
    if name in WRONG_VALUE:
        *place, column, wrong = WRONG_VALUE[name]
        text[column] = F.when(every(*place), wrong).otherwise(text[column])
    if name == "patients":  # a line end inside a quoted value
        text["language_nm"] = F.when(F.col("pat_id") % 10 == 4, F.concat(text["language_nm"], F.lit("\nother")))
    line = F.to_csv(F.struct(*[c.alias(f) for f, c in text.items()]), {"sep": sep})
    if name in EXTRA_FIELD:
        line = F.when(every(*EXTRA_FIELD[name]), F.concat(line, F.lit(f"{sep}more"))).otherwise(line)
    header = sep.join(fields).upper()

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": [header]})
        yield from batches

    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.select(line.alias("value")).mapInArrow(headed, "value string").write.text(path)
    return path


def registry_load(spark: SparkSession, folder: str) -> DataFrame:
    """The whole loader over extract files: rows per table, and quarantined lines and values per extract."""
    base = starschema.read_registry(spark, folder)
    people = base["patients"]
    sources = {**{n: base[n] for n in EXTRACTS if n in base}, "last_encounters": people}
    paths = {n: _as_extract(df, n) for n, df in sources.items()}
    paths["ndi"] = _as_text_file(starschema.death_manifest(spark, folder), "ndi", ",")
    paths["ndi_cause"] = _as_text_file(starschema.death_causes(spark, folder), "ndi_cause", ",")
    rejects = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/rejects-{uuid.uuid4().hex[:12]}"
    tables = read_registry(spark, paths, rejects, multi_line=("patients",))
    loaded = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), F.lit("rows").alias("kind"), "n")
        for n, df in tables.items()
    ]
    counted = spark.read.parquet(rejects).groupBy(
        F.col("extract").alias("table_name"), F.col("reason").alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))
    return stacked([*loaded, counted])


QUERIES["registry_load"] = registry_load


@query("created_tables")
def _(v):
    """Rows and patients of every table as created in the catalog, clustered by patient."""
    spark = v.build.base["patients"].sparkSession
    name, before = f"created_{uuid.uuid4().hex[:12]}", spark.catalog.currentDatabase()
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    spark.sql(f"create database {name} location '{place}'")
    spark.catalog.setCurrentDatabase(name)
    try:
        v.build.create_tables(place, buckets=8)
        return stacked([
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.count_distinct("pat_id" if "pat_id" in df.columns else "pat_enc_csn_id").alias("n_keys"),
            ).withColumn("table_name", F.lit(t))
            for t, df in ((t, spark.table(t)) for t in table_names(spark))
        ])
    finally:
        spark.catalog.setCurrentDatabase(before)


@query("report_files")
def _(v):
    """The metric table, read back from the delimited report file it was written to."""
    rows = v.metrics()
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/report-{uuid.uuid4().hex[:12]}"
    write_report(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("delimited_scan")
def _(v):
    """Encounters read back from a tab-delimited file holding repeats and other columns."""
    rows = v.build.base["encounters"].withColumn("note", F.explode(F.array(F.lit("a,b"), F.lit('"c"'))))
    path = _as_text_file(rows, "encounters", "\t")
    wanted = v.build.base["encounters"].schema
    return read_extract(rows.sparkSession, path, wanted).distinct()


def death_index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Death matching from comma-delimited files: text columns picked by name and prefix."""
    manifest = _as_text_file(starschema.death_manifest(spark, folder), "ndi", ",")
    causes = _as_text_file(starschema.death_causes(spark, folder), "ndi_cause", ",")
    return presentable(match_deaths(
        read_by_prefix(spark, manifest, (*DEATH_KEYS, "ndi_status_code")),
        read_by_prefix(
            spark, causes,
            (*DEATH_KEYS, "ndi_month_death", "ndi_day_death", "ndi_cause_underlying"),
            ("ndi_cause_record",),
        ),
        starschema.patients(spark, folder),
    ))


QUERIES["death_index_files"] = death_index_files


@query("lab_clean_cast")
def _(v):
    """Every distinct result text with its number, per component."""
    return v.build.base["labs"].groupBy("component_id", "ord_value").agg(
        F.count(F.lit(1)).alias("n_results")
    ).withColumn("value", result_value(F.col("ord_value")))


_base("first_statin", "medications", phenotypes.first_statin)
_base("first_ascvd_dx", "diagnoses", phenotypes.first_event, "ascvd")
_base("first_total_cvd_dx", "diagnoses", phenotypes.first_event, "total_cvd")
_base("dyslipidemia_onset", "labs", phenotypes.dyslipidemia_onset)
_base("hypertension_second_order", "medications", phenotypes.second_antihypertensive)
_base("current_smoker", "social_history", phenotypes.smoking_records)
_base("demographics_recode", "patients", phenotypes.demographics)
_base("pcmh_visits_insurance", "encounters", eligibility.clinic_visits)
_base("ndi_first_death", "ndi_cause_of_death", phenotypes.first_index_death)
_base("cholesterol_pivot", "labs", predictors.cholesterol_panels)
_base("systolic_bp", "vitals", predictors.systolic_pressure)


@query("diabetes_definition")
def _(v):
    return phenotypes.diabetes_definition(v.build.base["diagnoses"], v.build.base["medications"])


@query("hypertension_definition")
def _(v):
    return phenotypes.hypertension_definition(v.build.base["diagnoses"], v.build.base["medications"])


@query("egfr_results")
def _(v):
    return predictors.egfr_results(v.build.base["labs"], v.build.base["patients"])


@query("ascvd_outcome")
def _(v):
    return phenotypes.first_outcome(
        v.build.base["diagnoses"], v.build.base["ndi_cause_of_death"], "ascvd"
    )


@query("total_cvd_outcome")
def _(v):
    return phenotypes.first_outcome(
        v.build.base["diagnoses"], v.build.base["ndi_cause_of_death"], "total_cvd"
    )


# --- cohort tables ------------------------------------------------------------------


@query("ascvd_eligible")
def _(v):
    """Eligible visits as published: one row per visit and smoking record of the patient."""
    return v.build.eligible("ascvd", expand=True)


@query("total_cvd_eligible")
def _(v):
    """Eligible visits as published: one row per visit and smoking record of the patient."""
    return v.build.eligible("total_cvd", expand=True)


@query("eligible_distinct_patients")
def _(v):
    """Rows and patients of the eligible tables, and patients of the index tables."""
    return stacked([
        df.agg(F.sum(n).alias("n_rows"), F.countDistinct("pat_id").alias("patients"))
        .withColumn("table_name", F.lit(name))
        for name, df, n in (
            ("ascvd_eligible_encounters", v.build.eligible("ascvd"), "published_rows"),
            ("total_cvd_eligible_encounters", v.build.eligible("total_cvd"), "published_rows"),
            (PCE_TABLE, v.build.pce_index, F.lit(1)),
            (ASCVD_TABLE, v.build.prevent_ascvd_index, F.lit(1)),
            (TOTAL_CVD_TABLE, v.build.prevent_total_cvd_index, F.lit(1)),
        )
    ])


_CANDIDATE = (
    "pat_id", "contact_date", "pat_enc_csn_id", "systolic_bp", "chol_date", "hdl_chol",
    "ldl_chol", "total_chol", "smoking_status_date",
)


@query("pce_candidates")
def _(v):
    return v.build.candidates("ascvd").select(*_CANDIDATE)


@query("total_cvd_candidates")
def _(v):
    return v.build.candidates("total_cvd").select(*_CANDIDATE, "egfr_row.*")


@query("pce_index")
def _(v):
    return v.build.pce_index


@query("prevent_ascvd_closest_egfr")
def _(v):
    return v.build.prevent_ascvd_index


@query("prevent_total_cvd_index")
def _(v):
    return v.build.prevent_total_cvd_index


@query("active_antihypertensive")
def _(v):
    courses = predictors.antihypertensive_courses(v.build.base["medications"])
    return predictors.active_antihypertensive(v.build.pce_index, courses)


@query("predictor_flags")
def _(v):
    flags = tableone.YES_NO
    return stacked([
        v.build.pce_index.select(F.lit("ascvd").alias("outcome"), "pat_id", *flags),
        v.build.prevent_total_cvd_index.select(F.lit("total_cvd").alias("outcome"), "pat_id", *flags),
    ])


def _outcome_columns(v, **renamed):
    return stacked([
        df.select(
            F.lit(o).alias("outcome"), "pat_id",
            *[F.col(f"{o}_{s}").alias(name) for name, s in renamed.items()],
        )
        for o, df in (("ascvd", v.build.pce_index), ("total_cvd", v.build.prevent_total_cvd_index))
    ])


@query("outcome_flags")
def _(v):
    return _outcome_columns(v, flag_5yr="5yr_flag", flag_10yr="10yr_flag")


@query("followup_censoring")
def _(v):
    return _outcome_columns(v, end_date="followup_end_date", years="followup_years")


@query("analysis_sets")
def _(v):
    """Who each equation is applied to."""
    return stacked([
        df.groupBy("sex", "raceth").agg(F.count(F.lit(1)).alias("patients")).withColumn("model", F.lit(m))
        for m, df in (
            ("PCE", index_visit.analysis_set(v.build.pce_index, by_race=True)),
            (ASCVD, index_visit.analysis_set(v.build.prevent_ascvd_index)),
            (TOTAL_CVD, index_visit.analysis_set(v.build.prevent_total_cvd_index)),
        )
    ])


# --- risk equations -----------------------------------------------------------------


@query("pce_risk")
def _(v):
    return v.build.pce.select(
        "pat_id", "ln_age", "ln_age_squared", "ln_tc", "ln_age_ln_tc", "ln_hdl", "ln_age_ln_hdl",
        "ln_treated_sbp", "ln_age_ln_treated_sbp", "ln_untreated_sbp", "ln_age_ln_untreated_sbp",
        "ln_age_current_smoker_flag", "xb", "so_t5", "so_t10", "pce_mean_xb", "pce_risk_5yr",
        "pce_risk_10yr",
    )


PREVENT_TERMS = [f"x{i}" for i in (*range(1, 11), 12, *range(14, 20))]


@query("prevent_ascvd_risk")
def _(v):
    terms = [F.col(x).cast("double").alias(x) for x in PREVENT_TERMS]
    return v.build.prevent_ascvd.select("pat_id", *terms, "log_odds_ascvd", "prevents_ascvd_risk_10yr")


@query("prevent_total_cvd_risk")
def _(v):
    terms = [F.col(x).cast("double").alias(x) for x in PREVENT_TERMS]
    return v.build.prevent_total_cvd.select(
        "pat_id", *terms, "log_odds_total_cvd", "prevents_total_cvd_risk_10yr"
    )


@query("risk_by_stratum")
def _(v):
    """Flagship report: patients, events and mean 10-year PCE risk by sex and race."""
    return v.build.pce.groupBy("sex", "raceth").agg(
        F.count(F.lit(1)).alias("patients"),
        F.sum("ascvd_10yr_flag").alias("events"),
        F.avg("pce_risk_10yr").alias("mean_risk_10yr"),
    )


# --- evaluation ---------------------------------------------------------------------


def _survival(v, model):
    return v.survival_rows.where(F.col(BY) == model)


def _binary(v, model):
    return v.binary_rows.where(F.col(BY) == model)


@query("global_ntile")
def _(v):
    return calibration.risk_bins(v.survival_rows).select(BY, "pat_id", F.col("bin").cast("int").alias("bin"))


@query("binned_calibration_pce_5yr")
def _(v):
    return calibration.binned_calibration(_survival(v, PCE_5YR))


@query("binned_calibration_pce_10yr")
def _(v):
    return calibration.binned_calibration(_survival(v, PCE_10YR))


@query("risk_histogram_counts")
def _(v):
    return calibration.risk_histogram(v.survival_rows, 0.0125).select(BY, "bin", "n")


@query("risk_histogram_share")
def _(v):
    return calibration.risk_histogram(v.binary_rows, 0.05).select(BY, "bin", "share")


@query("auc_delong_ascvd")
def _(v):
    return discrimination.auc(_binary(v, ASCVD))


@query("auc_delong_total_cvd")
def _(v):
    return discrimination.auc(_binary(v, TOTAL_CVD))


@query("expected_observed")
def _(v):
    return calibration.expected_observed(v.survival_rows.unionByName(v.binary_rows))


@query("calibration_intercept")
def _(v):
    return fits.logistic_calibration(v.binary_rows).select(
        BY, "intercept", "intercept_low", "intercept_high"
    )


@query("calibration_slope_binary")
def _(v):
    return fits.logistic_calibration(v.binary_rows).select(BY, "slope", "slope_low", "slope_high")


@query("cindex_5yr")
def _(v):
    return discrimination.concordance(_survival(v, PCE_5YR))


@query("cindex_10yr")
def _(v):
    return discrimination.concordance(_survival(v, PCE_10YR))


@query("cox_slope_5yr")
def _(v):
    return fits.cox_calibration(_survival(v, PCE_5YR))


@query("cox_slope_10yr")
def _(v):
    return fits.cox_calibration(_survival(v, PCE_10YR))


@query("km_curve")
def _(v):
    return netbenefit.kaplan_meier(v.survival_rows)


@query("dca_survival_5yr")
def _(v):
    return v.survival_curves(PCE_5YR)


@query("dca_survival_10yr")
def _(v):
    return v.survival_curves(PCE_10YR)


@query("dca_binary_ascvd")
def _(v):
    return v.binary_curves(ASCVD)


@query("dca_binary_total_cvd")
def _(v):
    return v.binary_curves(TOTAL_CVD)


@query("table1_continuous")
def _(v):
    return v.table_one_part(tableone.continuous)


@query("table1_categorical")
def _(v):
    return v.table_one_part(tableone.categorical)


@query("table1_missing")
def _(v):
    return v.table_one_part(tableone.missing)


@query("table1_report")
def _(v):
    """Formatted characteristics tables of the three sets."""
    return stacked([
        tableone.table_one(people, outcome, label)
        .withColumnsRenamed({"Overall": "overall", f"Incident {label}": "incident", f"No {label}": "free"})
        .withColumns({"model": F.lit(model), "outcome": F.lit(label)})
        for model, (people, outcome, label) in v.table_one_sets().items()
    ])


@query("statin_drop_in")
def _(v):
    return v.statin_drop_in()


@query("metrics_long")
def _(v):
    return v.metrics()


@query("metrics_wide")
def _(v):
    return v.metrics_wide()


@query("misclassified_noncases")
def _(v):
    """Non-cases counted as cases, of all models, when 0.5 % or 1 % of them are misclassified."""
    rows = v.survival_rows.unionByName(v.binary_rows).withColumn("before", F.col("outcome"))
    flipped = evaluation.misclassified(rows, SHARES)
    return flipped.where((F.col("outcome") == 1) & (F.col("before") == 0)).select(BY, "pat_id")


@query("misclassification_sensitivity")
def _(v):
    return v.sensitivity()


@query("smoothed_calibration")
def _(v):
    return smoothing.smoothed_calibration(v.binary_rows)


@query("smoothed_calibration_system")
def _(v):
    """Knots and normal equations of the smoothed curves, before any penalty."""
    return smoothing.smoothed_calibration_system(v.binary_rows)


@query("smoothed_calibration_fixed")
def _(v):
    """Smoothed curves at a given penalty."""
    return smoothing.smoothed_calibration(v.binary_rows, strength=FIXED_STRENGTH)
