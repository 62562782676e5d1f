"""Registry tables derived from the star-schema test tables.

No real registry data ships with this package.  Customers stand in for patients,
orders for encounters and line items for diagnoses, laboratory panels and
medication orders; dates move forward 222 months so that the study window cuts
through them.  FIXTURES.md lists every formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deaths import match_deaths

MONTHS_FORWARD = 222

# component id, lowest value, span, multiplier
PANEL = (
    (2999, 60, 90, 7),
    (1726268, 30, 50, 11),
    (1510312, 120, 95, 13),
    (244, 40, 80, 17),
    (1552156, 60, 100, 19),
)
# the eGFR component of a panel by its row's number; for every other row it is the one for anyone
EGFR_ANYONE = 244
EGFR_EVERY = 16
EGFR_COMPONENTS = {3: 1233000244, 6: 1232000244, 9: 2415, 12: 2414, 15: 3736}


def _forward(col: str) -> Column:
    return F.add_months(F.col(col).cast("date"), MONTHS_FORWARD)


def _at_hour(day: Column, hours: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours.cast("int"))


def _days_from(day: str, days: Column) -> Column:
    return F.date_add(F.lit(day).cast("date"), days.cast("int"))


def _pick(key: Column, values: dict, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(default).cast("string"))


def read_star(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their customer: the row source of clinical events."""
    items = read_star(spark, folder, "lineitem")
    orders = read_star(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("pat_id"),
        F.col("l_orderkey").alias("pat_enc_csn_id"),
        "l_linenumber",
        _forward("l_shipdate").alias("d"),
        (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")).alias("h"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return read_star(spark, folder, "customer").select(
        k.alias("pat_id"),
        F.concat(F.lit("M"), k.cast("string")).alias("pat_mrn_id"),
        _days_from("1936-01-01", (k * 7919) % 16000).alias("birth_date"),
        F.when(k % 40 == 0, F.lit(None).cast("string"))
        .when(k % 4 < 2, "Female").otherwise("Male").alias("pat_sex"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Hispanic")
        .otherwise("Not Hispanic").alias("ethnic_group_nm"),
        _pick(
            F.col("c_nationkey") % 6,
            {
                0: "BLACK OR AFRICAN AMERICAN;", 1: "WHITE OR CAUCASIAN;",
                2: "WHITE OR CAUCASIAN;", 3: "asian;", 4: "AMERICAN INDIAN;",
            },
        ).alias("patient_race"),
        F.when(k % 6 == 2, F.lit(None).cast("string")).otherwise(
            _pick(k % 6, {0: "Spanish", 1: "American Sign Language", 3: "Vietnamese"}, "English")
        ).alias("language_nm"),
        _pick(
            k % 7, {0: "Single", 1: "Married", 2: "Other", 3: "Widowed", 4: "Windowed"}
        ).alias("marital_status_nm"),
        F.when(k % 11 == 0, _days_from("2014-01-01", (k * 13) % 2500)).alias("death_date"),
        _days_from("2015-01-01", (k * 17) % 2900).alias("last_discharge_or_contact_date"),
    )


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_star(spark, folder, "orders").select(
        F.col("o_custkey").alias("pat_id"),
        k.alias("pat_enc_csn_id"),
        _forward("o_orderdate").alias("contact_date"),
        F.concat(F.lit("Clinic "), (k % 12).cast("string")).alias("department_name"),
        _pick(
            k % 9,
            {
                0: "COMMERCIAL", 1: "MEDICARE", 2: "MANAGED MEDICAID", 3: "CHARITY", 4: "GRANTS",
                5: "GOVERNMENT OTHER", 6: "SELF PAY PENDING", 7: "OTHER PLAN",
            },
        ).alias("product_type_nm"),
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("h")
    return _items(spark, folder).select(
        "pat_id",
        "pat_enc_csn_id",
        F.col("d").alias("contact_date"),
        F.when(h % 701 == 0, "I21.9, E78.5")
        .when(h % 701 == 1, "I50.9")
        .when(h % 701 == 2, "I63.9")
        .when(h % 701 == 5, "I61.0")
        .when(h % 101 == 3, "E11.9")
        .when(h % 53 == 4, "I10")
        .otherwise("Z00.0").alias("current_icd10_list"),
    )


def labs(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("h")
    panel = F.array(*[
        F.struct(
            F.lit(c).cast("bigint").alias("component_id"), F.lit(base).alias("base"),
            F.lit(span).alias("span"), F.lit(mult).alias("mult"),
        )
        for c, base, span, mult in PANEL
    ])
    egfr = F.lit(EGFR_ANYONE).cast("bigint")
    for place, component in EGFR_COMPONENTS.items():
        egfr = F.when(F.floor(h / 2) % EGFR_EVERY == place, F.lit(component).cast("bigint")).otherwise(egfr)
    v = (F.col("p.base") + (h * F.col("p.mult")) % F.col("p.span")).cast("string")
    return (
        _items(spark, folder)
        .where(h % 2 == 0)
        .withColumn("p", F.explode(panel))
        .select(
            "pat_id",
            "pat_enc_csn_id",
            F.when(F.col("p.component_id") == EGFR_ANYONE, egfr).otherwise(F.col("p.component_id")).alias("component_id"),
            _at_hour(F.col("d"), F.col("l_linenumber") % 8 + 8).alias("result_time"),
            F.when(h % 37 == 0, "SEE NOTE")
            .when(h % 31 == 0, ">1,000")
            .when(h % 29 == 0, F.concat(v, F.lit(".6")))
            .when(h % 23 == 0, F.concat(F.lit(">"), v))
            .otherwise(v).alias("ord_value"),
        )
    )


def vitals(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    reading = F.concat(
        (k * 7 % 90 + 95).cast("string"), F.lit("/"), (k % 30 + 60).cast("string")
    )
    return (
        read_star(spark, folder, "orders")
        .where(k % 10 != 3)
        .select(
            k.alias("pat_enc_csn_id"),
            F.lit(5).cast("bigint").alias("flo_meas_id"),
            _at_hour(_forward("o_orderdate"), F.lit(9)).alias("recorded_time"),
            F.when(k % 97 == 0, "9/5").when(k % 89 == 0, "x120").otherwise(reading)
            .alias("meas_value"),
        )
    )


def medications(spark: SparkSession, folder: str) -> DataFrame:
    h, d = F.col("h"), F.col("d")
    return _items(spark, folder).select(
        "pat_id",
        F.when(h % 41 != 0, _at_hour(d, F.lit(10))).alias("order_inst"),
        F.when(h % 3 != 0, _at_hour(d, h % 5 * 6)).alias("start_date"),
        F.date_add(d, (h % 120 + 10).cast("int")).alias("end_date"),
        F.when(h % 211 == 0, "C10AA05")
        .when(h % 97 == 1, "A10AB01")
        .when(h % 61 == 2, "A10BA02")
        .when(h % 31 == 3, "C09AA03")
        .when(h % 37 == 4, "C07AB02")
        .otherwise("N02BE01").alias("atc_code"),
    )


def social_history(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_star(spark, folder, "orders").where(k % 3 == 0).select(
        F.col("o_custkey").alias("pat_id"),
        _forward("o_orderdate").alias("contact_date"),
        _pick(k % 7, {0: "Every Day", 1: "Former Smoker", 2: "Some Days"}, "Never")
        .alias("smoking_tob_use_nm"),
    )


def _death_keys() -> list[Column]:
    k = F.col("c_custkey")
    return [
        F.concat(F.lit("M"), k.cast("string")).alias("pat_mrn_id"),
        F.lit("TX").alias("ndi_state_death_code"),
        (k % 7 + 2014).cast("string").alias("ndi_year_death_full"),
        F.concat(F.lit("C"), k.cast("string")).alias("ndi_death_cert_no"),
    ]


def death_manifest(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return read_star(spark, folder, "customer").where(k % 13 == 0).select(
        *_death_keys(), F.when(k % 39 == 0, "0").otherwise("1").alias("ndi_status_code")
    )


def death_causes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return read_star(spark, folder, "customer").where(k % 13 == 0).select(
        *_death_keys(),
        (k % 12 + 1).cast("string").alias("ndi_month_death"),
        (k % 28 + 1).cast("string").alias("ndi_day_death"),
        _pick(k % 4, {0: "I219", 1: "I500"}, "C349").alias("ndi_cause_underlying"),
        F.when(k % 8 == 2, "I639").alias("ndi_cause_record_1"),
    )


def read_registry(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All base tables over one folder of star-schema parquet files."""
    people = patients(spark, folder)
    return {
        "patients": people,
        "encounters": encounters(spark, folder),
        "diagnoses": diagnoses(spark, folder),
        "labs": labs(spark, folder),
        "medications": medications(spark, folder),
        "social_history": social_history(spark, folder),
        "vitals": vitals(spark, folder),
        "ndi_cause_of_death": match_deaths(
            death_manifest(spark, folder), death_causes(spark, folder), people
        ),
    }
