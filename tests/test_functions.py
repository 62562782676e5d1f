import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from carecohort import codes
from carecohort.functions import clean, dates, numeric


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_result_value(spark):
    cases = {
        ">1,000": None, "12.7": 13, "12.5": 13, "-12.5": -13, " 12 ": 12, "1e3": 1000, "": None,
        "5.": 5, ".5": 1, "3000000000": None, "nan": None, "5d": None, ">=200": None, "<5": 5,
        "=7": 7, "SEE NOTE": None, None: None, "1,000": 1000,
    }
    got = values(spark, [(k,) for k in cases], "v string", "v", clean.result_value(F.col("v")))
    assert dict(got) == cases


def test_leading_digits(spark):
    cases = {"120/80": "120", "x120": "", "9/5": "9", "1200/80": "1200", None: None}
    got = values(spark, [(k,) for k in cases], "v string", "v", clean.leading_digits(F.col("v")))
    assert dict(got) == cases


def test_gaps_count_boundaries(spark):
    rows = [
        (dt.datetime(2013, 12, 31, 23), dt.datetime(2014, 1, 1, 1)),
        (dt.datetime(2014, 1, 1, 1), dt.datetime(2014, 12, 31, 23)),
    ]
    got = values(
        spark, rows, "a timestamp_ntz, b timestamp_ntz",
        dates.year_gap(F.col("a"), F.col("b")), dates.day_gap(F.col("a"), F.col("b")),
    )
    assert got == [(1, 1), (0, 364)]


def test_plus_years_clamps_leap_day(spark):
    got = values(spark, [(dt.date(2012, 2, 29),)], "a date", dates.plus_years(F.col("a"), 10))
    assert got == [(dt.date(2022, 2, 28),)]


def test_date_from_parts(spark):
    rows = [("2014", "3", "1"), ("2014", "13", "1"), ("2014", None, "1"), ("2014", "2", "30")]
    got = values(
        spark, rows, "y string, m string, d string",
        dates.date_from_parts(F.col("y"), F.col("m"), F.col("d")),
    )
    assert got == [(dt.date(2014, 3, 1),), (None,), (None,), (None,)]


def test_knots_keep_missing(spark):
    got = values(
        spark, [(100.0,), (130.0,), (None,)], "v double",
        numeric.at_most(F.col("v"), 110), numeric.at_least(F.col("v"), 110),
    )
    assert got == [(100.0, 110.0), (110.0, 130.0), (None, None)]


def test_natural_log(spark):
    got = values(spark, [(1.0,), (0.0,), (-1.0,), (None,)], "v double", numeric.natural_log(F.col("v")))
    assert got[0] == (0.0,) and got[1] == (-math.inf,) and math.isnan(got[2][0]) and got[3] == (None,)


@pytest.mark.parametrize(
    "value, digits, expected",
    [(0.0, 2, 0.0), (0.0666, 2, 0.067), (123.4, 2, 120.0), (-0.1234, 2, -0.12), (0.98765, 3, 0.988), (7.0, 2, 7.0)],
)
def test_significant(spark, value, digits, expected):
    got = values(spark, [(value,)], "v double", numeric.significant(F.col("v"), digits))
    assert got == [(expected,)]


def test_number_text(spark):
    cases = {0.75: "0.75", 1.0: "1", 120.0: "120", 1e-05: "1e-05", -0.5: "-0.5"}
    got = values(spark, [(k,) for k in cases], "v double", "v", numeric.number_text(F.col("v")))
    assert dict(got) == cases


def test_recode(spark):
    got = values(
        spark, [("Windowed",), ("Widowed",), (None,), ("Married",), ("Other",)], "v string",
        clean.recode(F.col("v"), codes.RELATIONSHIP, "unknown"),
    )
    assert [g[0] for g in got] == ["single", "unknown", "unknown", "in a relationship", "other"]
