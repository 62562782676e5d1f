import pytest

from carecohort.operators.risk import pce_risks, prevent_ascvd_risks, prevent_total_cvd_risks

PERSON = (
    "sex string, raceth string, age_yrs int, total_chol double, hdl_chol double, systolic_bp double, "
    "current_hypertensive_med_flag int, current_smoker_flag int, diabetes_flag int, egfr int"
)


@pytest.mark.parametrize(
    "sex, raceth, expected",
    [
        ("female", "nh white", 0.021), ("female", "nh black", 0.030),
        ("male", "nh white", 0.053), ("male", "nh black", 0.061),
    ],
)
def test_pce_published_example(spark, sex, raceth, expected):
    """Age 55, total cholesterol 213, HDL 50, untreated pressure 120, no smoking or diabetes."""
    df = spark.createDataFrame([(sex, raceth, 55, 213.0, 50.0, 120.0, 0, 0, 0, None)], PERSON)
    row = pce_risks(df).first()
    assert row["pce_risk_10yr"] == pytest.approx(expected, abs=0.001)  # worked with rounded sums
    assert 0 < row["pce_risk_5yr"] < row["pce_risk_10yr"]


def test_pce_unknown_stratum_has_no_risk(spark):
    df = spark.createDataFrame([("male", "hispanic", 55, 213.0, 50.0, 120.0, 0, 0, 0, None)], PERSON)
    row = pce_risks(df).first()
    assert row["xb"] is None and row["pce_risk_10yr"] is None


def test_prevent_published_example(spark):
    """Woman of 50, cholesterol 200/45, treated pressure 160, diabetes, eGFR 90."""
    df = spark.createDataFrame([("female", "nh other", 50, 200.0, 45.0, 160.0, 1, 0, 1, 90)], PERSON)
    assert round(prevent_total_cvd_risks(df).first()["prevents_total_cvd_risk_10yr"], 3) == 0.147
    assert round(prevent_ascvd_risks(df).first()["prevents_ascvd_risk_10yr"], 3) == 0.092


def test_prevent_knots_and_missing_egfr(spark):
    rows = [
        ("male", "", 55, 200.0, 50.0, 110.0, 0, 0, 0, 60),
        ("male", "", 55, 200.0, 50.0, 110.0, 0, 0, 0, None),
    ]
    first, second = prevent_ascvd_risks(spark.createDataFrame(rows, PERSON)).collect()
    assert (first["x4"], first["x5"], first["x8"], first["x9"]) == (0.0, -1.0, 0.0, 2.0)
    assert second["x8"] is None and second["prevents_ascvd_risk_10yr"] is None
