"""Model-validation functions over any scored DataFrame, with columns by name.

Each takes a DataFrame and column names and returns a DataFrame.  ``subject``
names the column that identifies a row's patient.  Follow-up times are taken as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import calibration, netbenefit, smoothing, tableone
from .operators.evaluation import BY, rows_for
from .operators.ranking import random_rank
from .operators.risk import pce_risks, prevent_ascvd_risks, prevent_total_cvd_risks
from .plans.validation import binary_metrics, survival_metrics
from .sources.extracts import write_report

calculate_pce_risks = pce_risks
calculate_prevents_ascvd_risks = prevent_ascvd_risks
calculate_prevents_total_cvd_risks = prevent_total_cvd_risks


def _rows(data, outcome, p, xb=None, survival_time=None, subject="pat_id") -> DataFrame:
    return rows_for(
        data.withColumn("pat_id", F.col(subject)), "model", outcome, p,
        F.lit(0.0) if xb is None else xb,
        F.lit(0.0) if survival_time is None else survival_time,
    )


def create_demographics_table(
    data: DataFrame, outcome_field: str, outcome_label: str, save_path: str | None = None
) -> DataFrame:
    """Characteristics overall, with and without the outcome; also written if a path is given."""
    table = tableone.table_one(data, outcome_field, outcome_label)
    if save_path is not None:
        write_report(table, save_path)
    return table


def binary_calibration_metrics(
    data: DataFrame, outcome: str, p: str, xb: str, subject: str = "pat_id"
) -> DataFrame:
    """(Metric, Value) rows: AUC, cases, calibration-in-the-large, intercept, slope."""
    return binary_metrics(_rows(data, outcome, p, F.col(xb), subject=subject)).drop(BY)


def survival_calibration_metrics(
    data: DataFrame, outcome: str, p: str, xb: str, mean_xb: str, survival_time: str,
    subject: str = "pat_id",
) -> DataFrame:
    """(Metric, Value) rows: c-index, cases, calibration-in-the-large, Cox slope."""
    centred = F.col(xb) - F.col(mean_xb)
    return survival_metrics(_rows(data, outcome, p, centred, survival_time, subject)).drop(BY)


def binned_calibration(
    data: DataFrame, p: str, outcome: str, nbins: int = 10, subject: str = "pat_id"
) -> DataFrame:
    """Points and intervals of the binned calibration plot."""
    return calibration.binned_calibration(_rows(data, outcome, p, subject=subject), nbins).drop(BY)


def smoothed_calibration(
    data: DataFrame, outcome: str, p: str, subject: str = "pat_id"
) -> DataFrame:
    """Curve and band of the smoothed calibration plot."""
    return smoothing.smoothed_calibration(_rows(data, outcome, p, subject=subject)).drop(BY)


def risk_histogram(
    data: DataFrame, outcome: str, p: str, width: float = 0.0125, subject: str = "pat_id"
) -> DataFrame:
    """Bars below the calibration plots: counts and shares per risk bin."""
    return calibration.risk_histogram(_rows(data, outcome, p, subject=subject), width).drop(BY)


def survival_net_benefit(
    data: DataFrame, outcome: str, survival_time: str, p: str, time: float, thresholds=None,
    subject: str = "pat_id",
) -> DataFrame:
    """Decision curve of a survival outcome at one time."""
    rows = _rows(data, outcome, p, survival_time=survival_time, subject=subject)
    return netbenefit.survival_decision_curve(rows, [time], thresholds).drop(BY)


def binary_net_benefit(
    data: DataFrame, outcome: str, p: str, thresholds=None, strict: bool = False,
    subject: str = "pat_id",
) -> DataFrame:
    """Opt-in decision curve of a binary outcome."""
    rows = _rows(data, outcome, p, subject=subject)
    return netbenefit.binary_decision_curve(rows, thresholds, strict).drop(BY)


def misclassify_percentage_of_noncases(
    data: DataFrame, outcome: str, percentage: float, seed: int = 0, subject: str = "pat_id"
) -> DataFrame:
    """``data`` with exactly ``ceil(percentage * non-cases)`` random non-cases turned into cases."""
    controls = data.where(F.col(outcome) == 0)
    size = controls.count()
    ranked = random_rank(controls, subject, seed=seed)
    flips = F.col("random_rank") <= F.ceil(F.lit(size) * F.lit(float(percentage)))
    flipped = ranked.withColumn(outcome, F.when(flips, 1).otherwise(F.col(outcome)))
    return flipped.drop("random_rank").unionByName(
        data.where((F.col(outcome) != 0) | F.col(outcome).isNull())
    )
