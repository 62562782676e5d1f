"""Performance reports over the scored tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import number_text, significant, with_interval
from ..operators import calibration, discrimination, fits, netbenefit, tableone
from ..operators.dropin import statin_drop_in
from ..operators.evaluation import BY, misclassified, rows_for
from ..operators.ranking import bucket_edges
from ..sources.extracts import stacked
from ..storage import written
from .cohort import CohortBuild

PCE_5YR, PCE_10YR = "PCE 5yr", "PCE 10yr"
ASCVD, TOTAL_CVD = "PREVENTS ASCVD", "PREVENTS Total CVD"
MODELS = (PCE_5YR, PCE_10YR, ASCVD, TOTAL_CVD)
SHARES = (0.005, 0.01)

# Report order of the metric names.
METRICS = (
    "Harrell's c-index", "AUC", "Expected cases (risk)", "Observed cases (risk)",
    "Calibration-in-the-large", "Intercept", "Slope",
)


class Validation:
    """Evaluation tables and reports of one cohort build."""

    def __init__(self, build: CohortBuild):
        self.build = build

    @cached_property
    def survival_rows(self) -> DataFrame:
        """Evaluation rows of the PCE models; 5-year rows keep their full follow-up."""
        centred = F.col("xb") - F.col("pce_mean_xb")
        years = "ascvd_followup_years"
        return written(
            stacked([
                rows_for(self.build.pce, PCE_5YR, "ascvd_5yr_flag", "pce_risk_5yr", centred, years),
                rows_for(self.build.pce, PCE_10YR, "ascvd_10yr_flag", "pce_risk_10yr", centred, years),
            ]),
            "survival_rows",
        )

    @cached_property
    def binary_rows(self) -> DataFrame:
        """Evaluation rows of the PREVENT models."""
        return written(
            stacked([
                rows_for(
                    self.build.prevent_ascvd, ASCVD, "ascvd_10yr_flag", "prevents_ascvd_risk_10yr",
                    "log_odds_ascvd", "ascvd_followup_years",
                ),
                rows_for(
                    self.build.prevent_total_cvd, TOTAL_CVD, "total_cvd_10yr_flag",
                    "prevents_total_cvd_risk_10yr", "log_odds_total_cvd", "total_cvd_followup_years",
                ),
            ]),
            "binary_rows",
        )

    # --- metric tables -----------------------------------------------------------

    def metrics(self) -> DataFrame:
        """(series, Metric, Value) of all four models."""
        return report_metrics(self.survival_rows, self.binary_rows)

    def metrics_wide(self) -> DataFrame:
        """One row per metric, one column per model; a metric a model lacks is NULL."""
        place = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("Metric"))
        return (
            self.metrics().groupBy("Metric").pivot(BY, list(MODELS)).agg(F.first("Value"))
            .withColumn("position", place.cast("int"))
        )

    def sensitivity(self, seed: int = 0) -> DataFrame:
        """Metrics after counting 0.5 % and 1 % of the non-cases as cases."""
        flipped = written(misclassified(stacked([self.survival_rows, self.binary_rows]), SHARES, seed), "flipped")
        survival = F.substring_index(BY, "|", 1).isin(PCE_5YR, PCE_10YR)
        rows = report_metrics(flipped.where(survival), flipped.where(~survival))
        part = F.split(F.col(BY), r"\|")
        return rows.select(
            part[0].alias("Model"), part[1].cast("double").alias("Misclassification"), "Metric", "Value"
        )

    # --- other reports -------------------------------------------------------------

    def table_one_sets(self) -> dict[str, tuple[DataFrame, str, str]]:
        """Analysis sets with their outcome; PCE needs no eGFR, so it is shown as unknown."""
        return {
            "PCE": (
                self.build.pce.withColumn("egfr", F.lit(None).cast("double")), "ascvd_5yr_flag", "ASCVD",
            ),
            ASCVD: (self.build.prevent_ascvd, "ascvd_10yr_flag", "ASCVD"),
            TOTAL_CVD: (self.build.prevent_total_cvd, "total_cvd_10yr_flag", "Total CVD"),
        }

    def table_one_part(self, part) -> DataFrame:
        """One of ``tableone.continuous/categorical/missing`` for all three sets."""
        return stacked([
            part(tableone.grouped(people, outcome, label)).withColumn("model", F.lit(model))
            for model, (people, outcome, label) in self.table_one_sets().items()
        ])

    def statin_drop_in(self) -> DataFrame:
        build = self.build
        return stacked([
            statin_drop_in(build.pce, "PCE 5 yr", "ascvd", within_years=5),
            statin_drop_in(build.pce, "PCE 10 yr", "ascvd"),
            statin_drop_in(build.prevent_ascvd, ASCVD, "ascvd"),
            statin_drop_in(build.prevent_total_cvd, TOTAL_CVD, "total_cvd"),
        ])

    def survival_curves(self, model: str) -> DataFrame:
        """Full and detailed decision curves of a PCE model.

        The published 10-year detail plot is evaluated at five years; both horizons
        are given.
        """
        rows = self.survival_rows.where(F.col(BY) == model)
        if model == PCE_5YR:
            views = [("full", 5, netbenefit.FULL_SURVIVAL), ("detail", 5, netbenefit.DETAIL_5YR)]
        else:
            views = [
                ("full", 10, netbenefit.FULL_SURVIVAL),
                ("detail", 5, netbenefit.DETAIL_10YR),
                ("detail", 10, netbenefit.DETAIL_10YR),
            ]
        horizons = sorted({h for _, h, _ in views})
        # the detail grids are part of the full one
        return netbenefit.in_views(netbenefit.survival_decision_curve(rows, horizons), views)

    def binary_curves(self, model: str) -> DataFrame:
        rows = self.binary_rows.where(F.col(BY) == model)
        detail = netbenefit.DETAIL_ASCVD if model == ASCVD else netbenefit.DETAIL_TOTAL_CVD
        views = [("full", netbenefit.FULL_BINARY), ("detail", detail)]
        return netbenefit.in_views(netbenefit.binary_decision_curve(rows), views)


def _metric_rows(frame: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(name).alias("Metric"), value.alias("Value")) for name, value in values.items()
    ])
    return frame.withColumn("_m", F.explode(pairs)).select(BY, "_m.*")


def _count_with_risk(count: str, risk: str) -> Column:
    return F.concat(F.col(count).cast("string"), F.lit(" ("), number_text(F.col(risk)), F.lit(")"))


def _case_values() -> dict[str, Column]:
    return {
        "Expected cases (risk)": _count_with_risk("expected_cases", "expected_risk"),
        "Observed cases (risk)": _count_with_risk("observed_cases", "observed_risk"),
        "Calibration-in-the-large": number_text(F.col("in_the_large")),
    }


def _interval(name: str) -> Column:
    return with_interval(*[significant(F.col(c), 2) for c in (name, f"{name}_low", f"{name}_high")])


def report_metrics(survival: DataFrame | None, binary: DataFrame | None) -> DataFrame:
    """(series, Metric, Value) as report text, of survival models and of binary ones.

    All series share one pass for the cuts of risks and times and one job per step of
    the fits.  Binary models get AUC, cases, calibration-in-the-large, intercept and
    slope; survival models c-index, cases, calibration-in-the-large and Cox slope.
    """
    given = [rows for rows in (survival, binary) if rows is not None]
    risks, times = bucket_edges(stacked(given), ["risk", "years"])
    logistic, cox = fits.calibrations(binary, survival, times)
    reports = []
    if survival is not None:
        frame = (
            calibration.expected_observed(survival)
            .join(discrimination.concordance(survival, edges=(risks, times)), [BY]).join(cox, [BY])
        )
        reports.append(_metric_rows(frame, {
            "Harrell's c-index": number_text(significant(F.col("cindex"), 3)), **_case_values(),
            "Slope": _interval("slope"),
        }))
    if binary is not None:
        frame = (
            calibration.expected_observed(binary).join(discrimination.auc(binary, risks), [BY]).join(logistic, [BY])
        )
        reports.append(_metric_rows(frame, {
            "AUC": _interval("auc"), **_case_values(),
            "Intercept": _interval("intercept"), "Slope": _interval("slope"),
        }))
    return stacked(reports)


def binary_metrics(rows: DataFrame) -> DataFrame:
    """AUC, cases, calibration-in-the-large, intercept and slope as report text."""
    return report_metrics(None, rows)


def survival_metrics(rows: DataFrame) -> DataFrame:
    """c-index, cases, calibration-in-the-large and Cox slope as report text."""
    return report_metrics(rows, None)
