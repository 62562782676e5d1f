"""Published risk equations as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import coefficients
from ..functions.numeric import at_least, at_most, natural_log


def _weighted_sum(weights: dict[str, float]) -> Column:
    terms = [
        F.lit(w) if name == "intercept" else F.lit(w) * F.col(name) for name, w in weights.items()
    ]
    return reduce(add, terms)


def _by_stratum(values: dict, pick) -> Column:
    """One value per (sex, race/ethnicity) stratum; NULL for everyone else."""
    out = None
    for (sex, raceth), value in values.items():
        here = (F.col("sex") == sex) & (F.col("raceth") == raceth)
        out = F.when(here, pick(value)) if out is None else out.when(here, pick(value))
    return out


def pce_risks(people: DataFrame) -> DataFrame:
    """Add Pooled Cohort Equation terms, ``xb`` and the 5- and 10-year risks."""
    ln_sbp = natural_log(F.col("systolic_bp"))
    treated = F.col("current_hypertensive_med_flag")
    logs = people.withColumns(
        {
            "ln_age": natural_log(F.col("age_yrs")),
            "ln_tc": natural_log(F.col("total_chol")),
            "ln_hdl": natural_log(F.col("hdl_chol")),
            "ln_treated_sbp": ln_sbp * treated,
            "ln_untreated_sbp": F.when(treated == 0, ln_sbp).when(treated != 0, 0.0),
        }
    )
    crossed = logs.withColumns(
        {
            "ln_age_squared": F.col("ln_age") * F.col("ln_age"),
            **{
                f"ln_age_{other}": F.col("ln_age") * F.col(other)
                for other in (
                    "ln_tc", "ln_hdl", "ln_treated_sbp", "ln_untreated_sbp", "current_smoker_flag",
                )
            },
        }
    )
    base = coefficients.PCE_BASELINE
    scored = crossed.withColumns(
        {
            "xb": _by_stratum(coefficients.PCE, _weighted_sum),
            "so_t5": _by_stratum(base, lambda b: F.lit(b[0])),
            "so_t10": _by_stratum(base, lambda b: F.lit(b[1])),
            "pce_mean_xb": _by_stratum(base, lambda b: F.lit(b[2])),
        }
    )
    relative = F.exp(F.col("xb") - F.col("pce_mean_xb"))
    return scored.withColumns(
        {
            "pce_risk_5yr": F.round(1 - F.pow(F.col("so_t5"), relative), 4),
            "pce_risk_10yr": F.round(1 - F.pow(F.col("so_t10"), relative), 4),
        }
    )


def prevent_terms(people: DataFrame) -> DataFrame:
    """Add the PREVENT features x1..x10, x12 and x14..x19."""
    age = (F.col("age_yrs") - 55) / F.lit(10.0)
    sbp, egfr = F.col("systolic_bp"), F.col("egfr")
    hdl_mmol = F.col("hdl_chol") * 0.02586
    features = people.withColumns(
        {
            "x1": age,
            "x2": (F.col("total_chol") - F.col("hdl_chol")) * 0.02586 - 3.5,
            "x3": (hdl_mmol - 1.3) / 0.3,
            "x4": (at_most(sbp, 110) - 110) / 20,
            "x5": (at_least(sbp, 110) - 130) / 20,
            "x6": F.col("diabetes_flag"),
            "x7": F.col("current_smoker_flag"),
            "x8": (at_most(egfr, 60) - 60) / -15,
            "x9": (at_least(egfr, 60) - 90) / -15,
            "x10": F.col("current_hypertensive_med_flag"),
        }
    )
    products = {
        "x12": ("x10", "x5"), "x14": ("x1", "x2"), "x15": ("x1", "x3"), "x16": ("x1", "x5"),
        "x17": ("x1", "x6"), "x18": ("x1", "x7"), "x19": ("x1", "x8"),
    }
    return features.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in products.items()})


def _prevent(people: DataFrame, weights: dict, outcome: str) -> DataFrame:
    log_odds = None
    for sex, w in weights.items():
        here = F.col("sex") == sex
        value = _weighted_sum(w)
        log_odds = F.when(here, value) if log_odds is None else log_odds.when(here, value)
    scored = prevent_terms(people).withColumn(f"log_odds_{outcome}", log_odds)
    odds = F.exp(F.col(f"log_odds_{outcome}"))
    return scored.withColumn(f"prevents_{outcome}_risk_10yr", odds / (1 + odds))


def prevent_ascvd_risks(people: DataFrame) -> DataFrame:
    """Add PREVENT features and the 10-year ASCVD risk."""
    return _prevent(people, coefficients.PREVENT_ASCVD, "ascvd")


def prevent_total_cvd_risks(people: DataFrame) -> DataFrame:
    """Add PREVENT features and the 10-year total-CVD risk."""
    return _prevent(people, coefficients.PREVENT_TOTAL_CVD, "total_cvd")
