"""Numeric helpers: knots, logarithms, significant digits, report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_most(value: Column, knot: float) -> Column:
    """Smaller of value and knot; a missing value stays missing."""
    return F.when(value.isNotNull(), F.least(value.cast("double"), F.lit(float(knot))))


def at_least(value: Column, knot: float) -> Column:
    """Larger of value and knot; a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(value.cast("double"), F.lit(float(knot))))


def natural_log(value: Column) -> Column:
    """Natural logarithm with log(0) = -Infinity and log(negative) = NaN."""
    v = value.cast("double")
    return (
        F.when(v > 0, F.ln(v))
        .when(v == 0, F.lit(float("-inf")))
        .when(v < 0, F.lit(float("nan")))
    )


def _once(value: Column, build) -> Column:
    """``build(value)`` with the value computed once, for report-sized rows only."""
    return F.element_at(F.transform(F.array(value), build), 1)


def significant(value: Column, digits: int) -> Column:
    """Round to a number of significant digits; 0 stays 0."""

    def rounded(v):
        places = F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(v)))
        # Dividing by a power of ten keeps results such as 0.07 exact.
        up = F.round(v * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
        down = F.round(v / F.pow(F.lit(10.0), -places)) * F.pow(F.lit(10.0), -places)
        return F.when(v == 0, F.lit(0.0)).when(places >= 0, up).otherwise(down)

    return _once(value.cast("double"), rounded)


def number_text(value: Column) -> Column:
    """Number as report text: no trailing ``.0``, exponents like ``1e-05``."""

    def written(text):
        mantissa = F.regexp_replace(F.regexp_extract(text, r"^([^E]+)E", 1), r"\.0$", "")
        sign = F.when(text.contains("E-"), "-").otherwise("+")
        power = F.lpad(F.regexp_extract(text, r"E-?(\d+)$", 1), 2, "0")
        return F.when(
            text.contains("E"), F.concat(mantissa, F.lit("e"), sign, power)
        ).otherwise(F.regexp_replace(text, r"\.0$", ""))

    return _once(value.cast("string"), written)


def with_interval(value: Column, low: Column, high: Column) -> Column:
    """``value (low, high)`` as report text."""
    return F.concat(
        number_text(value), F.lit(" ("), number_text(low), F.lit(", "), number_text(high), F.lit(")")
    )
