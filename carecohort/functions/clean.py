"""Text-to-number cleaning of results and readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Only the FIRST comparison sign or thousands comma is dropped, so ">1,000"
# keeps its comma and is then not a number.
_FIRST_MARK = r"^([^=><,]*)[=><,]"
_PLAIN = r"^[0-9]{1,9}$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def whole_number(text: Column) -> Column:
    """Integer value of a decimal string, halves rounded away from zero, else NULL."""
    as_double = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.round(as_double).try_cast("int")


def result_value(text: Column) -> Column:
    """Integer value of a laboratory result such as ``<5`` or ``12.7``.

    Plain integers, nearly all results, are cast directly; a failing ``try_cast``
    raises internally and is far slower than the pattern that avoids it.
    """
    return F.when(text.rlike(_PLAIN), text.try_cast("int")).otherwise(
        whole_number(F.regexp_replace(text, _FIRST_MARK, "$1"))
    )


def leading_digits(text: Column) -> Column:
    """Digits the text starts with, ``''`` when it starts with something else."""
    return F.regexp_extract(text, r"^[0-9]*", 0)


def contains_any(text: Column, fragments) -> Column:
    """True when any fragment occurs anywhere in the text (case-sensitive)."""
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | text.contains(fragment)
    return hit


def recode(value: Column, mapping: dict, default) -> Column:
    """Map raw values to reporting values; anything unlisted, NULL too, gets ``default``."""
    by_target: dict = {}
    for raw, target in mapping.items():
        by_target.setdefault(target, []).append(raw)
    out = None
    for target, raws in by_target.items():
        hit = value.isin(raws)
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out.otherwise(default)
