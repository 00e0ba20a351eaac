"""Values as spreadsheet cells, and emptiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(value: Column, kind: str = "string") -> Column:
    """Null, blank text or an empty array; false and 0 are values."""
    if kind == "string":
        return value.isNull() | (F.trim(value) == "")
    return value.isNull() | (F.size(value) == 0) if kind in ("array", "map") else value.isNull()


def literal_guard(text: Column) -> Column:
    """Long numbers and those with leading zeros as a text formula, so that a spreadsheet keeps them."""
    return F.when(text.rlike(r"^\d+$") & ((F.length(text) >= 12) | (text.startswith("0") & (F.length(text) > 1))), F.concat(F.lit('="'), text, F.lit('"'))).otherwise(text)


def number_text(value: Column) -> Column:
    """Whole numbers below 10^15 without decimals, others to 12 significant digits with a decimal comma.

    Numbers under 0.0001 and, unless whole, from 10^12 are in exponent form (``1,5e-05``). Digits halfway go away from zero.
    """
    whole = value.try_cast("decimal(38,0)").cast("string")
    power = F.format_string("%.11e", value)
    exponent = F.regexp_extract(power, r"e([+-]\d+)$", 1).try_cast("int")
    short = F.regexp_replace(power, r"\.?0+e", "e")
    scale = F.lit(12) - F.greatest(F.floor(F.log10(F.abs(value))).cast("int") + 1, F.lit(-6))
    exact = lambda v: v.try_cast("decimal(38,18)").cast("string")
    rounded = exact(value)
    for digits in range(19):
        rounded = F.when(scale == digits, exact(F.round(value, digits))).otherwise(rounded)
    bare = F.regexp_replace(F.regexp_replace(rounded, r"0+$", ""), r"\.$", "")
    printed = F.when((exponent < -4) | (exponent >= 12), short).otherwise(bare)
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), whole).otherwise(F.replace(printed, F.lit("."), F.lit(",")))


def cell(value: Column, kind: str) -> Column:
    """Any value as cell text: null empty, booleans SI and NAO, numbers as ``number_text``, text guarded (P5)."""
    if kind == "boolean":
        text = F.when(value, "SI").otherwise("NAO")
    elif kind in ("double", "float", "int", "bigint", "long"):
        text = number_text(value.cast("double"))
    else:
        text = literal_guard(value.cast("string"))
    return F.when(value.isNull(), "").otherwise(text)
