"""Fixed-point lengths: one raw unit is a ten-thousandth of a mil."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_PER_MIL = 10_000
MILS_PER_MM = 39.37007874015748
INT_MIN, INT_MAX = -2_147_483_648, 2_147_483_647


def clamp_int(value: Column) -> Column:
    """A wide number as INT, held at the ends of its range (integer addition would throw)."""
    return F.greatest(F.lit(INT_MIN), F.least(F.lit(INT_MAX), value)).cast("int")


def saturating_add(a: Column, b: Column) -> Column:
    return clamp_int(a.cast("bigint") + b.cast("bigint"))


def saturating_sub(a: Column, b: Column) -> Column:
    return clamp_int(a.cast("bigint") - b.cast("bigint"))


def from_mils(mils: Column) -> Column:
    """Rounds half away from zero."""
    return clamp_int(F.round(mils.cast("double") * RAW_PER_MIL))


def from_mm(mm: Column) -> Column:
    return from_mils(mm.cast("double") * MILS_PER_MM)


def to_mm(raw: Column) -> Column:
    return raw.cast("double") / RAW_PER_MIL / MILS_PER_MM


def parse_length(text: Column) -> Column:
    """``10.5mil``, ``4mm``, ``1inch``, ``1in`` or raw units as INT; null where it is none of these."""
    t = F.trim(text)
    with_suffix = lambda s: F.trim(F.substring(t, F.lit(1), F.length(t) - len(s))).try_cast("double")
    return (
        F.when(t.endswith("mil"), from_mils(with_suffix("mil")))
        .when(t.endswith("mm"), from_mm(with_suffix("mm")))
        .when(t.endswith("inch"), from_mils(with_suffix("inch") * 1000))
        .when(t.endswith("in"), from_mils(with_suffix("in") * 1000))
        .otherwise(t.try_cast("int"))
    )


def trimmed_decimal(text: Column) -> Column:
    """A decimal text without trailing zeros, nor the point if nothing follows it."""
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def mil_text(raw: Column) -> Column:
    """``-1.25mil``: exact, from the integer."""
    wide = raw.cast("bigint")
    rest = F.abs(wide) % RAW_PER_MIL
    whole = ((F.abs(wide) - rest) / RAW_PER_MIL).cast("bigint")
    digits = F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 4, "0"))
    return F.concat(F.when(wide < 0, "-").otherwise(""), trimmed_decimal(digits), F.lit("mil"))


def fixed(value: Column, places: int) -> Column:
    """The double's exact value to so many places, ties to even, without grouping marks."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places if places else "0"))


def thousandths(text: Column) -> Column:
    """``4.310`` as 4310, half away from zero on the decimal text; null for exponents and for no digits."""
    t = F.trim(text)
    exact = F.round(t.try_cast("decimal(38,18)"), 3) * 1000
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), exact.cast("int"))


def mm_text(raw: Column) -> Column:
    """Millimetres with up to four decimals, and the unit."""
    return F.concat(trimmed_decimal(fixed(to_mm(raw), 4)), F.lit("mm"))


def rule_value_in_mm(key: Column, value: Column) -> Column:
    """A rule's value with lengths in millimetres: ``...mil`` as a whole, or the raw numbers of an OBJECTCLEARANCES list."""

    def pair(p: Column) -> Column:
        name, raw = F.regexp_extract(p, "^(.*):([^:]*)$", 1), F.trim(F.regexp_extract(p, "^(.*):([^:]*)$", 2)).try_cast("int")
        return F.when(p.contains(":") & raw.isNotNull(), F.concat(name, F.lit(":"), mm_text(raw))).otherwise(p)

    pairs = F.array_join(F.transform(F.split(value, ";"), pair), ";")
    number = F.trim(F.regexp_extract(value, "^(.*)mil$", 1)).try_cast("double")
    return F.when(F.upper(key) == "OBJECTCLEARANCES", pairs).when(value.endswith("mil") & number.isNotNull(), mm_text(from_mils(number))).otherwise(value)
