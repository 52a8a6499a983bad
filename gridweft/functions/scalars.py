"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def strip_hash(c: Column) -> Column:
    """Without one leading ``#``."""
    return F.when(c.startswith("#"), F.substring(c, 2, 2**31 - 1)).otherwise(c)


def strip_underscore(c: Column) -> Column:
    """Without one leading ``_``."""
    return F.when(c.startswith("_"), F.substring(c, 2, 2**31 - 1)).otherwise(c)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def number(c: Column) -> Column:
    """A double from trimmed decimal text; null for anything else."""
    text = trimmed(c)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def whole(c: Column, kind: str = "int") -> Column:
    """A whole number from trimmed text; null for anything else."""
    text = trimmed(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))


def is_true(c: Column) -> Column:
    """True for the exact text ``true`` alone; null is false."""
    return F.coalesce(c == "true", F.lit(False))


def decode_entities(c: Column) -> Column:
    """Plus as a space, and the five XML entities, decoded once from left to right (so the ampersand comes last)."""
    out = F.translate(c, "+", " ")
    for entity, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(value))
    return out


def iso_seconds(c: Column) -> Column:
    """Seconds since 1970 of ``YYYY-MM-DDTHH:MM:SS``; what follows is ignored, days beyond a month's end roll over.

    Null for shorter or non-numeric texts, months outside 1-12 and days outside 1-31.
    """
    part = lambda at, n: whole(F.substring(c, at, n))
    year, month, day, hour, minute, second = part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2)
    days = F.datediff(F.make_date(year, F.when(month.between(1, 12), month), F.lit(1)), F.lit("1970-01-01").cast("date")) + day - 1
    return F.when((F.length(c) >= 19) & month.between(1, 12) & day.between(1, 31), days.cast("long") * 86400 + hour * 3600 + minute * 60 + second)


def enum_fragment(c: Column, without: str = "raw") -> Column:
    """What follows the last ``#`` and then the last dot; without a ``#`` the text itself, or null for ``without='null'``."""
    fragment = F.substring_index(F.substring_index(c, "#", -1), ".", -1)
    return F.when(c.contains("#"), fragment).otherwise(c if without == "raw" else F.lit(None).cast("string"))


def _choose(c: Column, table: dict[str, str], other: str | None) -> Column:
    out = F.lit(other).cast("string")
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


#: Energy source of a generating unit class.
ENERGY_SOURCES = {
    "HydroGeneratingUnit": "HYDRO",
    "NuclearGeneratingUnit": "NUCLEAR",
    "SolarGeneratingUnit": "SOLAR",
    "ThermalGeneratingUnit": "THERMAL",
    "WindGeneratingUnit": "WIND",
}
#: Kind of a switch class.
SWITCH_KINDS = {"Breaker": "BREAKER", "Disconnector": "DISCONNECTOR", "LoadBreakSwitch": "LOAD_BREAK_SWITCH"}


def energy_source(c: Column) -> Column:
    return _choose(c, ENERGY_SOURCES, "OTHER")


def switch_kind(c: Column) -> Column:
    return _choose(c, SWITCH_KINDS, None)


def _decimal_parts(x: Column) -> tuple[Column, Column, Column]:
    """Sign, significant digits (empty for zero) and place of the point before the first of them."""
    text = F.abs(x).cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(text.contains("E"), F.substring_index(text, "E", -1).try_cast("int")).otherwise(0)
    raw = F.replace(mantissa, F.lit("."), F.lit(""))
    head = F.ltrim(raw, F.lit("0"))
    point = F.length(F.substring_index(mantissa, ".", 1)) + exponent - (F.length(raw) - F.length(head))
    return F.when(x < 0, "-").otherwise(""), F.rtrim(head, F.lit("0")), point


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def float_json(x: Column) -> Column:
    """Decimal text without an exponent and with a fraction; ``null`` for null, NaN and infinities."""
    sign, digits, point = _decimal_parts(x)
    size = F.length(digits)
    plain = (
        F.when(size == 0, F.lit("0.0"))
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    return F.when(_finite(x), F.concat(sign, plain)).otherwise("null")


def float_scientific(x: Column) -> Column:
    """Shortest mantissa, ``E`` and exponent: -200 is ``-2E2``; ``null`` for what is not finite."""
    sign, digits, point = _decimal_parts(x)
    mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 400))).otherwise(digits)
    text = F.when(F.length(digits) == 0, F.lit("0E0")).otherwise(F.concat(sign, mantissa, F.lit("E"), (point - 1).cast("string")))
    return F.when(_finite(x), text).otherwise("null")


def float_auto(x: Column) -> Column:
    """Scientific from 1e10 on, else decimal."""
    return F.when(F.abs(x) >= 1e10, float_scientific(x)).otherwise(float_json(x))


def float_text(c: Column) -> Column:
    """Number text with a fraction: exponents are written out, a point is kept, else ``.0`` follows."""
    return F.when(c.rlike("[eE]"), float_json(number(c))).when(c.contains("."), c).otherwise(F.concat(c, F.lit(".0")))


def date_millis(c: Column) -> Column:
    """A timestamp text with milliseconds if it ends in ``Z`` and has none."""
    return F.when(c.contains(".") | ~c.endswith("Z"), c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit(".000Z")))
