"""Column builders for the meaning of one cell, shared by operators, constraints, profiles and sinks.

A cell is empty if it is null or "". White space is a value; only ``strip`` removes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x1c-\x1f\x85]"
STRIP = rf"(?U)^{SPACES}+|{SPACES}+$"
# Words read as booleans.
TRUE_WORDS = ("true", "1", "yes", "y", "t", "是", "真")
FALSE_WORDS = ("false", "0", "no", "n", "f", "否", "假")
# Formats tested by pattern. Repeated groups never give back, so cells of any length need no deep stack.
EMAIL = r"\A[^@\s]+@[^@\s.]+(\.[^@\s.]+)++\z"
URL = r"(?i)\Ahttps?://[^\s/$.?#].[^\s]*\z"
IPV4 = r"\A(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z"
INTEGER = r"\A[+-]?[0-9]+(_[0-9]+)*+\z"
FLOAT = r"(?i)\A[+-]?((([0-9]+(_[0-9]+)*+)(\.([0-9]+(_[0-9]+)*+)?)?|\.[0-9]+(_[0-9]+)*+)(e[+-]?[0-9]+(_[0-9]+)*+)?|nan|inf|infinity)\z"


def text(c: Column) -> Column:
    """The cell as text without a special form; null stays null."""
    return c.cast("string")


def is_empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def cell_text(c: Column, kind: str = "string") -> Column:
    """Canonical text by Spark type: "" for null, whole numbers without a decimal point."""
    if kind == "boolean":
        out = F.when(c, "true").otherwise("false")
    elif kind in ("double", "float"):
        value, shown = c.cast("double"), c.cast("double").cast("string")
        whole = (F.floor(value).cast("double") == value) & (F.abs(value) < 1e15)
        plain = F.rtrim(shown.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
        power = F.split_part(shown, F.lit("E"), F.lit(2))
        digits = F.replace(power, F.lit("-"), F.lit(""))
        digits = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
        science = F.concat(F.regexp_replace(F.split_part(shown, F.lit("E"), F.lit(1)), r"\.0$", ""), F.when(power.startswith("-"), "e-").otherwise("e+"), digits)
        out = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
        out = out.when(whole, value.cast("decimal(16,0)").cast("string"))
        out = out.when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e16), F.regexp_replace(plain, r"\.$", ".0")).otherwise(science)
    elif kind == "date":
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def to_double(c: Column) -> Column:
    """Text that reads as a float, with its underscores and special words; else null. Never a suffix such as 1.5f."""
    t = strip(c.cast("string"))
    bare = F.lower(F.regexp_replace(t, "_", ""))
    named = F.regexp_replace(bare, r"\A([+-]?)inf(inity)?\z", "$1Infinity")
    named = F.regexp_replace(named, r"\A[+-]?nan\z", "NaN")
    return F.when(t.rlike(FLOAT), named.try_cast("double"))


def is_number(kind: str) -> bool:
    return kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")


def number(c: Column, kind: str = "string") -> Column:
    """The cell as a double: numeric columns as they are, text as it reads, booleans never."""
    if is_number(kind):
        return c.cast("double")
    return F.lit(None).cast("double") if kind == "boolean" else to_double(c)


def to_decimal(c: Column) -> Column:
    """Finite number as decimal(38,18); null where it is none or does not fit."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(FLOAT) & ~t.rlike(r"(?i)nan|inf"), F.regexp_replace(t, "_", "").try_cast("decimal(38,18)"))


def magnitudes(c: Column) -> tuple[Column, Column, Column]:
    """A finite number as decimal(38,18), as a whole decimal(38,0) and as a double: to compare by the first that both sides have."""
    t = strip(c.cast("string"))
    plain, bare = t.rlike(FLOAT) & ~t.rlike(r"(?i)nan|inf"), F.regexp_replace(t, "_", "")
    whole = F.when(t.rlike(INTEGER), bare.try_cast("decimal(38,0)"))
    return to_decimal(c), whole, F.when(plain, bare.try_cast("double"))


def to_integer(c: Column) -> Column:
    """Integer literal of any sign up to 38 digits, or a float that is whole (3.0, 1e3); else null."""
    t = strip(c.cast("string"))
    literal = F.when(t.rlike(INTEGER), F.regexp_replace(t, "_", "").try_cast("decimal(38,0)"))
    value = to_double(c)
    whole = F.when((F.abs(value) < 1e30) & (F.floor(value).cast("double") == value), value.try_cast("decimal(38,0)"))
    return F.coalesce(literal, whole)


def castable(c: Column, kind: str) -> Column:
    """Whether a non-empty cell reads as the type."""
    t = strip(c.cast("string"))
    if kind == "str":
        ok = F.lit(True)
    elif kind == "int":
        ok = t.rlike(INTEGER)
    elif kind == "float":
        ok = t.rlike(FLOAT)
    elif kind == "bool":
        ok = F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS)
    elif kind in ("date", "datetime"):
        from sievewright.functions.patterns import parse_time

        ok = parse_time(c, ()).isNotNull()
    else:
        raise ValueError(f"unknown type {kind!r}")
    return ~is_empty(c) & F.coalesce(ok, F.lit(False))


def has_format(c: Column, kind: str, formats: tuple[str, ...] = ()) -> Column:
    t = c.cast("string")
    if kind == "email":
        ok = t.rlike(EMAIL)
    elif kind == "url":
        ok = t.rlike(URL)
    elif kind == "ipv4":
        parts = F.split(t, r"\.")
        ok = F.when(t.rlike(IPV4), F.forall(parts, lambda p: p.cast("int") <= 255)).otherwise(False)
    elif kind in ("date", "datetime", "time"):
        from sievewright.functions.patterns import parse_time

        ok = parse_time(c, formats).isNotNull()
    else:
        raise ValueError(f"unknown format {kind!r}")
    return F.coalesce(ok, F.lit(False))


def neutral_formula(c: Column) -> Column:
    """A leading = + - @ tab or return gets a quote before it, so spreadsheets show it as text."""
    return F.when(c.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def sliced(c: Column, start: int | None, end: int | None) -> Column:
    """Half-open slice by code points; negative bounds count from the end."""
    n = F.length(c)

    def bound(v: int | None, default: Column) -> Column:
        if v is None:
            return default
        return F.greatest(F.least(F.lit(v), n), F.lit(0)) if v >= 0 else F.greatest(n + F.lit(v), F.lit(0))

    a, b = bound(start, F.lit(0)), bound(end, n)
    return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))


def number_text(c: Column, decimals: int | None, thousands: bool = False, kind: str = "float") -> Column:
    """Number rounded half up as text; null where the cell is not a finite number."""
    return F.coalesce(_number_text(to_decimal(c), decimals, thousands, kind), _number_text(_large(c), decimals, thousands, kind))


def _large(c: Column) -> Column:
    """A finite number too large for decimal(38,18), to its last whole digit, up to 38 digits."""
    t = strip(c.cast("string"))
    long = (F.length(c) > 20) | c.contains("e") | c.contains("E")  # all others fit decimal(38,18)
    return F.when(long & t.rlike(FLOAT) & ~t.rlike(r"(?i)nan|inf"), F.regexp_replace(t, "_", "").try_cast("decimal(38,0)"))


def _number_text(value: Column, decimals: int | None, thousands: bool, kind: str) -> Column:
    if decimals is None and kind != "int":
        out = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        if not thousands:
            return out
        head = F.regexp_replace(F.split(out, r"\.")[0], r"(\d)(?=(\d{3})+$)", "$1,")
        return F.when(out.contains("."), F.concat(head, F.lit("."), F.split(out, r"\.").getItem(1))).otherwise(head)
    places = decimals or 0
    rounded = F.round(value, places)
    fits = rounded.try_cast(f"decimal(38,{places})")
    text = F.coalesce(fits.cast("string"), F.concat(rounded.cast("string"), F.lit("." + "0" * places if places else "")))
    if not thousands:
        return text
    head = F.regexp_replace(F.split(text, r"\.")[0], r"(\d)(?=(\d{3})+$)", "$1,")
    return F.concat(head, F.when(text.contains("."), F.concat(F.lit("."), F.split(text, r"\.").getItem(1))).otherwise(""))
