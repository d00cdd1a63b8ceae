"""Translators run once on the driver: time formats, regex replacements and text templates to Spark forms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.cells import strip

# Strptime directives and the lenient Java letters that read alike.
READ = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "h", "f": "SSSSSS", "%": "%"}
# Strftime directives and the padded Java letters that print alike.
WRITE = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh", "f": "SSSSSS", "j": "DDD", "a": "EEE", "A": "EEEE", "%": "%"}
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
ISO_BASIC = r"\d{8}"
ISO_TIME = r"[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?"


def time_pattern(fmt: str, table: dict[str, str]) -> str:
    """A strptime/strftime format as a Java pattern; unknown directives are refused."""
    parts: list[tuple[bool, str]] = []  # (literal, text)
    for m in re.finditer(r"%(.?)|[^%]+", fmt, re.S):
        if m[0][0] != "%":
            parts.append((True, m[0]))
        elif m[1] not in table or not m[1]:
            raise ValueError(f"time format {fmt!r} has a directive that is not supported")
        else:
            parts.append((m[1] == "%", table[m[1]]))
    quoted = lambda t: "'" + t.replace("'", "''") + "'" if re.search("[A-Za-z'\\[\\]{}#]", t) else t
    return "".join(quoted(t) if literal else t for literal, t in parts)


def parse_time(c: Column, formats: tuple[str, ...] | list[str] = ()) -> Column:
    """timestamp_ntz by the first format that fits; without formats by ISO 8601 forms only."""
    t = strip(c.cast("string"))
    if formats:
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(time_pattern(f, READ))).cast("timestamp_ntz") for f in formats])
    basic = F.regexp_replace(t, rf"\A(\d{{4}})(\d{{2}})(\d{{2}})(?={ISO_TIME}\z|\z)", "$1-$2-$3")
    full = F.when(basic.rlike(rf"\A{ISO_DATE}({ISO_TIME})?\z"), F.regexp_replace(basic, r"([T ]\d{2})\z", "$1:00"))
    return full.try_cast("timestamp_ntz")


def write_time(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, time_pattern(fmt, WRITE))


def replacement(template: str, groups: int, names: dict[str, int] | None = None) -> str:
    r"""A ``\1`` style replacement as Java's; group numbers beyond the pattern's are refused."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c == "\\" and i + 1 < len(template):
            n = re.match(r"\\(?:g<(\w+)>|(\d{1,2}))", template[i:])
            if n:
                number = int(n[1] or n[2]) if (n[1] or n[2]).isdigit() else (names or {}).get(n[1], groups + 1)
                if number > groups:
                    raise ValueError(f"replacement names group {number} of {groups}")
                out.append(f"${number}")
                i += len(n[0])
                if i < len(template) and template[i].isdigit():
                    out.append(f"\\{template[i]}")
                    i += 1
                continue
            out.append({"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}.get(template[i + 1], template[i + 1]))
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def compiled(pattern: str) -> re.Pattern:
    """The pattern if it compiles and holds no repeat inside a repeat."""
    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*]", pattern):
        raise ValueError(f"pattern {pattern!r} repeats a repeat")
    return re.compile(pattern)


def java(pattern: str) -> str:
    r"""The pattern in Java's words: groups named the Python way by number, ``\Z`` as the very end."""
    names = {n: f"g{k}" for n, k in re.compile(pattern).groupindex.items()}
    out = re.sub(r"\\(?:Z|.)|\(\?P<(\w+)>|\(\?P=(\w+)\)", lambda m: f"(?<{names[m[1]]}>" if m[1] else f"\\k<{names[m[2]]}>" if m[2] else r"\z" if m[0] == r"\Z" else m[0], pattern, flags=re.S)
    if re.search(r"(?<!\\)\(\?\((?:\d+|\w+)\)", out):
        raise ValueError(f"pattern {pattern!r} has a conditional group, which Java lacks")
    return out


def ambiguous(pattern: str) -> bool:
    """Whether a repeated group holds alternatives, so that backtracking may try every way through a text."""
    return bool(re.search(r"\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)[+*{]", pattern))


def matches(c: Column, pattern: str, mode: str = "fullmatch") -> Column:
    """Whether the text matches. Patterns with repeated alternatives are matched in linear time by Arrow's RE2 if it knows them."""
    if ambiguous(pattern):
        import pyarrow as pa
        import pyarrow.compute as pc

        wanted = rf"\A(?:{pattern})\z" if mode == "fullmatch" else pattern
        try:
            pc.match_substring_regex(pa.array([""]), wanted)
        except pa.ArrowInvalid:
            pass  # looks around or back: Java's engine
        else:
            @F.pandas_udf("boolean")
            def linear(texts: pd.Series) -> pd.Series:
                return pc.match_substring_regex(pa.array(texts, pa.string()), wanted).to_pandas()

            return linear(c)
    return c.rlike(whole(java(pattern)) if mode == "fullmatch" else java(pattern))


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """Literal text as (text, None), ``${field}`` and ``${field:-default}`` as (field, default or "")."""
    out, at = [], 0
    for m in re.finditer(r"\$\{([^{}:]+?)(?::-([^{}]*))?\}", template):
        if m.start() > at:
            out.append((template[at : m.start()], None))
        out.append((m[1].strip(), m[2] or ""))
        at = m.end()
    if at < len(template):
        out.append((template[at:], None))
    return out


def render(template: str, cells: dict[str, Column]) -> Column:
    """The template over canonical texts; a blank or absent field gives its default."""
    parts = []
    for name, default in template_parts(template):
        if default is None:
            parts.append(F.lit(name))
        elif name not in cells:
            raise ValueError(f"template names unknown field {name!r}")
        else:
            parts.append(F.when(F.coalesce(strip(cells[name]), F.lit("")) == "", F.lit(default)).otherwise(cells[name]))
    return F.concat(*parts) if parts else F.lit("")
