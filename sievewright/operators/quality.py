"""Constraints, their repair, unique resolution and the re-check of results."""

from __future__ import annotations

import dataclasses
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import cells, patterns
from sievewright.operators.clean import FILE, ROW, text_of
from sievewright.plans.config import KINDS, Constraint, FieldSpec


def ordered(constraints: tuple[Constraint, ...]) -> list[Constraint]:
    return sorted(constraints, key=lambda c: KINDS.index(c.kind))


def violates(c: Column, k: Constraint, repeated: Column | None = None, dtype: str = "string") -> Column:
    """Whether a cell of Spark type ``dtype`` breaks the constraint. ``repeated`` tells of uniqueness."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    empty = cells.is_empty(c)
    match k.kind:
        case "non_null":
            return empty
        case "enum":
            fold = (lambda s: s) if k.case_sensitive else (lambda s: s.lower())
            return ~(text if k.case_sensitive else F.lower(text)).isin(*[fold(v) for v in k.values])
        case "regex":
            return ~patterns.matches(text, k.pattern, k.mode)
        case "length":
            n, out = F.length(text), F.lit(False)
            out = out | (n < k.min_length) if k.min_length is not None else out
            return out | (n > k.max_length) if k.max_length is not None else out
        case "range":
            value = cells.number(c, dtype)
            out = value.isNull()
            low = (value < k.min_value) & ~F.isnan(value) if k.min_value is not None else F.lit(False)
            high = (value > k.max_value) & ~F.isnan(value) if k.max_value is not None else F.lit(False)
            return F.coalesce(out | low | high, F.lit(True))
        case "format":
            return ~cells.has_format(c, k.format, k.formats)
        case "type":
            return ~cells.castable(c, k.type)
    if repeated is None:
        raise ValueError("unique needs the rows before")
    return ~empty & repeated


def marked(df: DataFrame, spec: FieldSpec) -> DataFrame:
    """Adds ``__again_<dest>`` if the field must be unique: an earlier row in order has the same non-empty text.

    Rows that broke an earlier constraint take no part. First rows come from a partial aggregate and are joined back
    with a hash of the text beside it, so both sides are shuffled for the join and a hot text's rows can be split.
    """
    unique = [k for k in ordered(spec.constraints) if k.kind == "unique"]
    if not unique:
        return df
    order = [c for c in (FILE, ROW) if c in df.columns]
    by = [FILE] if unique[0].unique_scope == "file" and FILE in df.columns else []
    text = F.when(violation(df, _without_unique(spec)).isNull(), F.nullif(text_of(df, spec.dest), F.lit("")))
    keyed = df.withColumn("__text", text).withColumn("__hash", F.xxhash64("__text"))
    firsts = keyed.filter("__text IS NOT NULL").groupBy(*by, "__text").agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("__n"))
    firsts = firsts.filter("__n > 1").select(*by, "__text", F.xxhash64("__text").alias("__hash"), "__first")
    again = F.col("__first").isNotNull() & (F.struct(*order) != F.col("__first"))
    return keyed.join(firsts, [*by, "__hash", "__text"], "left").withColumn(f"__again_{spec.dest}", F.coalesce(again, F.lit(False))).select(*df.columns, f"__again_{spec.dest}")


def _without_unique(spec: FieldSpec) -> FieldSpec:
    return dataclasses.replace(spec, constraints=tuple(k for k in spec.constraints if k.kind != "unique"))


def violation(df: DataFrame, spec: FieldSpec) -> Column:
    """The kind of the first broken error constraint, or null; later ones are not evaluated. Uniqueness needs ``marked`` rows."""
    first = F.lit(None).cast("string")
    for k in ordered(spec.constraints):
        if k.severity == "warn":
            continue
        again = F.col(f"__again_{spec.dest}") if k.kind == "unique" else None
        first = F.coalesce(first, F.when(violates(F.col(spec.dest), k, again, df.schema[spec.dest].dataType.simpleString()), F.lit(k.kind)))
    return first


def warnings(spec: FieldSpec) -> dict[str, Column]:
    """Counts of broken warn constraints, by row."""
    return {f"{spec.dest}:{k.kind}": F.count_if(violates(F.col(spec.dest), k)) for k in ordered(spec.constraints) if k.severity == "warn"}


def repaired(c: Column, kind: Column, spec: FieldSpec, dtype: str = "string") -> tuple[Column, Column]:
    """(value after the fallback, whether it could not be repaired); unique is resolved by ``resolve_unique``."""
    text, fb = F.coalesce(c.cast("string"), F.lit("")), spec.fallback
    if fb.on_violation != "truncate":
        return c.cast("string"), F.lit(False)
    value, degraded = c.cast("string"), kind.isin("enum", "format", "type")
    value = F.when(kind == "non_null", F.lit(fb.default or "")).otherwise(value)
    for k in spec.constraints:
        if k.kind == "regex":
            found = F.regexp_extract(text, patterns.java(k.pattern), 0) if k.mode == "search" else F.lit("")
            value = F.when((kind == "regex") & (found != ""), found).otherwise(value)
            degraded = degraded | ((kind == "regex") & (found == ""))
        elif k.kind == "length":
            if k.max_length is not None:
                value = F.when((kind == "length") & (F.length(text) > k.max_length), F.substring(text, 1, k.max_length)).otherwise(value)
            if k.min_length is not None:
                value = F.when((kind == "length") & (F.length(text) < k.min_length), F.rpad(text, k.min_length, k.pad_char)).otherwise(value)
        elif k.kind == "range":
            number = cells.number(c, dtype)
            held = number
            held = F.greatest(held, F.lit(float(k.min_value))) if k.min_value is not None else held
            held = F.least(held, F.lit(float(k.max_value))) if k.max_value is not None else held
            integral = dtype in ("int", "bigint", "smallint", "tinyint")
            whole = F.lit(integral) if cells.is_number(dtype) else cells.strip(text).rlike(r"\A[+-]*[0-9]+\z")
            shown = F.when(whole, held.cast("bigint").cast("string")).otherwise(held.cast("string") if integral else cells.cell_text(held, "double"))
            value = F.when((kind == "range") & number.isNotNull(), shown).otherwise(value)
            degraded = degraded | ((kind == "range") & number.isNull())
    return value, F.coalesce(degraded, F.lit(False))


def repeat_number(df: DataFrame, key: str, by: list[str], order: list[str], block: int = 100_000, counted: Column | None = None) -> DataFrame:
    """Adds ``__k``: how many earlier rows (of those ``counted``) have the same key. Rows are counted within blocks of row numbers and block counts are carried on."""
    cut = df.withColumns({"__block": F.floor(F.col(ROW) / block), "__one": F.lit(1) if counted is None else counted.cast("int")})
    file = [c for c in order if c != ROW]
    at = [*by, key, *[c for c in file if c not in by], "__block"]
    before = Window.partitionBy(*by, key).orderBy(*[c for c in file if c not in by], "__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*at).agg(F.sum("__one").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = Window.partitionBy(*at).orderBy(*order)
    own = F.row_number().over(rows) - 1 if counted is None else F.coalesce(F.sum("__one").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__own", own).join(sizes, at).withColumn("__k", F.col("__start") + F.col("__own")).drop("__block", "__own", "__start", "__one")


SUFFIX_BLOCK = 4096  # repeats of one text that share a row of the suffix table


def _numbered(texts: pd.DataFrame, size_of_block: int) -> list[tuple[str, int, int, int, list[tuple[int, int]]]]:
    """For each text of one stem and block of its occurrences: (text, block, first, base, steps).

    Occurrence k is repeat ``j = k + first`` (0: it keeps its text) and takes number j plus ``base``, or plus the last step at or below j.
    A number is passed over if the text that has it came before; otherwise that text has lost its own and is a repeat from the start.
    """
    size = dict(zip(texts["__text"], texts["n"], strict=True))
    below: dict[str, list[tuple[int, int, str]]] = {}
    for t, parent, number, earlier in texts[["__text", "parent", "number", "earlier"]].itertuples(index=False):
        if parent in size:
            below.setdefault(parent, []).append((int(number), int(earlier), t))
    lost, out = set(), []
    for t in sorted(size, key=len):  # a text comes after those it may lose its own to
        first, passed = int(t in lost), []
        for number, earlier, child in sorted(below.get(t, ())):
            j = number - len(passed)
            if j > size[t] - 1 + first:
                break
            if max(0, earlier - 1 + first) < j:
                passed.append(j)
            else:
                lost.add(child)
        steps = [(at, i + 1) for i, at in enumerate(passed) if i + 1 == len(passed) or passed[i + 1] != at]
        for block, start in enumerate(range(first, size[t] + first, size_of_block)):
            low, high = bisect_left(steps, (start, 0)), bisect_left(steps, (start + size_of_block, 0))
            out.append((t, block, first, steps[low - 1][1] if low else 0, steps[low:high]))
    return out


def _mixed_unique(found: DataFrame, name: str, suffix: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows of stems whose texts differ, by counts: only the distinct texts of a stem meet in one task, never its rows."""
    place, each = F.struct(*order), SUFFIX_BLOCK
    texts = found.groupBy(*by, "__stem", "__text").agg(F.count("*").alias("n"), F.min(place).alias("__at"))
    parts = F.regexp_extract("__text", rf"(?s)\A(.+){re.escape(suffix)}([1-9]\d{{0,17}})\z", 1)
    number = F.regexp_extract("__text", rf"(?s)\A.+{re.escape(suffix)}([1-9]\d{{0,17}})\z", 1).try_cast("bigint")
    texts = texts.withColumns({"parent": F.nullif(parts, F.lit("")), "number": number})
    # how often the parent occurs before the first row with the text
    marks = texts.filter("parent IS NOT NULL").select(*by, F.col("parent").alias("__key"), *[F.col(f"__at.{c}").alias(c) for c in order if c not in by], F.col("__text").alias("__of"))
    real = found.select(*by, F.col("__text").alias("__key"), *[c for c in order if c not in by], F.lit(None).cast("string").alias("__of"))
    earlier = repeat_number(real.unionByName(marks), "__key", by, order, counted=F.col("__of").isNull()).filter("__of IS NOT NULL")
    known = texts.join(earlier.select(*by, F.col("__of").alias("__text"), F.col("__k").alias("earlier")), [*by, "__text"], "left")
    known = known.select(*by, "__stem", "__text", "n", "parent", F.coalesce("number", F.lit(0)).alias("number"), F.coalesce("earlier", F.lit(0)).alias("earlier"))
    fields = "__text string, __nth long, first long, base long, steps array<struct<at:long,shift:long>>"

    def assign(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(_numbered(rows, each), columns=["__text", "__nth", "first", "base", "steps"])
        made["steps"] = [[{"at": at, "shift": shift} for at, shift in steps] for steps in made["steps"]]
        for c, v in zip(by, key, strict=False):
            made.insert(0, c, v)
        return made

    types = "".join(f"{c} {found.schema[c].dataType.simpleString()}, " for c in by)
    table = known.groupBy(*by, "__stem").applyInPandas(assign, types + fields)
    rows = repeat_number(found, "__text", by, order).withColumn("__nth", F.floor(F.col("__k") / each))
    j = F.col("__k") + F.col("first")
    shift = F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["at"] <= j), lambda s: s["shift"])), F.col("base"))
    return rows.join(table, [*by, "__text", "__nth"]).withColumn(name, F.when(j == 0, F.col("__text")).otherwise(F.concat("__text", F.lit(suffix), (j + shift).cast("string"))))


def resolve_unique(df: DataFrame, name: str, suffix: str, by_file: bool = False) -> DataFrame:
    """Give repeated texts the smallest free ``text+suffix+n``, in row order.

    Only values with one stem (trailing suffix numbers cut off) can meet, and only stems with a repeated value
    change at all. Where such a stem has one text only, the k-th repeat takes number k, by built-in functions; where
    texts with and without suffixes mix, the numbers passed over are found from the counts and first rows of the stem's distinct texts.
    The suffix must end in a character that is no digit, else a text can be read in two ways.
    """
    if not suffix or suffix[-1] in "0123456789":
        raise ValueError(f"a suffix must end in a character that is no digit: {suffix!r}")
    order = [c for c in (FILE, ROW) if c in df.columns]
    by = [FILE] if by_file else []
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    stem = F.regexp_replace(text, rf"(?<!\A)({re.escape(suffix)}\d+)+\z", "")
    keyed = df.withColumns({"__text": text, "__stem": stem})
    texts = keyed.filter("__text <> ''").groupBy(*by, "__stem", "__text").agg(F.count("*").alias("n"))
    stems = texts.groupBy(*by, "__stem").agg(F.max("n").alias("most"), F.count("*").alias("__texts")).filter("most > 1").select(*by, F.xxhash64("__stem").alias("__hash"), "__stem", "__texts")
    found = keyed.withColumn("__hash", F.xxhash64("__stem")).join(stems, [*by, "__hash", "__stem"], "left")
    calm = found.filter("__texts IS NULL OR __text = ''").select(*df.columns)
    one = repeat_number(found.filter("__texts = 1 AND __text <> ''"), "__text", by, order)
    plain = F.when(F.col("__k") > 0, F.concat("__text", F.lit(suffix), F.col("__k").cast("string"))).otherwise(F.col("__text"))
    out = calm.unionByName(one.withColumn(name, plain).select(*df.columns))
    if not stems.filter("__texts > 1").limit(1).count():  # one aggregate instead of the scans of a branch without rows
        return out
    mixed = _mixed_unique(found.filter("__texts > 1 AND __text <> ''"), name, suffix, by, order)
    return out.unionByName(mixed.select(*df.columns))


def enforce(df: DataFrame, spec: FieldSpec) -> DataFrame:
    """Adds ``__kind_<dest>`` and ``__degraded_<dest>`` and repairs the field as its fallback says."""
    kind, bad = f"__kind_{spec.dest}", f"__degraded_{spec.dest}"
    df = marked(df, spec)
    out = df.withColumn(kind, violation(df, spec))
    value, degraded = repaired(F.col(spec.dest), F.col(kind), spec, df.schema[spec.dest].dataType.simpleString())
    out = out.withColumns({bad: F.col(kind).isNotNull() & degraded, spec.dest: value})
    unique = [k for k in spec.constraints if k.kind == "unique"]
    if unique and spec.fallback.on_violation == "truncate":
        out = resolve_unique(out, spec.dest, spec.fallback.unique_suffix, unique[0].unique_scope == "file")
    return out


def violation_log(df: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """One row per broken cell: file, row, field, kind, policy and whether the repair was degraded."""
    found = [F.struct(F.lit(s.dest).alias("field"), F.col(f"__kind_{s.dest}").alias("kind"), F.lit(s.fallback.on_violation).alias("policy"), F.col(f"__degraded_{s.dest}").alias("degraded")) for s in specs]
    at = [c for c in (FILE, ROW) if c in df.columns]
    return df.select(*at, F.explode(F.filter(F.array(*found), lambda v: v["kind"].isNotNull())).alias("v")).select(*at, "v.*")


def violation_counts(df: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    return violation_log(df, specs).groupBy("field", "kind", "policy").agg(F.count("*").alias("n"))


def regression(df: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """The same constraints on the results: what is left, by field and kind."""
    for s in specs:
        df = marked(df, s)
    kinds = [F.struct(F.lit(s.dest).alias("field"), violation(df, s).alias("kind")) for s in specs if s.constraints]
    if not kinds:
        return df.sparkSession.createDataFrame([], "field string, kind string, n long")
    held = df.withColumn("__found", F.array(*kinds))
    return held.select(F.explode("__found").alias("v")).filter("v.kind IS NOT NULL").groupBy("v.field", "v.kind").agg(F.count("*").alias("n"))
