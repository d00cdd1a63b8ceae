"""The sixteen cleaning operators over DataFrames.

A text operator touches text cells only: where ``cast`` succeeded, the cell counts as typed (hidden flag
column) and later text operators leave it. ``order`` names the columns that order rows: (file, row).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import cells, patterns
from sievewright.functions.text import casefold, nfkc
from sievewright.plans.config import Op

FILE, ROW = "_file_ord", "_row"
TYPED = "__typed_"


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def text_of(df: DataFrame, name: str) -> Column:
    return cells.cell_text(F.col(name), _kind(df, name))


def _changed_text(df: DataFrame, op: Op) -> Column | None:
    """New text of the field for the operators that rewrite text; None for the others."""
    c = F.col(op.field)
    match op.op:
        case "trim":
            return cells.strip(c)
        case "lower":
            return F.lower(c)
        case "upper":
            return F.upper(c)
        case "nfkc":
            return nfkc(c)
        case "replace":
            return F.replace(c, F.lit(op.pattern), F.lit(op.replacement))
        case "regex_replace":
            return F.regexp_replace(c, patterns.java(op.pattern), patterns.replacement(op.replacement, patterns.compiled(op.pattern).groups, patterns.compiled(op.pattern).groupindex))
        case "slice":
            return cells.sliced(c, op.start, op.end)
    return None


ORDERED = ("gt", "gte", "lt", "lte")


def bound(value: Column) -> Column:
    """The value, computed once for each row: conditions on it are not pushed below, where every use would compute it again."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def predicate(df: DataFrame, op: Op, cell: Column | None = None) -> Column:
    """Whether a row matches a filter's condition; empty cells match nothing but emptiness. ``cell`` may stand for the field's text."""
    c = F.col(op.field)
    if op.condition in ("is_empty", "not_empty"):
        return cells.is_empty(c) if op.condition == "is_empty" else ~cells.is_empty(c)
    text = text_of(df, op.field) if cell is None else cell
    if op.condition in ORDERED:
        limit = F.lit(str(op.value).strip())
        out = F.lit(None).cast("boolean")
        for value, end in reversed(list(zip(cells.magnitudes(text), cells.magnitudes(limit), strict=True))):
            same = {"gt": value > end, "gte": value >= end, "lt": value < end, "lte": value <= end}[op.condition]
            out = F.coalesce(same, out)
        out = out & F.lit(_kind(df, op.field) != "boolean")
    else:
        fold = (lambda s: s.casefold()) if op.ignore_case else (lambda s: s)
        text = casefold(text) if op.ignore_case else text
        value = fold("" if op.value is None else str(op.value))
        out = {
            "equals": lambda: text == value,
            "contains": lambda: text.contains(value),
            "starts_with": lambda: text.startswith(value),
            "ends_with": lambda: text.endswith(value),
            "in": lambda: text.isin(*[fold(v) for v in op.filter_values]) if op.filter_values else F.lit(False),
        }[op.condition]()
    return F.coalesce(~cells.is_empty(c) & out, F.lit(False))


def scan_filter(df: DataFrame, op: Op) -> Column | None:
    """The same predicate on the bare text column where that is enough, so that it reaches the scan; else None."""
    plain = _kind(df, op.field) == "string" and not op.ignore_case and op.filter_action == "keep" and TYPED + op.field not in df.columns
    value, c = "" if op.value is None else str(op.value), F.col(op.field)
    if not plain:
        return None
    if op.condition == "not_empty":
        return c.isNotNull() & (c != "")
    if op.condition == "in" and op.filter_values and "" not in op.filter_values:
        return c.isin(*op.filter_values)
    simple = {"equals": lambda: c == value, "contains": lambda: c.contains(value), "starts_with": lambda: c.startswith(value), "ends_with": lambda: c.endswith(value)}
    return simple[op.condition]() if value and op.condition in simple else None


def _cast(df: DataFrame, op: Op) -> tuple[Column, Column]:
    """(new text, whether the cell was converted); a failed cell keeps its text."""
    c, kind = F.col(op.field), _kind(df, op.field)
    text = text_of(df, op.field)
    match op.value_kind:
        case "str":
            new = text
        case "int":
            new = cells.to_integer(text).cast("string")
        case "float":
            new = cells.cell_text(cells.to_double(text), "double")
            new = F.when(cells.to_double(text).isNotNull(), new)
        case "date":
            new = F.date_format(patterns.parse_time(text, op.date_formats), "yyyy-MM-dd")
        case _:
            new = F.date_format(patterns.parse_time(text, op.date_formats), "yyyy-MM-dd HH:mm:ss")
    if kind == "boolean" and op.value_kind != "str":
        new = F.lit(None).cast("string")
    ok = ~cells.is_empty(c) & new.isNotNull()
    return F.when(ok, new).otherwise(c.cast("string")), ok


def first_rows(df: DataFrame, keys: list[str], by: list[str], order: list[str]) -> DataFrame:
    """First row of each key in order; nulls and "" are one key value."""
    named = [F.coalesce(text_of(df, k), F.lit("")) for k in keys]
    w = Window.partitionBy(*[F.col(b) for b in by], *named).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def forward_filled(df: DataFrame, name: str, by: list[str], order: list[str]) -> Column:
    """Last non-empty value at or before the row; leading empties stay as they are."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col(name)
    return F.coalesce(F.last(F.when(~cells.is_empty(c), c), ignorenulls=True).over(w), c)


def fillable(df: DataFrame, name: str, file: str = FILE, row: str = ROW, block: int = 100_000) -> DataFrame:
    """Forward fill within each file without sorting a file in one task.

    Rows are cut into blocks of ``block`` row numbers; each block's last value (one row a block) is carried forward and
    joined back for the rows before the block's own first value.
    """
    c = F.col(name)
    cut = df.withColumn("__block", F.floor(F.col(row) / block))
    full = F.when(~cells.is_empty(c), c)
    last = cut.groupBy(file, "__block").agg(F.max_by(full, F.when(full.isNotNull(), F.col(row))).alias("__last"))
    before = Window.partitionBy(file).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col(file).alias("__f"), F.col("__block").alias("__b"), F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    own = Window.partitionBy(file, "__block").orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut.withColumn("__own", F.last(full, ignorenulls=True).over(own))
    both = inside.join(carried, F.col(file).eqNullSafe(F.col("__f")) & (F.col("__block") == F.col("__b")), "left")
    return both.withColumn(name, F.coalesce("__own", "__carry", c)).select(*df.columns)


def apply_op(df: DataFrame, op: Op, slot: int = 0, observe=None) -> DataFrame:
    """One operator. ``observe(df, name, **metrics)`` may attach counters; a field that is not there skips it."""
    told = observe or (lambda frame, name, **_: frame)
    name = f"{slot}:{op.op}"
    needed = [op.field] if op.field else list(op.fields or op.subset)
    if any(n not in df.columns for n in needed):
        return told(df, f"{name}:field_missing", missing=F.lit(1))
    file, order = [c for c in (FILE,) if c in df.columns], [c for c in (FILE, ROW) if c in df.columns]
    new = _changed_text(df, op)
    if new is not None or op.op in ("fill_null", "ffill", "cast", "date_format", "number_format"):
        c, failed, extra = F.col(op.field), F.lit(False), {}
        if new is not None:
            if _kind(df, op.field) != "string":
                return df
            if TYPED + op.field in df.columns:
                new = F.when(F.col(TYPED + op.field), c).otherwise(new)
        elif op.op == "fill_null":
            new = F.when(cells.is_empty(c), F.lit("" if op.value is None else str(op.value)).cast(_kind(df, op.field))).otherwise(c)
        elif op.op == "ffill":
            filled = fillable(df.withColumn("__old", c), op.field)
            out = told(filled, name, filled=F.count_if(~F.col("__old").eqNullSafe(F.col(op.field))))
            return out.drop("__old")
        elif op.op == "cast":
            new, ok = _cast(df, op)
            failed, extra = ~cells.is_empty(c) & ~ok, {TYPED + op.field: ok & F.lit(op.value_kind != "str")}
        elif op.op == "date_format":
            made = patterns.write_time(patterns.parse_time(text_of(df, op.field), op.date_formats), op.date_format)
            new, failed = F.coalesce(made, c.cast("string")), ~cells.is_empty(c) & made.isNull()
        else:
            made = cells.number_text(text_of(df, op.field), op.decimals, op.thousands, op.value_kind or "float")
            new, failed = F.coalesce(made, c.cast("string")), ~cells.is_empty(c) & made.isNull()
        out = df.withColumns({"__new": new, "__failed": failed, **extra})
        out = told(out, name, changed=F.count_if(~c.cast("string").eqNullSafe(F.col("__new").cast("string"))), failed=F.count_if("__failed"))
        return out.withColumn(op.field, F.col("__new")).drop("__new", "__failed")
    if op.op == "concat":
        return told(df.withColumn(op.dest, F.concat_ws(op.separator, *[text_of(df, f) for f in op.fields])), name, changed=F.count(F.lit(1)))
    if op.op == "drop_null":
        empty = F.lit(False)
        for n in needed:
            empty = empty | cells.is_empty(F.col(n))
        if observe is None:
            for n in needed:
                c = F.col(n)
                df = df.filter(c.isNotNull() & (c != "") if _kind(df, n) == "string" else ~cells.is_empty(c))
            return df
        return told(df.withColumn("__drop", empty), name, dropped=F.count_if("__drop")).filter("NOT __drop").drop("__drop")
    if op.op == "filter":
        if observe is None and (bare := scan_filter(df, op)) is not None:
            return df.filter(bare)
        if op.condition in ORDERED:
            text = F.col(op.field).cast("string") if cells.is_number(_kind(df, op.field)) else text_of(df, op.field)
            df = df.withColumn("__cell", bound(text))
            matched = predicate(df, op, F.col("__cell"))
        else:
            matched = predicate(df, op)
        out = told(df.withColumn("__match", matched), name, matched=F.count_if("__match"))
        return out.filter(F.col("__match") if op.filter_action == "keep" else ~F.col("__match")).drop("__match", "__cell")
    keys = list(op.subset) or [c for c in df.columns if not c.startswith("_")]
    return first_rows(df, keys, file if op.scope == "file" else [], order)


def apply_ops(df: DataFrame, ops: tuple[Op, ...] | list[Op], observe=None) -> DataFrame:
    for slot, op in enumerate(ops):
        df = apply_op(df, op, slot, observe)
    return df
