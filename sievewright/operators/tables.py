"""Smaller table operators: formula columns, merges into templates, leaderboards, tolerant comparison, naming, model columns."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import cells as numbers
from sievewright.functions import patterns
from sievewright.operators.clean import text_of

# Functions a formula may call.
CALLS = {"abs": F.abs, "sqrt": F.sqrt, "hypot": F.hypot, "atan2": F.atan2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "min": F.least, "max": F.greatest, "round": lambda c: F.floor(c + 0.5).cast("double")}


def formula(text: str, cells: dict[str, Column]) -> Column:
    """Arithmetic over ``${field}`` as a double; null where it is not finite. Only the listed functions and PI are known."""
    names: dict[str, str] = {}

    def named(m) -> str:
        return names.setdefault(m[1].strip(), f"f{len(names)}")

    import re

    tree = ast.parse(re.sub(r"\$\{([^{}]+)\}", named, text), mode="eval").body
    back = {v: k for k, v in names.items()}

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in back and back[n.id] in cells:
            return cells[back[n.id]].try_cast("double")
        if isinstance(n, ast.Name) and n.id == "PI":
            return F.pi()
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -build(n.operand) if isinstance(n.op, ast.USub) else build(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            if isinstance(n.op, (ast.Add, ast.Sub, ast.Mult)):
                return a + b if isinstance(n.op, ast.Add) else a - b if isinstance(n.op, ast.Sub) else a * b
            if isinstance(n.op, ast.Div):
                return F.try_divide(a, b)
            if isinstance(n.op, ast.Mod):
                return F.when(b != 0, a - b * F.when(F.try_divide(a, b) < 0, F.ceil(F.try_divide(a, b))).otherwise(F.floor(F.try_divide(a, b))))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in CALLS and not n.keywords:
            return CALLS[n.func.id](*map(build, n.args))
        raise ValueError(f"formula {text!r} has something that is not allowed")

    value = build(tree)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def attitude(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pitch and roll in degrees from an acceleration vector; null for a vector without length."""
    there = F.sqrt(x * x + y * y + z * z) > 1e-9
    return F.when(there, F.degrees(F.atan2(-x, F.hypot(y, z)))), F.when(there, F.degrees(F.atan2(y, z)))


def nearly(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    """Equal texts, or numbers within the tolerance; two nulls are equal."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.abs(x - y) <= tolerance, a.eqNullSafe(b))


def merged(rows: DataFrame, template: str, name: str = "document") -> DataFrame:
    """Every row rendered into one text template; rows whose cells are all empty are dropped."""
    cells = {c: text_of(rows, c) for c in rows.columns}
    some = F.exists(F.array(*cells.values()), lambda v: v != "")
    return rows.filter(some).withColumn(name, patterns.render(template, cells))


def shown_number(value: Column, fmt: str) -> Column:
    """A number as a spreadsheet shows it by a simple format: zeros, decimals, thousands, percent."""
    scaled = value * 100 if fmt.endswith("%") else value
    body = fmt.rstrip("%")
    decimals = len(body.partition(".")[2])
    text = F.format_number(F.round(scaled.cast(f"decimal(38,{max(decimals, 10)})"), decimals), decimals)
    text = text if "," in body else F.replace(text, F.lit(","), F.lit(""))
    whole = body.partition(".")[0].replace(",", "").replace("#", "")
    width = len(whole) + (decimals + 1 if decimals else 0)
    text = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text) if width else text
    return F.concat(text, F.lit("%")) if fmt.endswith("%") else text


def ranked(rows: DataFrame, by: str, items: str) -> DataFrame:
    """Items of an array in their order, with rank from 1."""
    return rows.select(*[c for c in rows.columns if c != items], F.posexplode(items).alias("__i", items)).withColumn("rank", F.col("__i") + 1).drop("__i")


def latest_days(rows: DataFrame, day: str, keep: int = 15) -> DataFrame:
    """Rows of the newest ``keep`` days; only the days are sorted."""
    days = rows.select(day).distinct().orderBy(F.desc(day)).limit(keep)
    return rows.join(days, day, "left_semi")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9,]", "")


def search(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns holds the text, ignoring case."""
    return rows.filter(F.lower(F.concat_ws("\x1f", *columns)).contains(needle.lower()))


def expanded(rows: DataFrame, items: str, key: str, order: str | None = None, most: int | None = None) -> DataFrame:
    """One row per array entry, the first of each key in the order of rows and of entries; with ``most`` the first so many of them."""
    flat = rows.select(*[c for c in rows.columns if c != items], F.posexplode(items).alias("__i", "entry"))
    place = F.struct(*([order] if order else []), "__i")
    first = flat.withColumn("__key", F.col(f"entry.{key}")).groupBy("__key").agg(F.min_by(F.struct(*[c for c in flat.columns if c != "__i"]), place).alias("__row"), F.min(place).alias("__place"))
    first = first.orderBy("__place").limit(most) if most else first
    return first.select("__row.*")


def distinct_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names (ignoring case) get ``_2``, ``_3`` in order."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    return rows.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 1, F.concat_ws("_", name, F.col("__n").cast("string"))).otherwise(F.col(name))).drop("__n")


def smoothed(rows: DataFrame, by: str, order: str, value: str, keep: float = 0.7, block: int = 100_000) -> DataFrame:
    """Exponentially weighted mean of each key's values in order; it starts anew after a null value.

    A value ``j`` rows before the last weighs ``keep^j``, so blocks of order numbers (of one key) are summed on their own and
    their sums weighted by the rows of later blocks; an order that is no number makes one block, read as a sorted stream.
    """
    numeric = numbers.is_number(rows.schema[order].dataType.simpleString())
    cut = rows.select(F.col(by), F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"), (F.floor(F.col(order) / block) if numeric else F.lit(0)).alias("__b"))
    back = Window.partitionBy(by, "__b").orderBy(F.desc_nulls_first("__o"), F.desc_nulls_first("__v"))
    from_end = cut.withColumns({"__j": F.row_number().over(back) - 1, "__nulls": F.count_if(F.col("__v").isNull()).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    live = F.col("__nulls") == 0
    sums = from_end.groupBy(by, "__b").agg(
        F.count_if(live).alias("__n"), F.sum(F.when(live, F.lit(1 - keep) * F.pow(F.lit(keep), F.col("__j")) * F.col("__v"))).alias("__w"),
        F.max_by("__v", F.when(live, F.col("__j"))).alias("__first"), F.count_if(F.col("__v").isNull()).alias("__cut"),
    )
    later = Window.partitionBy(by).orderBy(F.desc_nulls_first("__b")).rowsBetween(Window.unboundedPreceding, -1)
    kept = sums.withColumns({"__after": F.coalesce(F.sum("__n").over(later), F.lit(0)), "__cuts": F.coalesce(F.sum("__cut").over(later), F.lit(0))})
    live = (F.col("__cuts") == 0) & (F.col("__n") > 0)
    total = kept.groupBy(by).agg(F.sum(F.when(live, F.col("__w") * F.pow(F.lit(keep), F.col("__after")))).alias("__w"), F.sum(F.when(live, F.col("__n"))).alias("__n"), F.max_by("__first", F.when(live, F.col("__after"))).alias("__first"))
    return total.select(by, (F.col("__w") + F.pow(F.lit(keep), F.col("__n")) * F.col("__first")).alias("smoothed"))


def model_columns(rows: DataFrame, prompt: str, outputs: list[str], client: Callable[[list[str]], str], cache: DataFrame | None = None, size: int = 10, retries: int = 2) -> DataFrame:
    """Columns asked from a language model by a client given from outside: ``client(prompts)`` returns a JSON array of objects.

    Rows are keyed by the sha256 of their prompt; those in ``cache`` (key and outputs) are not asked again, equal prompts are
    asked once. A reply that is no array of the right length is tried again by row; after ``retries`` the outputs are null.
    """
    cells = {c: text_of(rows, c) for c in rows.columns}
    asked = rows.withColumn("__prompt", patterns.render(prompt, cells)).withColumn("__key", F.sha2("__prompt", 256))
    todo = asked.select("__key", "__prompt").dropDuplicates(["__key"])
    if cache is not None:
        todo = todo.join(cache.select(F.col("key").alias("__key")), "__key", "left_anti")

    def reply(prompts: list[str]) -> list[dict] | None:
        try:
            got = json.loads(client(prompts))
        except ValueError:
            return None
        return got if isinstance(got, list) and len(got) == len(prompts) and all(isinstance(g, dict) for g in got) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                got = reply(part["__prompt"].tolist())
                if got is None:
                    got = [next((r[0] for r in (reply([p]) for _ in range(retries)) if r), {}) for p in part["__prompt"]]
                out += [(k, *(None if g.get(o) is None else str(g[o]) for o in outputs)) for k, g in zip(part["__key"], got, strict=True)]
            yield pd.DataFrame(out, columns=["__key", *outputs])

    made = todo.mapInPandas(run, "__key string, " + ", ".join(f"`{o}` string" for o in outputs))
    if cache is not None:
        made = made.unionByName(cache.select(F.col("key").alias("__key"), *outputs))
    return asked.join(made, "__key", "left").drop("__key", "__prompt")
