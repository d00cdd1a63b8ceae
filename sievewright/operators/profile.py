"""Exact column profiles in long form, and the comparison of two of them.

All fields share one scan: cells become (field, text, type) rows, partially aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import cells
from sievewright.operators.clean import FILE, ROW, text_of

NUMERIC_ROWS, NUMERIC_LEAST, NUMERIC_SHARE = 200, 4, 0.8
# Profile codes of Spark's types.
CODES = {"boolean": "bool", "double": "float", "float": "float", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "string": "str"}


def _code(kind: str) -> str:
    return "float" if kind.startswith("decimal") else CODES.get(kind, "other")


def melted(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, nth, text, code) of every cell; empty cells have code ``empty``."""
    at = [F.col(c) for c in (FILE, ROW) if c in df.columns] or [F.monotonically_increasing_id().alias(ROW)]
    one = [F.struct(F.lit(f).alias("field"), text_of(df, f).alias("text"), F.when(cells.is_empty(F.col(f)), "empty").otherwise(_code(df.schema[f].dataType.simpleString())).alias("code")) for f in fields]
    return df.select(*at, F.explode(F.array(*one)).alias("c")).select(*[c for c in (FILE, ROW) if c in df.columns], "c.*")


def counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """count, empty, empty_rate and the lengths of non-empty texts."""
    long = melted(df, fields)
    n = F.when(F.col("code") != "empty", F.length("text"))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("code") == "empty").alias("n_empty"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_length")).withColumn("empty_rate", F.col("n_empty") / F.col("n"))


def types(df: DataFrame, fields: list[str]) -> DataFrame:
    return melted(df, fields).groupBy("field", "code").agg(F.count("*").alias("n"))


def numeric_fields(df: DataFrame, fields: list[str]) -> list[str]:
    """Fields whose first non-empty values in row order mostly read as numbers; at most 200 values a field are looked at."""
    order = [c for c in (FILE, ROW) if c in df.columns]
    found = []
    for f in fields:
        head = df.filter(~cells.is_empty(F.col(f)))
        head = (head.orderBy(*order) if order else head).select(cells.to_double(text_of(df, f)).isNotNull().alias("ok")).limit(NUMERIC_ROWS)
        n, ok = head.agg(F.count("*"), F.count_if("ok")).first()
        if n >= NUMERIC_LEAST and ok >= NUMERIC_SHARE * n:
            found.append(f)
    return found


def moments(df: DataFrame, fields: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for a single value) of finite numbers."""
    value = cells.to_double(F.col("text"))
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    held = melted(df, fields).select("field", finite.alias("v"))
    return held.groupBy("field").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stddev"), F.min("v").alias("least"), F.max("v").alias("most"))


def top_values(df: DataFrame, fields: list[str], k: int = 10) -> DataFrame:
    """Exact top-k texts by count, then by text."""
    seen = melted(df, fields).groupBy("field", "text").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "text")
    return seen.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _cumulative(df: DataFrame, field: str, value: Column) -> DataFrame:
    return df.select(value.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, field: str, value: Column | None = None, qs: tuple[float, ...] = (0.5, 0.95), parts: int = 256) -> DataFrame:
    """Exact nearest-rank percentiles (rank round-half-even of q*(n-1)): one row (field, q, value).

    Distinct values are counted, cut into ``parts`` ranges by approximate quantiles, and only the range that holds a
    rank is searched, so no task sorts the whole column.
    """
    read = cells.number(F.col(field), df.schema[field].dataType.simpleString())
    v = value if value is not None else F.nullif(read, F.lit(float("nan")))
    seen = _cumulative(df, field, v)
    cuts = sorted(set(seen.approxQuantile("v", [i / parts for i in range(1, parts)], 0.001)))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("v")))
    dealt = seen.withColumn("part", part)
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())  # at most ``parts`` rows
    total = sum(n for _, n in sizes)
    out, spark = [], df.sparkSession
    for q in qs:
        rank, before = round(q * (total - 1)) if total else 0, 0
        for p, n in sizes:
            if before <= rank < before + n:
                w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
                inside = dealt.filter(F.col("part") == p).withColumn("upto", F.sum("n").over(w))
                out.append(inside.filter(F.col("upto") > rank - before).agg(F.min("v").alias("value")).select(F.lit(field).alias("field"), F.lit(q).alias("q"), "value"))
                break
            before += n
    if not out:
        return spark.createDataFrame([], "field string, q double, value double")
    first = out[0]
    for x in out[1:]:
        first = first.unionByName(x)
    return first


def compared(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Two profile frames side by side; a row of one side only is kept."""
    left = before.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values])
    right = after.select(*keys, *[F.col(v).alias(f"{v}_after") for v in values])
    return left.join(right, keys, "full_outer")


def findings(pairs: DataFrame, metric: str, tolerance: float = 0.0) -> DataFrame:
    """Where a metric grew by more than the tolerance, or a field came or went."""
    a, b = F.col(f"{metric}_before"), F.col(f"{metric}_after")
    told = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(b - a > tolerance, "worse")
    return pairs.withColumn("finding", told).filter("finding IS NOT NULL")
