"""Incremental collection: stable keys, unseen rows, first-wins upsert, equality reads and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.cells import strip


def _word(name: str, columns: list[str]) -> Column:
    return F.coalesce(strip(F.col(name).cast("string")), F.lit("")) if name in columns else F.lit("")


def canonical_json(columns: list[str]) -> Column:
    """Row as JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_key(columns: list[str], article: bool = False) -> Column:
    """sha256 of the row's identity: account, title and time for articles, else the URL, else the whole row."""
    url = _word("url", columns)
    value = F.when(url != "", url).otherwise(canonical_json(columns))
    if article and "title" in columns:
        who = F.when(_word("account", columns) != "", _word("account", columns)).otherwise(_word("author", columns))
        value = F.when(_word("title", columns) != "", F.concat_ws("|", F.lit("wechat"), who, _word("title", columns), _word("published_at", columns))).otherwise(value)
    return F.sha2(value, 256)


def sink_key(columns: list[str]) -> Column:
    url = _word("url", columns)
    return F.sha2(F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("content:"), canonical_json(columns))), 256)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def insert_or_ignore(store: DataFrame, rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows to append, counts of inserted and duplicate): the store wins, then the first row of the batch."""
    new = unseen(first_of_each(rows, key, order), store, key)
    counted = rows.agg(F.count("*").alias("rows")).crossJoin(new.agg(F.count("*").alias("inserted")))  # one row each
    return new, counted.select("inserted", (F.col("rows") - F.col("inserted")).alias("duplicates"))


def upsert_keep(store: DataFrame, rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows replace the store's by key, but the columns in ``keep`` stay as the store first had them."""
    old = store.select(key, *[F.col(c).alias(f"__old_{c}") for c in store.columns if c != key], F.lit(True).alias("__was"))
    both = rows.withColumn("__is", F.lit(True)).join(old, key, "full_outer")
    pick = [F.when(F.col("__is") & ~(F.col("__was").isNotNull() & F.lit(c in keep)), F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c) for c in store.columns if c != key]
    return both.select(key, *pick).select(*store.columns)


def prefilled(rows: DataFrame, prefill: DataFrame, key: str) -> DataFrame:
    """Empty cells of a row take the prefill's value."""
    more = prefill.select(key, *[F.col(c).alias(f"__pre_{c}") for c in prefill.columns if c != key])
    both = rows.join(more, key, "left")
    return both.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__pre_{c}"), F.col(c)).alias(c) if c != key and c in prefill.columns else F.col(c) for c in rows.columns])


def overlaid(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Overrides win cell by cell; those of unknown keys are ignored."""
    more = overrides.select(key, *[F.col(c).alias(f"__o_{c}") for c in overrides.columns if c != key])
    both = defaults.join(more, key, "left")
    return both.select(*[F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if c != key and c in overrides.columns else F.col(c) for c in defaults.columns])


def with_fallback(rows: DataFrame, picked: DataFrame, key: str, fallback: DataFrame) -> DataFrame:
    """Rows with a picked key; the fallback rows where none is."""
    found = rows.join(picked.select(key).distinct(), key, "left_semi")
    none = found.limit(1).agg((F.count("*") == 0).alias("__none"))
    return found.unionByName(fallback.join(none, F.col("__none")).drop("__none"))


def where_equal(rows: DataFrame, **pairs) -> DataFrame:
    """Conjunction of equalities; None means IS NULL."""
    for name, value in pairs.items():
        rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows


def updated(rows: DataFrame, changes: dict, **pairs) -> DataFrame:
    match = F.lit(True)
    for name, value in pairs.items():
        match = match & (F.col(name).isNull() if value is None else F.coalesce(F.col(name) == value, F.lit(False)))
    return rows.withColumns({n: F.when(match, F.lit(v)).otherwise(F.col(n)) for n, v in changes.items()})


def deleted(rows: DataFrame, **pairs) -> DataFrame:
    match = F.lit(True)
    for name, value in pairs.items():
        match = match & (F.col(name).isNull() if value is None else F.coalesce(F.col(name) == value, F.lit(False)))
    return rows.filter(~match)


def paged(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, 1_000_000))
