"""Writers: cells as canonical text, nulls kept in JSON, all-text Parquet, upserts over JDBC or files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.cells import neutral_formula
from sievewright.operators.clean import text_of
from sievewright.operators.incremental import insert_or_ignore
from sievewright.sources import work


def as_text(df: DataFrame, neutral: bool = False) -> DataFrame:
    one = neutral_formula if neutral else lambda c: c
    return df.select(*[one(text_of(df, c)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, neutral: bool = False, quote_all: bool = False, mode: str = "errorifexists") -> None:
    as_text(df, neutral).write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=quote_all, emptyValue="", lineSep="\n")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    as_text(df).write.mode(mode).parquet(path)


def append_new(df: DataFrame, path: str, key: str, order: list[str]) -> dict[str, int]:
    """Insert-or-ignore into a Parquet store: the store wins, then the first row; a store that is not there is made."""
    spark = df.sparkSession
    try:
        store = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store = df.limit(0)
    new, counts = insert_or_ignore(store, df, key, order)
    said = counts.first().asDict()
    new.write.mode("append").parquet(path)
    return said


def _statement(spark, url: str, properties: dict[str, str], *texts: str) -> None:
    """Statements on the driver's own connection, in one transaction."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    if properties.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in texts:
            statement.execute(text)
        connection.commit()
    finally:
        connection.close()


def jdbc_append_new(df: DataFrame, url: str, table: str, key: str, order: list[str], properties: dict[str, str], text_type: str = "TEXT") -> dict[str, int]:
    """Insert-or-ignore into a table behind JDBC (a driver jar must be on the class path): its rows win, then the first of the batch.

    Columns that the table lacks are added as text; its other columns stay null. Gives how many rows were inserted and how many were duplicates. The
    new rows are written to the shared folder first, so what is counted is what is sent; a run that is repeated after a failure finds its rows in the table.
    """
    spark = df.sparkSession
    there = spark.read.jdbc(url, table, properties=properties)
    known = {c.lower() for c in there.columns}
    if lacking := [c for c in df.columns if c.lower() not in known]:
        quoted = lambda c: '"' + c.replace('"', '""') + '"'
        _statement(spark, url, properties, *[f"ALTER TABLE {table} ADD COLUMN {quoted(c)} {text_type}" for c in lacking])
    sent = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in lacking else F.col(f"`{c}`") for c in df.columns])
    new = work.written(insert_or_ignore(there.select(key), sent, key, order)[0], "new-rows")
    inserted, rows = new.count(), df.count()
    new.write.jdbc(url, table, mode="append", properties=properties)
    return {"inserted": inserted, "duplicates": rows - inserted}


def column_names(names: list[str]) -> dict[str, str]:
    """Names as SQL columns: lower snake, at most 55 characters, distinct."""
    import hashlib

    out: dict[str, str] = {}
    for n in names:
        plain = re.sub("_+", "_", re.sub(r"[^a-z0-9]+", "_", n.lower())).strip("_")[:55]
        plain = plain if plain and not plain[0].isdigit() else f"f_{hashlib.sha256(n.encode()).hexdigest()[:8]}"
        name, k = plain, 2
        while name in out.values():
            name, k = f"{plain[:52]}_{k}", k + 1
        out[n] = name
    return out


def bulk_lines(df: DataFrame, index: str, key: str) -> DataFrame:
    """Two lines a document in the bulk form of search servers."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    return df.select(F.explode(F.array(action, body)).alias("value"))


def insert_statements(vertices: DataFrame, tag: str, key: str, size: int = 1000) -> DataFrame:
    """INSERT VERTEX statements of up to ``size`` rows, by hash buckets so that no tag lands in one task."""
    names = [c for c in vertices.columns if c != key]
    quoted = lambda c: F.to_json(F.array(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    value = F.concat(F.lit('"'), F.replace(F.col(key).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('":('), F.concat_ws(", ", *[F.regexp_replace(quoted(c), r"^\[|\]$", "") for c in names]), F.lit(")"))
    n = max(1, vertices.count() // size)
    start = f"INSERT VERTEX `{tag}`({', '.join(f'`{n}`' for n in names)}) VALUES "
    by = vertices.select(value.alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).groupBy("b").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return by.select(F.concat(F.lit(start), F.concat_ws(", ", "v"), F.lit(";")).alias("statement"))


def edge_statements(edges: DataFrame, kind: str, size: int = 1000) -> DataFrame:
    """INSERT EDGE statements of up to about ``size`` rows from (s, d, rank and properties), dealt by a hash of both ends."""
    names = [c for c in edges.columns if c not in ("s", "d", "rank")]
    text = lambda c: F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(c).cast("string"), F.lit("")))), r"^\[|\]$", "")
    value = F.concat(text("s"), F.lit("->"), text("d"), F.lit("@"), F.coalesce(F.col("rank").cast("bigint"), F.lit(0)).cast("string"), F.lit(":("), F.concat_ws(", ", *map(text, names)), F.lit(")"))
    n = max(1, edges.count() // size)
    start = f"INSERT EDGE `{kind}`({', '.join(f'`{n}`' for n in names)}) VALUES "
    by = edges.select(value.alias("v"), F.pmod(F.xxhash64("s", "d", "rank"), F.lit(n)).alias("b")).groupBy("b").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return by.select(F.concat(F.lit(start), F.concat_ws(", ", "v"), F.lit(";")).alias("statement"))
