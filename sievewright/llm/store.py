"""Shared-folder tables, null-safe input shaping, whole-row selection and small session lookups."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN_BYTES = 1 << 60  # Spark's default for rows that come from no file is larger
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/sievewright-shared-{os.getpid()}"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sievewright/{name}-{uuid.uuid4().hex[:12]}"
    for made_here in _scopes[-1:]:
        made_here.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Work tables made inside are removed at the end; what leaves the block must be written outside of it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and reread it: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, path: str) -> str:
    """Make the folder; its full address, as libraries outside Spark need it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    full = fs.makeQualified(hadoop).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored_bytes(df: DataFrame) -> int:
    """Size of what the plan reads, as Spark's own statistics have it, 0 where they do not know; no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def texts(docs: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (key as bigint, text with null as empty, named extras): other columns cannot clash."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of the table has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What names a row: its doc_id as text (null: empty) and the SHA-256 of its text (null: of the empty text)."""
    return F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def only_kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows whose key (k, sha) is ``kept`` in ``decided``, with all their columns; of rows with one key the least by the JSON of all columns.

    ``decided`` has a row for every row of ``docs``. The join is a merge join at every size, so the rows are moved once and nothing
    is broadcast. Rows with one key are first reduced in each task.
    """
    keys = decided.groupBy("k", "sha").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(keys.filter(~F.col("kept") | (F.col("n") > 1)), "keys")
    k, sha, place = free(docs, "k", "sha", "place")
    keyed = docs.withColumns(dict(zip((k, sha), row_key(), strict=True)))

    def on(some: DataFrame, how: str) -> DataFrame:
        return keyed.join(some.select(F.col("k").alias(k), F.col("sha").alias(sha)).hint("merge"), [k, sha], how)

    out = on(keys, "left_anti").select(*_columns(docs))
    if not keys.filter("kept").limit(1).count():
        return out
    least = Window.partitionBy(k, sha).orderBy(F.to_json(F.struct(*_columns(docs)), {"ignoreNullFields": "false"}))
    again = on(keys.filter("kept"), "left_semi").withColumn(place, F.row_number().over(least)).filter(F.col(place) == 1)
    return out.unionByName(again.select(*_columns(docs)))


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which every key is whole, from batches sorted by key; only the last key's rows are held over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        same = batch.num_rows - 1
        low, high = 0, same
        while low < high:  # first row of the last key
            middle = (low + high) // 2
            low, high = (low, middle) if keys[middle] == last else (middle + 1, high)
        if low == 0 and held and held[-1].column(key)[held[-1].num_rows - 1] == last:
            held.append(batch)
            continue
        if low:
            held.append(batch.slice(0, low))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held)
