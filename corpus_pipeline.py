"""Corpus pipeline over ``documents``: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents, whatever these are named. Empty tables pass through; null texts count as empty; repeated and near rows leave
one row (with the smallest doc_id, a null one last), which does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import store
from sievewright.llm.decontam import keep_clean
from sievewright.llm.exact import keep_one_copy
from sievewright.llm.packing import pack_sequences
from sievewright.llm.quality import keep_good
from sievewright.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_one_copy(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 or more in five-word shingles the one with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, placed into sequences of 2048."""
    return pack_sequences(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = store.new_path(spark, f"pipeline-{name}")
        with store.scope(spark):  # the stage's own work tables go when its result is written
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            store.remove(spark, last)
        last = path
    return docs
