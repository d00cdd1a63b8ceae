"""Resumable runs: a manifest row per finished file is the commit; unchanged files of the same configuration are not read again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.plans.config import ConfigError, Task
from sievewright.plans.task import plan
from sievewright.sources import sinks
from sievewright.sources.files import Input

SCHEMA = "key string, size long, modified long, fingerprint string, run int"


@dataclass(frozen=True)
class Decision:
    run: int
    pending: list[Input]
    done: list[str]


def across_files(task: Task) -> bool:
    """Whether a row's result depends on other files: then a changed file set means a whole run."""
    return any(o.op == "dedupe" and o.scope == "task" for o in task.ops) or any(k.kind == "unique" and k.unique_scope == "task" for s in task.fields for k in s.constraints)


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    return int(status.getLen()), int(status.getModificationTime())


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/_manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{out}/_manifest")


def decide(spark: SparkSession, task: Task, inputs: list[Input], out: str) -> Decision:
    """What is left to do. Another configuration, or a finished file that changed, is refused: the output would mix two states."""
    rows = _manifest(spark, out).collect()  # one row a file
    if any(r.fingerprint != task.fingerprint for r in rows):
        raise ConfigError("the output was made with another configuration")
    known = {r.key: (r["size"], r.modified) for r in rows}
    for i in inputs:
        if i.key in known and known[i.key] != _stamp(spark, i.path):
            raise ConfigError(f"{i.key} changed since it was read")
    pending = [i for i in inputs if i.key not in known]
    if pending and rows and across_files(task):
        raise ConfigError("rows depend on other files: new files need a new output")
    return Decision(max((r.run for r in rows), default=-1) + 1, pending, sorted(known))


def run(spark: SparkSession, task: Task, inputs: list[Input], out: str, **options) -> Decision:
    """Cleans the pending files into ``out/run=N`` and then commits them; a run that died before its commit is overwritten."""
    todo = decide(spark, task, inputs, out)
    if todo.pending:
        stamps = [(i.key, *_stamp(spark, i.path), task.fingerprint, todo.run) for i in todo.pending]
        sinks.write_parquet(plan(spark, task, todo.pending, **options).output, f"{out}/run={todo.run}", mode="overwrite")
        spark.createDataFrame(stamps, SCHEMA).coalesce(1).write.mode("append").json(f"{out}/_manifest")
    return todo


def finished(spark: SparkSession, task: Task, out: str) -> DataFrame:
    """Rows of committed runs only."""
    runs = sorted({r.run for r in _manifest(spark, out).select("run").distinct().collect()})
    if not runs:
        return spark.createDataFrame([], ", ".join(f"`{f.dest}` string" for f in task.fields))
    return spark.read.parquet(*[f"{out}/run={r}" for r in runs]).select(*[F.col(f"`{f.dest}`") for f in task.fields])
