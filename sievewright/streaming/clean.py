"""The cleaning plan on streams: row operators in the stream, order-dependent ones in keyed state or per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from sievewright.operators import clean, quality
from sievewright.operators.incremental import first_of_each
from sievewright.plans.config import ConfigError, Task

ORDERED = ("ffill", "dedupe")


def row_stream(rows: DataFrame, task: Task) -> DataFrame:
    """Operators and constraints that look at one row only; the others are refused here."""
    if any(o.op in ORDERED for o in task.ops) or any(k.kind == "unique" for s in task.fields for k in s.constraints):
        raise ConfigError("ffill, dedupe and unique need state: use filled_stream, first_stream or batches")
    out = clean.apply_ops(rows, task.ops)
    for s in task.fields:
        if s.constraints:
            out = quality.enforce(out, s)
    return out.select(*[s.dest for s in task.fields])


def filled_stream(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Forward fill by key across batches: the last non-empty value of each key is state."""

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for b in batches:
            b = b.sort_values(order, kind="stable")
            out = []
            for v in b[name]:
                last = v if v not in (None, "") else last
                out.append(v if v not in (None, "") else last if last is not None else v)
            yield b.assign(**{name: out})
        if last is not None:
            state.update((last,))

    return rows.groupBy(by).applyInPandasWithState(fill, rows.schema, "last string", "append", "NoTimeout")


def first_stream(rows: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """First arrival of each key; with an event time the state is bounded by the watermark."""
    if event_time:
        return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def batches(rows: DataFrame, task: Task, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The whole plan on every micro-batch; ``write(df, batch_id)`` must be idempotent by batch id."""
    from sievewright.plans.task import build

    def one(df: DataFrame, batch_id: int) -> None:
        write(build(task, df, observe=False).output, batch_id)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_first(rows: DataFrame, path: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Insert-or-ignore into Parquet folders named by batch, so that a repeated batch overwrites itself."""

    def one(df: DataFrame, batch_id: int) -> None:
        spark: SparkSession = df.sparkSession
        new = first_of_each(df, key, order)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [str(s.getPath()) for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        earlier = [p for p in earlier if int(p.rpartition("batch=")[2]) < batch_id]
        if earlier:
            new = new.join(spark.read.parquet(*earlier).select(key), key, "left_anti")
        new.select(*df.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
