"""A stream of collected pages: numbered files as offsets, and a seen-set with expiry.

A collector writes JSON-lines files ``page-<number>.jsonl``, numbered from 1, each put in place whole. The stream's offset is the last number up to which none is missing, so a file that comes late
holds the stream back instead of being passed over; each file is a partition that a task reads. A batch is the numbers between two offsets, so after a restart it has the same rows.

``unseen`` passes on the first row of each key and remembers the key for a while after it was last let through; its state is kept by Spark with the query's checkpoint, one value for each key.

Cases: lines that are no JSON objects are rows with null members and ``bad`` set; members that are not named in the schema are left out; other files in the folder are ignored; a null key is a key like any other;
of a batch's rows with one key the one with the least file and line passes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievewright.sources.writers import _at

NAME = re.compile(r"page-(\d+)\.jsonl\Z")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class File(InputPartition):
    number: int


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, members: list[str], most: int) -> None:
        self.path, self.members, self.most, self.last = path, members, most, 0

    def _names(self) -> dict[int, str]:
        fs, folder = _at(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return {int(m[1]): f.path for f in found if (m := NAME.match(f.base_name))}

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        there = self._names()
        while self.last + 1 in there:
            self.last += 1
        return {"number": self.last}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.last = max(self.last, end["number"])
        return [File(n) for n in range(start["number"] + 1, end["number"] + 1)]

    def commit(self, end: dict) -> None:
        """Files stay; the collector may remove those below the committed offset."""

    def read(self, part: File) -> Iterator[tuple]:
        fs, _ = _at(self.path)
        with fs.open_input_stream(self._names()[part.number]) as f:
            text = f.read().decode("utf-8", "replace")
        for n, line in enumerate(line for line in text.split("\n") if line.strip()):
            try:
                record = json.loads(line)
            except ValueError:
                record = None
            good = isinstance(record, dict)
            shown = [record.get(m) if good else None for m in self.members]
            yield (part.number, n, not good, *(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in shown))


class CollectedPages(DataSource):
    @classmethod
    def name(cls):
        return "collected_pages"

    def _members(self) -> list[str]:
        return self.options.get("members", "url,title,text").split(",")

    def schema(self):
        return "file bigint, line bigint, bad boolean, " + ", ".join(f"`{m}` string" for m in self._members())

    def streamReader(self, schema):
        return _Stream(self.options["path"], self._members(), 0)


def read_stream(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    spark.dataSource.register(CollectedPages)
    return spark.readStream.format("collected_pages").option("members", ",".join(members)).load(path)


class _Seen(StatefulProcessor):
    def __init__(self, names: list[str], milliseconds: int | None) -> None:
        self.names, self.milliseconds = names, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "file long, line long", self.milliseconds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows))
        first = whole.sort_values(["file", "line"]).iloc[:1]
        if not self.seen.exists():
            self.seen.update((int(first["file"].iloc[0]), int(first["line"].iloc[0])))
            yield first[self.names]

    def close(self) -> None:
        pass


def unseen(stream: DataFrame, key: str, seconds: float | None = None) -> DataFrame:
    """The first row of each key; a key is forgotten ``seconds`` after it passed (never if None). Needs the RocksDB state store, which is set for the session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    named = stream.withColumn("__key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")))
    processor = _Seen(stream.columns, None if seconds is None else int(1000 * seconds))
    return named.groupBy("__key").transformWithStateInPandas(processor, stream.schema, "Append", "ProcessingTime" if seconds is not None else "None")
