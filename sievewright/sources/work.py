"""Folders that the driver and all executors share, and files that appear whole or not at all."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/sievewright-work-{os.getpid()}"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievewright/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of small JSON documents, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        at = self._at("")
        self._fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(at)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Put the document in place by a rename; false if there is one already."""
        draft = f".{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft))
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
