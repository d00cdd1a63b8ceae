"""Size-tiered shard store with an atomically committed, versioned manifest.

``append`` writes arrivals as small immutable Parquet shards. ``compact`` merges, in one job per tier, every tier with
``fan_in`` or more shards (of similar size: a tier spans a factor ``fan_in``) into files of up to ``target_bytes``; whole
files are packed into tasks by Spark's scan, so nothing is shuffled. Files of half the target or more are final. Each
step commits a manifest version: a table of the shards it adds and removes is written first, then its marker is renamed into
place without overwriting. Of two writers of one version one fails and commits again on top of the other: an append as it
is, a compaction only if its shards are still there. Every ``CHECKPOINT`` versions a marker also names a table of all
live shards, so a version is read from one such table and at most ``CHECKPOINT`` deltas. Readers only see whole versions.

Every version has a schema: the columns of all arrivals so far, those of later ones after those of earlier ones; shards without a column read as null. A column of the same name
must keep its type. Compaction and reading go by the version's schema, so no column of any arrival is lost.

Nothing is deleted but by ``vacuum``: it drops versions that are neither among the latest ``keep`` nor young enough, and the shards that
only these name. It lists the shards first, so what a crash leaves of them is deleted by the next one. Folders no version ever named, such as another writer's work before its commit, are left alone.

Cases: nulls in any column, empty and long texts and repeated rows are stored as they are; an empty arrival commits a version
without new shards; names that differ in case only are one column, with its first spelling; a column whose type changes raises ``ValueError`` before anything is committed; a version that was never
committed or is vacuumed raises ``LookupError``.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sievewright.llm import store

TARGET_BYTES = 128 << 20
SMALL_BYTES = 1 << 20
FAN_IN = 4
CHECKPOINT = 16
MERGE_FILES = 10_000  # files merged by one job; the rest of a tier takes the next
MANIFEST = "path string, bytes long, n_rows long, arrival int"
DELTA = "added boolean, " + MANIFEST


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def widened(old: StructType, new: StructType) -> StructType:
    """The old columns and, after them, new ones; one that is there already must have its type."""
    known = {f.name.lower(): f for f in old.fields}
    for f in new.fields:
        if f.name.lower() in known and known[f.name.lower()].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {known[f.name.lower()].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
    return StructType([*old.fields, *(StructField(f.name, f.dataType) for f in new.fields if f.name.lower() not in known)])


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, small_bytes: int = SMALL_BYTES):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan_in, self.small = target_bytes, fan_in, small_bytes

    # manifest versions

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return hadoop, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        hadoop, fs = self._fs()
        found = fs.globStatus(hadoop.Path(f"{self.path}/_commits/v*"))
        return sorted(int(s.getPath().getName()[1:]) for s in found) if found else []

    def _marker(self, version: int) -> dict:
        hadoop, fs = self._fs()
        stream = fs.open(hadoop.Path(f"{self.path}/_commits/v{version:08d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the latest if not named)."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], MANIFEST)
        version = known[-1] if version is None else version
        if version not in known:
            raise LookupError(f"version {version} is not in the store")
        deltas, whole = [], None
        while whole is None:
            marker = self._marker(version)
            whole = marker.get("whole")
            if whole is None:
                deltas.append(marker["delta"])
                version -= 1
        live = self.spark.read.schema(MANIFEST).parquet(whole)
        if not deltas:
            return live
        changed = self.spark.read.schema(DELTA).parquet(*deltas)
        gone = changed.filter("not added").select("path")
        return live.unionByName(changed.filter("added").drop("added")).join(gone, "path", "left_anti").select(*live.columns)

    def schema(self, version: int | None = None) -> StructType:
        """The columns of a version (the latest if not named); none in an empty store."""
        known = self.versions()
        if version is None and not known:
            return StructType([])
        version = known[-1] if version is None else version
        if version not in known:
            raise LookupError(f"version {version} is not in the store")
        return StructType.fromJson(self._marker(version)["schema"])

    def _commit(self, added: DataFrame, removed: DataFrame | None = None, at: int | None = None, columns: StructType | None = None) -> int:
        """Write the delta, then put its marker in place as version ``at`` (the next one) unless someone else did."""
        known = self.versions()
        version, tag = (known[-1] + 1 if known else 0) if at is None else at, uuid.uuid4().hex[:12]
        where = f"{self.path}/_manifests/v{version:08d}-{tag}"
        own = widened(self.schema(version - 1) if version else StructType([]), columns or StructType([]))
        delta = added.select(F.lit(True).alias("added"), "path", "bytes", "n_rows", "arrival")
        if removed is not None:
            delta = delta.unionByName(removed.select(F.lit(False).alias("added"), "path", "bytes", "n_rows", "arrival"))
        delta.write.parquet(where)
        marker = {"version": version, "delta": where, "time": time.time(), "schema": own.jsonValue()}
        if version % CHECKPOINT == 0:
            changed = self.spark.read.schema(DELTA).parquet(where)
            before = self.manifest(version - 1) if version else self.spark.createDataFrame([], MANIFEST)
            live = before.unionByName(changed.filter("added").drop("added")).join(changed.filter("not added").select("path"), "path", "left_anti")
            marker["whole"] = f"{where}-whole"
            live.select("path", "bytes", "n_rows", "arrival").write.parquet(marker["whole"])
        self._put(f"v{version:08d}", marker)
        return version

    def _put(self, name: str, marker: dict, over: bool = False) -> None:
        hadoop, fs = self._fs()
        fs.mkdirs(hadoop.Path(f"{self.path}/_commits"))
        hidden, final = hadoop.Path(f"{self.path}/_commits/.{uuid.uuid4().hex}"), hadoop.Path(f"{self.path}/_commits/{name}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, int(over))
        if over:
            how[0] = rename.OVERWRITE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(hidden, final, how)
        except Exception as e:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(f"{name} already exists: another writer committed it") from e
            raise

    def _committed(self, added: DataFrame, removed: DataFrame | None = None, columns: StructType | None = None) -> int | None:
        """Commit, again on top of others' versions where these came first; None if shards to remove are gone by then."""
        while True:
            known = self.versions()
            if removed is not None and removed.join(self.manifest(), "path", "left_anti").limit(1).count():
                return None
            try:
                return self._commit(added, removed, known[-1] + 1 if known else 0, columns)
            except FileExistsError:
                continue

    def _shards(self, where: str, arrival: int, schema) -> DataFrame:
        """Path, bytes and rows of the files just written; only file metadata is read."""
        files = self.spark.read.schema(schema).parquet(where).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return files.groupBy("path", "bytes").agg(F.count("*").alias("n_rows")).withColumn("arrival", F.lit(arrival))

    # writing and reading

    def append(self, rows: DataFrame) -> int:
        where, known = f"{self.path}/data/a-{uuid.uuid4().hex[:12]}", self.versions()
        widened(self.schema(), rows.schema)
        rows.write.parquet(where)
        return self._committed(self._shards(where, known[-1] + 1 if known else 0, rows.schema), columns=rows.schema)

    def tier(self, size: int) -> int:
        """Tier of a file size; the last tier is final."""
        if size >= self.target // 2:
            return 1 << 10
        return int(math.log(max(1.0, size / self.small), self.fan_in))

    def _due(self) -> list:
        """The shards of the least tier that is due, at most MERGE_FILES; only counts by tier and these reach the driver."""
        bounds = [self.small * self.fan_in**t for t in range(1, 64) if self.small * self.fan_in**t < self.target // 2]
        tier = F.lit(0)
        for n, size in enumerate(bounds, 1):
            tier = F.when(F.col("bytes") >= size, n).otherwise(tier)
        open_ = self.manifest().filter(F.col("bytes") < self.target // 2).withColumn("tier", tier)
        due = [r.tier for r in open_.groupBy("tier").count().filter(F.col("count") >= self.fan_in).orderBy("tier").limit(1).collect()]
        return open_.filter(F.col("tier") == due[0]).orderBy("arrival", "path").limit(MERGE_FILES).drop("tier").collect() if due else []

    def compact(self, schema: StructType | None = None) -> int | None:
        """Merge every tier that is due, smallest first, each in one job and one commit; the last version made.

        Merged shards have the columns of the store; a ``schema`` that lacks some of them is refused.
        """
        if schema is not None and (lost := {f.name.lower() for f in self.schema().fields} - {f.name.lower() for f in schema.fields}):
            raise ValueError(f"compaction would lose {', '.join(sorted(lost))}")
        done = None
        while files := self._due():
            schema = self.schema()
            where = f"{self.path}/data/c-{uuid.uuid4().hex[:12]}"
            with settings(self.spark, spark__sql__files__maxPartitionBytes=str(self.target), spark__sql__files__openCostInBytes="0", spark__sql__files__minPartitionNum="1"):
                self.spark.read.schema(schema).parquet(*[f.path for f in files]).write.parquet(where)
            merged = self._shards(where, max(f.arrival for f in files), schema)
            version = self._committed(merged, self.spark.createDataFrame([tuple(f) for f in files], MANIFEST))
            done = done if version is None else version
            if version is not None and merged.count() >= len(files):
                return done  # nothing became fewer: files cannot be packed any tighter
        return done

    def vacuum(self, keep: int = 10, age: float = 7 * 24 * 3600) -> list[int]:
        """Drop versions older than ``age`` seconds that are not among the latest ``keep``, and shards only they name; the versions dropped."""
        known = self.versions()
        markers = {v: self._marker(v) for v in known}
        kept = [v for v in known if v in known[-max(1, keep) :] or time.time() - markers[v]["time"] < age]
        kept = known[known.index(kept[0]) :] if kept else known  # versions stay without gaps
        dropped = [v for v in known if v < kept[0]] if kept else []
        if not dropped:
            self._sweep()
            return []
        hadoop, fs = self._fs()
        named = None  # all shards the dropped versions name; those of the first kept version and later additions stay
        for v in dropped:
            added = self.spark.read.schema(DELTA).parquet(markers[v]["delta"]).filter("added").select("path")
            if "whole" in markers[v]:
                added = added.unionByName(self.spark.read.schema(MANIFEST).parquet(markers[v]["whole"]).select("path"))
            named = added if named is None else named.unionByName(added)
        dead = named.distinct().join(self.manifest(kept[0]).select("path"), "path", "left_anti")
        dead.write.parquet(f"{self.path}/_dead/{uuid.uuid4().hex[:12]}")  # first the list: what a crash leaves is found by the next vacuum
        if "whole" not in markers[kept[0]]:  # the first version that stays must be readable by itself
            whole = f"{markers[kept[0]]['delta']}-whole"
            self.manifest(kept[0]).write.mode("overwrite").parquet(whole)
            self._put(f"v{kept[0]:08d}", markers[kept[0]] | {"whole": whole}, over=True)
        for v in dropped:
            fs.delete(hadoop.Path(f"{self.path}/_commits/v{v:08d}"), False)
        self._sweep()
        return dropped

    def _sweep(self) -> None:
        """Delete the shards that vacuums have listed and no version names."""
        hadoop, fs = self._fs()
        for listed in fs.globStatus(hadoop.Path(f"{self.path}/_dead/*")) or []:
            where, left = listed.getPath().toString(), self._named()
            if fs.exists(hadoop.Path(f"{where}/_SUCCESS")):
                for r in self.spark.read.schema("path string").parquet(where).join(left, "path", "left_anti").toLocalIterator():
                    fs.delete(hadoop.Path(r.path), False)
            fs.delete(listed.getPath(), True)

    def _named(self) -> DataFrame:
        """The paths that any version names."""
        known = self.versions()
        live = self.manifest(known[0]).select("path") if known else self.spark.createDataFrame([], "path string")
        deltas = [self._marker(v)["delta"] for v in known[1:]]
        return live.unionByName(self.spark.read.schema(DELTA).parquet(*deltas).filter("added").select("path")).distinct() if deltas else live

    def read(self, schema: StructType | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest if not named), with all its columns or those of ``schema``."""
        schema = self.schema(version) if schema is None else schema
        paths = [r.path for r in self.manifest(version).select("path").collect()]  # one row per file, as Spark's own file index
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def arrivals(docs: DataFrame, n: int, key: str = "doc_id") -> Iterator[DataFrame]:
    """The table in n parts by ranges of its key, nulls in the first; scans prune by the key's range."""
    cuts = sorted({int(x) for x in docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.001)})
    if not cuts:
        yield docs
        return
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        keep = F.col(key).isNull() if low is None else F.col(key) > low
        if low is None:
            keep = keep | (F.col(key) <= high)
        elif high is not None:
            keep = keep & (F.col(key) <= high)
        yield docs.filter(keep)


def sharded(docs: DataFrame, path: str | None = None, n_arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> tuple[ShardStore, DataFrame]:
    """Append the table in arrivals, compact after each, and read the last version back."""
    spark = docs.sparkSession
    kept = ShardStore(spark, path or store.new_path(spark, "shards"), target_bytes)
    for rows in arrivals(docs, n_arrivals):
        kept.append(rows)
        kept.compact()
    return kept, kept.read()
