"""A uniqueness index that outlives runs: which texts were accepted before, without reading or shuffling what was stored in the past again.

The index is one folder. ``data-*`` holds bucketed Parquet files, sorted by digest: one row (digest, proof, run) for each accepted text, 64 bits to
find it and 128 more to be sure (texts that share a digest are told apart by the proof, never taken for repeats). Every run appends its own sorted
files; ``state-*`` documents name the runs that were committed, so what a failed run left is not seen and goes with the next compaction. Files with the same
bucket number belong together: a probe shuffles only the new texts, into as many partitions as there are buckets, and merges them with the stored files where these are.

Cases: null and empty texts are never repeats and are not stored; of equal texts in a run the first in row order is accepted; a run that is repeated under its name after a
failure sees what the runs before it accepted, not its own leftovers, and a run that was committed is refused; an empty table commits an empty run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.clean import FILE, ROW
from sievewright.sources.work import Folder

BUCKETS = 64
_FIELDS = "digest BIGINT, proof BINARY, run STRING"


def digest(text: Column) -> Column:
    return F.xxhash64(text)


def proof(text: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _same(new: DataFrame, stored: DataFrame) -> Column:
    """Equal digests, the only key, so that the buckets serve as the join's partitions; equal proofs as bounds, which are no key."""
    a, b = new["proof"], stored["stored_proof"]
    return (new["digest"] == stored["stored_digest"]) & (a <= b) & (a >= b)


class UniqueIndex:
    """The index in a folder; ``buckets`` counts only when the folder is new."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        if not self._states():
            self._commit({"buckets": buckets, "data": f"data-{uuid.uuid4().hex}", "runs": []})

    def _states(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("state-")]

    def _commit(self, state: dict) -> None:
        names = self._states()
        nth = int(names[-1][6:16]) + 1 if names else 0
        if state.get("after", nth - 1) != nth - 1 or not self.folder.create(f"state-{nth:010d}", {k: v for k, v in state.items() if k != "after"}):
            raise RuntimeError("another run has changed the index since this one began")

    def state(self) -> dict:
        """The last committed state: buckets, data folder and the runs (name and number of texts) in order."""
        name = self._states()[-1]
        return self.folder.read(name) | {"after": int(name[6:16])}

    def _table(self, state: dict, name: str) -> str:
        """Registers the data folder as an external bucketed table under a name of this session."""
        self.spark.sql(f"CREATE TABLE `{name}` ({_FIELDS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {state['buckets']} BUCKETS LOCATION '{self.folder.path}/{state['data']}'")
        return name

    def _append(self, state: dict, rows: DataFrame) -> None:
        """Writes rows into the buckets; nothing is seen before a state names their run."""
        name = self._table(state, f"sievewright_unique_{uuid.uuid4().hex}")
        try:
            buckets = F.pmod(F.hash("digest"), F.lit(state["buckets"]))  # Spark's own bucket of a row
            dealt = rows.select("digest", "proof", "run").repartitionById(state["buckets"], buckets)
            dealt.write.format("parquet").bucketBy(state["buckets"], "digest").sortBy("digest").mode("append").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")  # external: the files stay

    def accepted(self, runs: list[str] | None = None) -> DataFrame:
        """(digest, proof, run) of committed runs, all or those named; bucketed by digest."""
        state = self.state()
        return self._rows(state, [r["name"] for r in state["runs"]] if runs is None else runs)

    def _rows(self, state: dict, names: list[str]) -> DataFrame:
        name = self._table(state, f"sievewright_unique_{uuid.uuid4().hex}")
        try:
            rows = self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        ids = [r["id"] for r in state["runs"] if r["name"] in names]
        return rows.filter(F.col("run").isin(ids)) if ids else rows.filter("false")

    def _stored(self, state: dict, names: list[str]) -> DataFrame:
        return self._rows(state, names).select(F.col("digest").alias("stored_digest"), F.col("proof").alias("stored_proof"))

    def marked(self, df: DataFrame, name: str, before: str | None = None) -> DataFrame:
        """Adds ``__again_<name>``: an earlier run (all, or those before the one named) or an earlier row accepted the same text."""
        state = self.state()
        runs = [r["name"] for r in state["runs"]]
        runs = runs[: runs.index(before)] if before in runs else runs
        at = F.struct(*[c for c in (FILE, ROW) if c in df.columns])
        text = F.nullif(F.col(name).cast("string"), F.lit(""))
        keyed = df.withColumns({"__at": at, "__digest": digest(text), "__proof": proof(text), "__text": text})
        firsts = keyed.filter("__text IS NOT NULL").groupBy(F.col("__digest").alias("digest"), F.col("__proof").alias("proof")).agg(F.min("__at").alias("__first"))
        # the stored side is in buckets already: only the distinct new texts move
        stored = self._stored(state, runs)
        new = firsts.repartition(state["buckets"], "digest")
        probed = new.join(stored.hint("merge"), _same(new, stored), "left")
        probed = probed.select(F.col("digest").alias("__digest"), F.col("proof").alias("__proof"), "__first", F.col("stored_digest").isNotNull().alias("__old"))
        found = keyed.join(probed, ["__digest", "__proof"], "left")
        again = F.col("__text").isNotNull() & (F.coalesce("__old", F.lit(False)) | (F.col("__at") != F.col("__first")))
        return found.withColumn(f"__again_{name}", again).select(*df.columns, f"__again_{name}")

    def add(self, df: DataFrame, name: str, run: str) -> int:
        """Accept the texts of a run that are new, commit it, and give their number."""
        state = self.state()
        if any(r["name"] == run for r in state["runs"]):
            raise ValueError(f"run {run!r} is in the index already")
        text, own = F.nullif(F.col(name).cast("string"), F.lit("")), uuid.uuid4().hex
        new = df.select(text.alias("t")).filter("t IS NOT NULL").select(digest(F.col("t")).alias("digest"), proof(F.col("t")).alias("proof")).distinct()
        stored = self._stored(state, [r["name"] for r in state["runs"]])
        new = new.repartition(state["buckets"], "digest")
        new = new.join(stored.hint("merge"), _same(new, stored), "left_anti")
        self._append(state, new.withColumn("run", F.lit(own)))
        n = self._rows(state | {"runs": [{"name": run, "id": own}]}, [run]).count()
        self._commit(state | {"runs": [*state["runs"], {"name": run, "id": own, "texts": n}]})
        return n

    def count(self) -> int:
        return sum(r["texts"] for r in self.state()["runs"])

    def truncate(self, run: str | None) -> None:
        """Forget every run after the one named (None: all of them); their rows go with the next compaction."""
        state = self.state()
        names = [r["name"] for r in state["runs"]]
        self._commit(state | {"runs": state["runs"][: names.index(run) + 1] if run is not None else []})

    def compact(self, buckets: int | None = None) -> None:
        """One sorted file for each bucket in a new data folder, without what no committed run owns; the old folder stays for readers until ``clean``."""
        state = self.state()
        new = state | {"data": f"data-{uuid.uuid4().hex}", "buckets": buckets or state["buckets"]}
        self._append(new, self.accepted())
        self._commit(new)

    def clean(self) -> None:
        """Removes data folders and states that the last one does not name; no other run may be at work."""
        state, last = self.state(), self._states()[-1]
        for name in self.folder.names():
            if (name.startswith("data-") and name != state["data"]) or (name.startswith("state-") and name != last) or name.startswith("."):
                self.folder.remove(name)
