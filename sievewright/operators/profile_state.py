"""Column profiles kept as mergeable state: new arrivals are read once, what was profiled before is never read again.

A state row holds, for one field of one arrival, counts, length bounds, counts of types, moments, and sketches of lengths, numbers, distinct texts and
frequent texts; all of them merge. A profile merges the rows of all committed arrivals. Counts, types, lengths, mean and deviation are exact;
percentiles come from KLL sketches (``ACCURACY`` keeps the rank within ``RANK_ERROR`` of the asked one at 99 %), distinct counts from HyperLogLog (2 % or so), frequent texts from sketches of ``TRACKED``
texts, exact as long as a field has fewer texts.

Cases: null and empty cells count as empty; numbers are those that ``to_double`` reads, infinities and NaN take no part; an arrival without rows gives fields with counts of 0; a
source that was added before is refused by ``add`` and passed over by ``refresh``; the fields are fixed when the store is made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import cells
from sievewright.operators.profile import melted
from sievewright.sources.work import Folder

ACCURACY, RANK_ERROR, TRACKED, NUMERIC_SHARE = 800, 0.005, 10_000, 0.8


def state(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each field of the frame."""
    value = cells.to_double(F.col("text"))
    long = melted(df, fields).select("field", "text", "code", F.when(F.col("code") != "empty", F.length("text")).cast("bigint").alias("length"), F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("v"))
    text = F.when(F.col("code") != "empty", F.col("text"))
    codes = long.groupBy("field", "code").agg(F.count("*").alias("n")).groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))
    made = long.withColumn("filled", text).groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(F.col("code") == "empty").alias("n_empty"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("length").alias("length_sum"),
        F.count("v").alias("n_numbers"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("squares"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.kll_sketch_agg_bigint("length", F.lit(ACCURACY)).alias("lengths"), F.kll_sketch_agg_double("v", F.lit(ACCURACY)).alias("numbers"),
        F.hll_sketch_agg("filled").alias("distinct"), F.expr(f"approx_top_k_accumulate(filled, {TRACKED})").alias("frequent"),
    )
    every = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return every.join(made.join(codes, "field"), "field", "left").fillna(0, ["n", "n_empty", "n_numbers"])


def merged(states: DataFrame) -> DataFrame:
    """State rows of many arrivals as one row for each field."""
    mean = states.groupBy("field").agg((F.sum(F.col("mean") * F.col("n_numbers")) / F.sum("n_numbers")).alias("whole"))
    codes = states.select("field", F.explode("codes").alias("code", "k")).groupBy("field", "code").agg(F.sum("k").alias("k"))
    codes = codes.groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "k")))).alias("codes"))
    shift = F.col("mean") - F.col("whole")
    sums = states.join(mean, "field").groupBy("field").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_empty", "length_sum", "n_numbers")], *[F.min(c).alias(c) for c in ("min_length", "least")], *[F.max(c).alias(c) for c in ("max_length", "most")],
        F.first("whole").alias("mean"), F.sum(F.col("squares") + F.col("n_numbers") * shift * shift).alias("squares"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"), F.kll_merge_agg_double("numbers").alias("numbers"), F.hll_union_agg("distinct").alias("distinct"),
    )
    top = states.filter("frequent IS NOT NULL").groupBy("field").agg(F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))
    return sums.join(codes, "field", "left").join(top, "field", "left")


def profile(states: DataFrame, qs: tuple[float, ...] = (0.5, 0.95), top: int = 10) -> DataFrame:
    """field, n, n_empty, empty_rate, n_distinct, codes, lengths, moments, percentiles (arrays in the order of ``qs``) and the most frequent texts of merged state."""
    m, filled = merged(states), F.col("n") - F.col("n_empty")
    at = lambda kind, column, n: F.when(n > 0, F.array(*[getattr(F, f"kll_sketch_get_quantile_{kind}")(column, F.lit(q)).cast("double") for q in qs]))
    found = F.expr(f"approx_top_k_estimate(frequent, {top})")
    return m.select(
        "field", "n", "n_empty", (F.col("n_empty") / F.nullif(F.col("n"), F.lit(0))).alias("empty_rate"), F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).cast("bigint").alias("n_distinct"), "codes",
        "min_length", "max_length", (F.col("length_sum") / F.nullif(filled, F.lit(0))).alias("mean_length"), at("bigint", "lengths", filled).alias("length_percentiles"),
        "n_numbers", (F.col("n_numbers") >= NUMERIC_SHARE * filled).alias("numeric"), "mean", F.when(F.col("n_numbers") > 0, F.coalesce(F.sqrt(F.col("squares") / F.nullif(F.col("n_numbers") - 1, F.lit(0))), F.lit(0.0))).alias("stddev"), "least", "most",
        at("double", "numbers", F.col("n_numbers")).alias("percentiles"),
        F.when(filled > 0, F.array_sort(found, lambda a, b: F.when(a["count"] != b["count"], (b["count"] - a["count"]).cast("int")).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0))).alias("frequent"),
    )


class ProfileStore:
    """The state of all arrivals in a folder: Parquet parts, and documents that name the committed ones."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str] | None = None) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        if not self._names():
            if not fields:
                raise ValueError("a new profile store needs its fields")
            self._commit([], -1, list(fields))
        self.fields = self._last()[1]["fields"]
        if fields and list(fields) != self.fields:
            raise ValueError(f"the store profiles {self.fields}")

    def _names(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("state-")]

    def _last(self) -> tuple[int, dict]:
        name = self._names()[-1]
        return int(name[6:16]), self.folder.read(name)

    def _commit(self, parts: list[str], after: int, fields: list[str]) -> None:
        if len(self._names()) != after + 1 or not self.folder.create(f"state-{after + 1:010d}", {"parts": parts, "fields": fields}):
            raise RuntimeError("another writer has changed the store since this one began")

    def _read(self, kind: str, schema: str | None = None) -> DataFrame | None:
        paths = [f"{self.folder.path}/{p}/{kind}" for p in self._last()[1]["parts"]]
        return self.spark.read.parquet(*paths) if paths else None

    def states(self) -> DataFrame:
        found = self._read("state")
        return found if found is not None else state(self.spark.createDataFrame([], ", ".join(f"`{f}` string" for f in self.fields)), self.fields)

    def sources(self) -> DataFrame:
        found = self._read("sources")
        return found if found is not None else self.spark.createDataFrame([], "source string")

    def add(self, sources: Iterable[str], df: DataFrame) -> None:
        """Profile one arrival, which holds the rows of these sources, and commit its state."""
        after, held = self._last()
        names = self.spark.createDataFrame([(s,) for s in sources], "source string")
        if names.join(self.sources(), "source", "left_semi").limit(1).count():
            raise ValueError("a source of this arrival was profiled before")
        part = f"part-{uuid.uuid4().hex}"
        state(df, self.fields).coalesce(1).write.parquet(f"{self.folder.path}/{part}/state")  # one row for each field
        names.write.parquet(f"{self.folder.path}/{part}/sources")
        self._commit([*held["parts"], part], after, self.fields)

    def refresh(self, sources: list[str], read: Callable[[list[str]], DataFrame]) -> list[str]:
        """Profile those of the sources that are new, read by ``read``; gives them."""
        listed = self.spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "source string")
        new = [r.source for r in listed.join(self.sources(), "source", "left_anti").orderBy("source").collect()]  # a part of the caller's own list
        if new:
            self.add(new, read(new))
        return new

    def compact(self) -> None:
        """One part in place of all; the old ones stay for readers until ``clean``."""
        after, held = self._last()
        if len(held["parts"]) > 1:
            part = f"part-{uuid.uuid4().hex}"
            merged(self.states()).coalesce(1).write.parquet(f"{self.folder.path}/{part}/state")
            self.sources().write.parquet(f"{self.folder.path}/{part}/sources")
            self._commit([part], after, self.fields)

    def clean(self) -> None:
        """Removes parts that the last state does not name; no other writer may be at work."""
        held = set(self._last()[1]["parts"])
        for name in self.folder.names():
            if name.startswith("part-") and name not in held:
                self.folder.remove(name)

    def profile(self, qs: tuple[float, ...] = (0.5, 0.95), top: int = 10) -> DataFrame:
        return profile(self.states(), qs, top)
