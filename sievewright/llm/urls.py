"""URL filters by a sort-merge range join of reversed-host keys with nested rules.

A URL's key is its host with the labels reversed and closed by dots, then its path: ``www.example.com/en/x`` gives
``com.example.www./en/x``. A rule's host is a prefix of the keys of this host and of all its subdomains, so it stands for one interval of sorted keys
(``com.example.`` up to ``com.example/``), and the intervals of two hosts are nested or disjoint. Rules and URLs are dealt out by ranges
of keys, a rule into each range that its interval meets, and sorted; one sweep over a range keeps a stack of the hosts whose intervals are
open. A host on the stack holds its path rules sorted, each with the next shorter one that contains it, so that the longest fitting one is found by one search
and a walk up. Of all fitting rules the one with the longest host and path wins, of equally long ones that with the longer host.

Keys end in a hash of the page's id, so many pages with one host or one URL are cut between ranges as well; the cuts come from a
sample of the keys, which changes how evenly pages lie, never the result. Nothing but the cuts (one key for each partition) passes the driver.

Cases: a null URL and one without ``://`` have an empty host and path, which no rule fits, and get the default verdict; rules with a null or empty host fit nothing, a null path is
empty; rules that repeat host and path count once, with the greatest verdict (``block`` before ``allow``); hosts are compared as they stand (port and user name included, A-Z
lower-cased); repeated rows give repeated results; a null page_id is kept; empty tables give no rows or no rules; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store

SAMPLE = 50  # sampled keys for each partition
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty where there is no ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit("")) for n in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    """``a.b.c`` as ``c.b.a.``: a prefix of the reversed form of every subdomain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def keyed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    salt = F.concat(F.lit("\0"), F.lower(F.hex(F.xxhash64("page_id"))))
    return parts.select(F.concat(reversed_host(F.col("host")), "path", salt).alias("key"), "page_id", "host", "path")


def _rules(rules: DataFrame) -> DataFrame:
    host = F.translate("host", UPPER, LOWER)
    shaped = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(F.col("host") != "")
    once = shaped.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return once.select(reversed_host(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")


def cuts(keys: DataFrame, parts: int) -> list[str]:
    """Up to ``parts - 1`` keys that cut a sample into equal ranges."""
    rows = keys.count()
    if not rows or parts < 2:
        return []
    some = sorted(r.key for r in keys.select("key").sample(min(1.0, SAMPLE * parts / rows), 42).collect())
    return sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []


def _dealt(df: DataFrame, at: list[str], rules: bool) -> DataFrame:
    """Each URL with the number of its range; each rule once for every range its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if rules:
                spans = [(bisect_right(at, k), bisect_right(at, k[:-1] + "/")) for k in keys]
                rows, part = [i for i, (a, b) in enumerate(spans) for _ in range(a, b + 1)], [p for a, b in spans for p in range(a, b + 1)]
                batch = batch.take(pa.array(rows, pa.int64()))
            else:
                part = [bisect_right(at, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    return df.mapInArrow(run, "part int, " + ", ".join(f"{c} {t}" for c, t in df.dtypes))


class Sweep:
    """The stack of open hosts while sorted keys pass by."""

    def __init__(self, default: str) -> None:
        self.default, self.stack, self.part = default, [], None

    def _leave(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, part: int, key: str, path: str, rule: str, verdict: str) -> None:
        self._leave(part, key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, [], [], []))
        _, paths, up, what = self.stack[-1]
        over = len(paths) - 1  # paths come sorted
        while over >= 0 and not path.startswith(paths[over]):
            over = up[over]
        paths.append(path), up.append(over), what.append((rule, verdict))

    def page(self, part: int, key: str, path: str) -> tuple[str | None, str]:
        self._leave(part, key)
        best = None
        for _, paths, up, what in self.stack:  # from the shortest host to the longest
            i = bisect_right(paths, path) - 1
            while i >= 0 and not path.startswith(paths[i]):
                i = up[i]
            if i >= 0 and (best is None or len(what[i][0]) >= len(best[0])):
                best = what[i]
        return best or (None, self.default)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, the rule that decides (null if none) and the verdict; ``rules`` has host, path and verdict."""
    parts = store.partitions(pages.sparkSession)
    keys = keyed(pages, key, url)
    at = cuts(keys, parts)
    none = F.lit(None).cast("string")
    urls = _dealt(keys, at, False).select("part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", none.alias("rule"), none.alias("verdict"))
    nested = _dealt(_rules(rules), at, True).select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "rule", "verdict")
    sorted_ = nested.unionByName(urls).repartitionById(len(at) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(default)
        for batch in batches:
            part, key, kind, path, rule, verdict = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict"))
            at, said = [], []
            for i in range(batch.num_rows):
                if kind[i]:
                    at.append(i), said.append(sweep.page(part[i], key[i], path[i]))
                else:
                    sweep.rule(part[i], key[i], path[i], rule[i], verdict[i])
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*map(rows.column, ("page_id", "host", "path")), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return sorted_.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
