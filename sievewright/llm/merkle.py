"""Merkle dataset manifest: a node store on disk, sorted leaf runs, level-partitioned Parquet, proofs by coordinate.

Every row is a leaf. The leaves of a source, ascending by doc_id, and above them the subroots of all sources are the ends of trees in which every ``FAN`` consecutive
nodes become one. A node's coordinate is (group, level, pos). Building: leaves are sorted by ranges into runs and written with their place in the
run; the counts of the runs (one row for each run and source) give every leaf its position in its source, so no source is ever gathered. Then rounds of ``LEVELS`` levels: the
nodes of one level are dealt out in blocks of ``FAN ** LEVELS`` consecutive ones, each block is read in order once and streams the levels above into the
store, holding at most FAN digests for each level. A round has 729 times fewer nodes than the one before. Proofs come top down: for each round a merge
scan over the stored levels, sorted by coordinate, gives every node the siblings on its way up; a block reads what lies above it once. The leaves' own proofs are only
digests.

Digests are SHA-256 of the concatenated inputs, inner ones of the children's lowercase hex. A leaf's inputs are doc_id, source, lang, n_chars and text, each ``-`` if
null, else its UTF-8 byte count, ``:`` and its value. Sources are in bytewise order, null first; a tree of a single node is that node.

Cases: a null doc_id comes first in its source; rows that repeat a doc_id are leaves of their own, in the order of their digests (equal rows have equal digests,
each its own place and proof); an empty text is ``0:``, a null one ``-``; a text of any length is hashed in the JVM in one piece; an empty table has no leaves and no root
(no rows); a source of any share is cut into runs and blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import store

FAN, LEVELS = 3, 6


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(text: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars")) -> Column:
    """The leaf of a row with this text."""
    values = [F.col(c).cast("bigint" if c in ("doc_id", "n_chars") else "string").cast("string") for c in fields] + [text]
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said), 256)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Sorted runs with (run, nth), and for each run and group of it (run, group, shift, size): a row's place in its group is nth + shift; nulls come first."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    runs = df.repartitionByRange(store.partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    runs = store.written(runs.withColumns({"run": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    counts = runs.groupBy("run", group).agg(F.count("*").alias("n"), F.min("nth").alias("from"))
    own = Window.partitionBy(group)
    return runs, counts.select("run", group, (F.sum("n").over(own.orderBy("run")) - F.col("n") - F.col("from")).alias("shift"), F.sum("n").over(own).alias("size"))


def _height(size: Column) -> Column:
    """Levels over ``size`` nodes: the least h with FAN ** h >= size."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(39)]), lambda power: power < size))


def _depth(size: int, levels: int) -> int:
    """Levels of a block's way to the root that lie inside the block."""
    n = 0
    while size > 1 and n < levels:
        size, n = -(-size // FAN), n + 1
    return n


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), types, strict=True)], names)


def _streamed(nodes: DataFrame, base: int, levels: int) -> DataFrame:
    """Levels base+1 to base+levels over the nodes of level ``base``; each block passes once, in order, and the open runs are all that is held."""
    dealt = nodes.select("g", F.floor(F.col("pos") / FAN**levels).alias("block"), "pos", "size", "h")
    dealt = dealt.repartition(store.partitions(nodes.sparkSession), "g", "block").sortWithinPartitions("g", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[str]] = [[] for _ in range(levels)]
        for batch in batches:
            out = []
            for g, pos, size, h in zip(*(batch.column(c).to_pylist() for c in ("g", "pos", "size", "h")), strict=True):
                for k in range(levels):
                    if size == 1:
                        break
                    held[k].append(h)
                    if len(held[k]) < FAN and pos < size - 1:
                        break
                    h = _sha("".join(held[k]))
                    held[k] = []
                    pos, size = pos // FAN, -(-size // FAN)
                    out.append((g, base + k + 1, pos, size, h))
            yield _batch(out, ["g", "level", "pos", "size", "h"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()])

    return dealt.mapInArrow(run, "g long, level int, pos long, size long, h string")


class NodeStore:
    """The trees over a written table of leaves (g, pos, size, h), one for each g: Parquet files partitioned by level."""

    def __init__(self, leaves: DataFrame, name: str, levels: int = LEVELS) -> None:
        self.spark, self.leaves, self.name, self.levels, self.path = leaves.sparkSession, leaves, name, levels, store.new_path(leaves.sparkSession, f"{name}-nodes")
        self.height = leaves.agg(F.max(_height(F.col("size")))).first()[0] or 0  # one number
        for base in range(0, self.height, levels):
            made = _streamed(self.level(base), base, levels).sortWithinPartitions("level", "g", "pos")
            made.write.partitionBy("level").mode("append").parquet(self.path)

    def upper(self) -> DataFrame:
        """All nodes above the leaves."""
        schema = "g long, pos long, size long, h string, level int"
        return self.spark.read.schema(schema).parquet(self.path) if self.height else self.spark.createDataFrame([], schema)

    def level(self, n: int) -> DataFrame:
        return (self.upper().filter(F.col("level") == n) if n else self.leaves).select("g", "pos", "size", "h")

    def roots(self) -> DataFrame:
        """(g, h): the node of each tree that has none above it."""
        return self.upper().filter("size = 1").select("g", "h").unionByName(self.leaves.filter("size = 1").select("g", "h"))

    def ways(self, tops: DataFrame) -> DataFrame:
        """(g, block, and the columns of ``tops``) for each block of leaves: what lies above it.

        ``tops`` has g, size, digests, turns and further columns that are handed down. ``digests`` joins the siblings' hex from the bottom up, ``turns``
        has two figures for each level: how many of them are left and right.
        """
        rest = [c for c in tops.columns if c not in ("g", "size")]
        height, above = _height(F.col("size")), None
        for base in reversed(range(0, max(1, self.height), self.levels)):
            here = tops.filter((height <= base + self.levels) & ((height > base) | F.lit(base == 0)))
            ways = here.select("g", F.lit(0).cast("bigint").alias("block"), *rest)
            ways = ways if above is None else ways.unionByName(above)
            if base == 0:
                return ways
            nodes = self.level(base).filter("size > 1")
            found = self.scanned(nodes, ways, base, _handed, "g long, block long, " + ", ".join(f"{c} string" for c in rest))
            above = store.written(found, f"{self.name}-ways")

    def scanned(self, nodes: DataFrame, ways: DataFrame, base: int, answer: Callable, schema: str) -> DataFrame:
        """Merge scan of a level's nodes (with any further columns), the stored levels above it and the ways of its blocks, by coordinate.

        ``answer(node, siblings, turns, way)`` gives a node's row, with ``siblings`` and ``turns`` up to the block's top; a block is held at a time.
        """
        depth = self.levels
        block = F.floor(F.col("pos") / F.pow(F.lit(FAN), F.lit(base + depth) - F.col("level"))).cast("bigint")
        upper = self.upper().filter((F.col("level") > base) & (F.col("level") < base + depth) & (F.col("size") > 1))
        rows = nodes.withColumn("level", F.lit(base)).unionByName(upper, allowMissingColumns=True).withColumn("block", block)
        more = [c for c in ways.columns if c not in ("g", "block")]
        rows = rows.unionByName(ways.select("g", "block", F.lit(base + depth).alias("level"), F.struct(*more).alias("way")), allowMissingColumns=True)
        dealt = rows.repartition(store.partitions(self.spark), "g", "block").sortWithinPartitions("g", "block", F.desc("level"), "pos")

        def block_rows(levels: list[list[dict]], way: dict) -> list[tuple]:
            above = {0: ("", "")}
            for k in reversed(range(_depth(levels[0][0]["size"], depth))):
                hashes, own = [n["h"] for n in levels[k]], {}
                for i in range(len(hashes)):
                    at = i - i % FAN
                    siblings, turns = above[i // FAN]
                    own[i] = "".join(hashes[at:i] + hashes[i + 1 : at + FAN]) + siblings, f"{i - at}{len(hashes[i + 1 : at + FAN])}{turns}"
                above = own
            return [answer(n, *above[i], way) for i, n in enumerate(levels[0])]

        fields = [f.strip().split(" ") for f in schema.split(",")]
        names, types = [f[0] for f in fields], [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f[1]] for f in fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, levels, way = None, [], {}
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if (row["g"], row["block"]) != key:
                        out += block_rows(levels, way) if key else []
                        key, levels, way = (row["g"], row["block"]), [[] for _ in range(depth)], {}
                    if row["way"]:
                        way = row["way"]
                    else:
                        levels[row["level"] - base].append(row)
                yield _batch(out, names, types)
            yield _batch(block_rows(levels, way) if key else [], names, types)

        return dealt.mapInArrow(run, schema)


def _handed(node: dict, siblings: str, turns: str, way: dict) -> tuple:
    """A node's way as that of the block below it."""
    own = way | {"digests": siblings + way["digests"], "turns": turns + way["turns"]}
    return node["g"], node["pos"], *own.values()


def folded(leaf: str, siblings: str, turns: str) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for left, right in zip(map(int, turns[::2]), map(int, turns[1::2]), strict=True):
        middle, end = at + 64 * left, at + 64 * (left + right)
        leaf = _sha(siblings[at:middle] + leaf + siblings[middle:end])
        at = end
    return leaf


class Manifest:
    """The manifest of a table: its leaves, the trees of the sources and the tree of their subroots.

    ``text_now`` stands for the text as it is found now: ``proofs`` folds leaves with that text.
    """

    def __init__(self, docs: DataFrame, text_now: Column | None = None, levels: int = LEVELS) -> None:
        columns = ("doc_id", "source", "lang", "n_chars", "text")
        rows = docs.select(*columns, (F.col("text") if text_now is None else text_now).alias("now"))
        leaf = leaf_digest(F.col("text"))
        seen = leaf if text_now is None else F.when(F.col("now").eqNullSafe(F.col("text")), leaf).otherwise(leaf_digest(F.col("now")))
        rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("h"), seen.alias("seen"))
        runs, starts = numbered(rows, "source", ["doc_id", "h", "seen"], "leaf-runs")
        starts = store.written(starts, "leaf-starts")
        sources = starts.groupBy("source").agg(F.first("size").alias("size")).withColumn("all", F.lit(0))
        ordered, places = numbered(sources, "all", ["source"], "source-runs")
        places = places.select(F.col("run").alias("r"), "shift", F.col("size").alias("sources"))
        self.sources = store.written(ordered.join(places, F.col("run") == F.col("r")).select((F.col("nth") + F.col("shift")).alias("g"), "source", "size", "sources"), "sources")
        ranked = starts.alias("s").join(self.sources.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source"))).select("s.run", "s.source", "s.shift", "s.size", "o.g")
        ranked = ranked.select(F.col("run").alias("r"), F.col("source").alias("of"), "shift", "size", "g")
        placed = runs.join(ranked, (F.col("run") == F.col("r")) & F.col("source").eqNullSafe(F.col("of")))
        self.leaves = store.written(placed.select("g", (F.col("nth") + F.col("shift")).alias("pos"), "size", "h", "doc_id", "seen"), "leaves")
        self.trees = NodeStore(self.leaves, "source", levels)
        tops = self.trees.roots().join(self.sources, "g").select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("pos"), F.col("sources").alias("size"), "h")
        self.top = NodeStore(store.written(tops, "subroots"), "top", levels)

    def roots(self) -> DataFrame:
        """(source, n_docs, subroot, root), one row for each source."""
        root = self.top.roots().select(F.col("h").alias("root"))
        named = self.top.leaves.select(F.col("pos").alias("g"), F.col("h").alias("subroot"), F.lit(0).alias("one"))
        return self.sources.join(named, "g").join(root.withColumn("one", F.lit(0)), "one").select("source", F.col("size").alias("n_docs"), "subroot", "root")

    def proofs(self) -> DataFrame:
        """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
        root = self.top.roots().select(F.lit(0).cast("bigint").alias("g"), F.col("h").alias("root"))
        nothing = F.lit("")
        start = self.top.leaves.groupBy("g").agg(F.max("size").alias("size")).join(root, "g").select("g", "size", nothing.alias("digests"), nothing.alias("turns"), "root")

        def top(node: dict, siblings: str, turns: str, way: dict) -> tuple:
            return node["pos"], siblings + way["digests"], turns + way["turns"], node["h"], way["root"]

        def leaf(node: dict, siblings: str, turns: str, way: dict) -> tuple:
            siblings, turns = siblings + way["digests"], turns + way["turns"]
            again = folded(node["seen"], siblings, turns)
            return node["doc_id"], node["h"], way["subroot"], way["root"], _sha(siblings), again, again == way["root"]

        above = self.top.scanned(self.top.leaves, self.top.ways(start), 0, top, "g long, digests string, turns string, subroot string, root string")
        above = store.written(above.join(self.sources.select("g", "size"), "g"), "subroot-ways")
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return self.trees.scanned(self.leaves, self.trees.ways(above), 0, leaf, schema)


def tampered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text without line ends where 2 divides the CRC-32 of the doc_id."""
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))
