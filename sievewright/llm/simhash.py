"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight bytes
in place. The index keeps each distinct fingerprint under the values at three byte positions; the
eight position triples below leave no choice of five positions without a whole triple, so no link is missed
while a posting list is 2**24 times shorter than the table. In a list, shared positional
bytes are tallied per pair, pairs below five fall away, the rest are verified bit by bit. A list gives
only a spanning forest of its links, never all pairs. Lists above ``LIST_ROWS`` are refined by two more byte
positions (five in all, in every way) and, where still long, by a quarter of the other 24 bits: three different bits leave
one quarter the same. Neither loses a link, and a list so refined has 18 free bits, 2**18 distinct fingerprints at most.

``similar_documents`` is the same search for texts of a given similarity (five-word shingles, 0.8). There 64 bits say too little, so a SimHash has ``PLACES`` bytes: every distinct
shingle votes on eight bits of each. Texts at 0.8 keep a bit in 85 of 100 cases, so a byte in 27. The inverted index keeps each text under the values at two byte positions and the upper half of a third,
for each of the ``BANDS``; a list ties together those of its texts whose leading ``HEAD`` bytes differ in at most ``HEAD_BITS`` bits. Of what this ties together shared positional bytes are tallied per pair, pairs
below ``SHARED`` fall away, and the rest are verified by the Jaccard similarity of their whole shingle sets, so every link is right; of pairs at exactly 0.8 the index finds 99.9 % by simulation, of texts of eight and nine
words that share four of five shingles 96 % (the tests measure it). Lists and groups of any length are worked on in parts of ``LIST_ROWS`` and ``GROUP_ROWS``: long posting lists are tied together by their least
members, part by part, which loses nothing, as all that is tied is compared afterwards; long groups are compared with one member, and those unlike it with all others in blocks.

Cases: null text counts as empty; texts without words have fingerprint zero and link like any other;
repeated rows share everything; a null doc_id takes part but never names a component, unless alone (then the
component is null); an empty table gives no rows; other columns are ignored. ``keep_one_of_each`` keeps of each group the row with the
smallest doc_id (null last), of several such the one with the least SHA-256 of its text, then the first by the JSON of all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bytes import LOWER, flat, joined, mix, slices, words

SHINGLE = 3
SEED = 42
BITS = 3
LIST_ROWS = 4096
# Byte positions: all triples inside each half. Of any five positions, three lie in one half.
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


# Bytes of a wide SimHash, and the positions under which it is kept: two whole bytes and the upper half of a third (no two bands share more than one).
PLACES = 128
BANDS = [(i, (i + a) % PLACES, (i + b) % PLACES) for a, b in ((1, 7), (17, 45)) for i in range(PLACES)]
# Bands that are tied together before the next ones: 2, 30 and 224 of them.
WAVES = [range(0, len(BANDS), 128), [n for n in range(0, len(BANDS), 8) if n % 128], [n for n in range(len(BANDS)) if n % 8]]
HEAD, HEAD_BITS = 16, 40  # of 128 bits, pairs at 0.8 differ in 19 +- 4, unlike texts in 64 +- 6
SHARED = 12  # pairs at 0.8 share 34 +- 5 bytes, unlike texts 0.5 +- 0.7; fewer than one in a thousand pairs of the shortest texts share fewer
BUCKETS = 1 << 16
GROUP_ROWS, LIST_BYTES = 4096, 1 << 25  # texts, and bytes of shingle sets, in one part of a group
SALTS = 256


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of a string column, the row of each (ascending), and the number in each row."""
    data, bounds = flat(column)
    data = LOWER[data]
    starts, ends, rows = words(data, bounds)
    text, _, at = joined(data, starts, ends, rows)
    count = np.diff(rows)
    made = np.where(count == 0, 0, np.maximum(1, count - size + 1))
    first = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(count)), made)
    begin = rows[:-1][doc] + np.arange(first[-1]) - first[doc]
    last = np.minimum(begin + size - 1, rows[1:][doc] - 1)
    length = ends - starts
    a, b = at[begin], at[last] + length[last]
    h = xxhash.xxh64_intdigest
    hashed = np.fromiter((h(text[i:j], SEED) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    return hashed, doc, made


def fingerprints(column, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a string column."""
    hashed, doc, made = shingles(column, shingle)
    if not len(hashed):
        return np.zeros(len(made), np.uint64)
    return np.packbits(2 * _bit_sums(hashed, doc, len(made)) > made[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _bit_sums(hashed: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each bit is set in each row's hashes: bytes of up to 255 rows are added eight at a time inside one machine word."""
    hashed = hashed.reshape(len(hashed), -1)
    width = hashed.shape[1]  # several words for each shingle give as many times 64 bits
    step = max(1, (1 << 15) // width)
    totals = np.zeros((n, 64 * width), np.int64)
    raw = hashed.astype(">u8").view(np.uint8)
    for s in range(0, len(hashed), step):
        e = min(s + step, len(hashed))
        lanes = np.unpackbits(raw[s:e], axis=1).view(np.uint64)
        own = doc[s:e]
        cuts = np.union1d(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), np.arange(0, e - s, 255))
        np.add.at(totals, own[cuts], np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), -1))
    return totals


def fingerprinted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(rows.column("text")).view(np.int64))], ["doc_id", "fp"])

    return store.texts(docs).mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints (uint64) that differ in at most ``bits`` bits."""
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            differ = fps[rest] ^ fps[i]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            maybe = np.flatnonzero(shared >= 8 - bits)  # the count filter
            near = maybe[np.bitwise_count(differ[maybe]) <= bits]
            out += [(i, int(j)) for j in rest[near]]
            queue += rest[near].tolist()
            rest = np.delete(rest, near)
    return out


def _packed(n: int, places: tuple[int, ...]) -> Column:
    """The bytes at the places, after the number n."""
    value = F.lit(n).cast("bigint")
    for p in places:
        value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return value


def _postings(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(fp, key, rest): every fingerprint under each set of byte positions, and the bytes elsewhere."""
    entries = [F.struct(_packed(n, s).alias("key"), _packed(0, tuple(p for p in range(8) if p not in s)).alias("rest")) for n, s in enumerate(sets)]
    return nodes.select("fp", F.inline(F.array(*entries)))


def _quarters(lists: DataFrame) -> DataFrame:
    """Lists under five byte positions, each split by six of the other 24 bits, in four ways."""
    keys = [F.xxhash64(F.lit(f"quarter {q}"), "key", F.shiftright("rest", 6 * q).bitwiseAND(F.lit(63))) for q in range(4)]
    return lists.select("fp", F.explode(F.array(*keys)).alias("key"))


def _divided(lists: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Lists of up to LIST_ROWS fingerprints, and the longer ones if there are any."""
    long = store.written(lists.groupBy("key").count().filter(F.col("count") > LIST_ROWS).select("key"), name)
    if not long.limit(1).count():
        return lists, None
    return lists.join(long, "key", "left_anti"), lists.join(long, "key", "left_semi")


def posting_lists(nodes: DataFrame) -> DataFrame:
    """(fp, key) such that any two linked fingerprints share a key."""
    lists, long = _divided(store.written(_postings(nodes, TRIPLES).select("fp", "key"), "postings"), "long-lists")
    if long is None:
        return lists
    finer, long = _divided(store.written(_postings(long.select("fp").distinct(), FIVES), "postings-of-five"), "long-lists-of-five")
    lists = lists.unionByName(finer.select("fp", F.xxhash64(F.lit("five"), "key").alias("key")))
    return lists if long is None else lists.unionByName(_quarters(long))


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints: a spanning forest of every posting list."""
    spark, lists = nodes.sparkSession, posting_lists(nodes)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in store.whole_keys(batches, "key"):
            key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(at, len(key)))
            two = at[size == 2]
            two = np.stack([two, two + 1])[:, np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            a, b = two[0].tolist(), two[1].tolist()
            for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for i, j in forest(fp[s : s + n], bits):
                    a.append(s + i), b.append(s + j)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64), pa.int64()), pa.array(fp[b].view(np.int64), pa.int64())], ["a", "b"])

    dealt = lists.select("fp", "key").repartition(store.partitions(spark), "key").sortWithinPartitions("key").mapInArrow(match, "a long, b long")
    return dealt.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: repeated contraction of each node into its least neighbour.

    Every round writes its tables to the shared folder; hash-like node values make the rounds few (logarithmic).
    """
    spark, made = edges.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(store.new_path(spark, name))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    both = kept(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    roots = None
    while both.limit(1).count():
        old = list(made)
        parent = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        if roots is None:
            roots = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(parent.withColumnRenamed("u", "root"), "root", "left")
            roots = moved.select("node", F.coalesce("p", "root").alias("root"))
        roots = kept(roots, "roots")
        lower = both.join(parent, "u").select(F.col("p").alias("a"), "v")
        lower = lower.join(parent.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").filter("a <> b")
        both = kept(lower.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        for path in old:  # the last round's tables are no longer read
            store.remove(spark, path)
            made.remove(path)
    return roots if roots is not None else both.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id reachable over links."""
    once = store.written(fingerprinted(docs), "fingerprints")
    nodes = store.written(once.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = store.written(rooted, "rooted")
    named = store.written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    by_fp = store.written(rooted.join(named, "root").select("fp", "component_id"), "node-components")
    return once.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _distinct(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each row (upper half) with each of its shingles' 32-bit hashes (lower half) once, ascending."""
    return np.unique((doc.astype(np.uint64) << np.uint64(32)) | (hashed >> np.uint64(32)))


def sketches(hashed: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The wide SimHash of each row, PLACES bytes: a bit is 1 if set for over half the row's distinct shingles; all are 1 without shingles."""
    both = _distinct(hashed, doc)
    own, low, step = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF), 1 << 15
    seeds = mix(np.arange(1, PLACES // 8 + 1, dtype=np.uint64))
    totals, made = np.zeros((n, 8 * PLACES), np.int32), np.bincount(own, minlength=n)
    for s in range(0, len(low), step):
        rows = own[s : s + step]
        totals[rows[0] : rows[-1] + 1] += _bit_sums(mix(low[s : s + step, None] ^ seeds), rows - rows[0], rows[-1] - rows[0] + 1)
    out = np.packbits(2 * totals > made[:, None], axis=1)
    out[made == 0] = 255
    return out


def shingle_sets(hashed: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct 32-bit hashes of each row's shingles, ascending."""
    both = _distinct(hashed, doc)
    return np.split(both.astype(np.uint32), np.searchsorted(both >> np.uint64(32), np.arange(1, n)))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches ``similarity``."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= similarity * (len(a) + len(b) - both)


def _tree(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest over n rows, where ``near(i, rest)`` gives those of ``rest`` that are linked with i."""
    out, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            found = near(i, rest)
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
            rest = rest[~np.isin(rest, found)]
    return out


def _maybe(sketch: np.ndarray, i: int, rest: np.ndarray) -> np.ndarray:
    """The count filter: those that share enough positional bytes with i."""
    return rest[(sketch[rest] == sketch[i]).sum(axis=1) >= SHARED]


def _near(sketch: np.ndarray, sets: list[np.ndarray], similarity: float):
    return lambda i, rest: np.array([j for j in _maybe(sketch, i, rest).tolist() if alike(sets[i], sets[j], similarity)], np.int64)


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """k and sha of every row, its doc_id, its sketch and its node: a digest of its shingle set, the same for rows with the same set."""
    k, sha = store.row_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                hashed, doc, made = shingles(rows.column("text"), shingle)
                raw = sketches(hashed, doc, len(made))
                nodes = [hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in shingle_sets(hashed, doc, len(made))]
                yield pa.RecordBatch.from_arrays([*map(rows.column, ("k", "sha", "doc_id")), pa.array(nodes, pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary())], ["k", "sha", "doc_id", "node", "sketch"])

    shaped = store.texts(docs).select("doc_id", "text", k.alias("k"), sha.alias("sha"))
    return shaped.mapInArrow(run, "k string, sha string, doc_id long, node binary, sketch binary")


def _read(table, name: str = "sketch") -> np.ndarray:
    raw = table.column(name).to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _tied(nodes: DataFrame) -> DataFrame:
    """(node, root) of the heads of SimHashes that are tied to another: root is the least of all heads that are tied together, directly or not.

    Near copies share many lists and would be tied again in each. So the bands come in waves, few of them first, and what is tied already counts as one in the next wave.
    """
    spark, own = nodes.sparkSession, F.xxhash64("head")
    labelled, roots = nodes.select("sketch", "head", own.alias("label")), None
    for bands in WAVES:
        path = store.new_path(spark, "tied-heads")
        with store.scope(spark):  # the wave's work tables go when its roots are written
            if roots is not None:
                of = roots.select(F.col("node").alias("of"), "root")
                labelled = nodes.join(of, own == F.col("of"), "left").select("sketch", "head", F.coalesce("root", own).alias("label"))
                labelled = store.written(labelled, "labelled")
            more = components(store.written(_ties(labelled, bands), "ties"))
            (more if roots is None else _joined_further(roots, more)).write.parquet(path)
        roots = spark.read.schema("node long, root long").parquet(path)
    heads = nodes.select("head", own.alias("node")).distinct().join(roots, "node").select("head", F.col("root").alias("label"))
    least = heads.groupBy("label").agg(F.min("head").alias("root"))
    return heads.join(least, "label").select(F.col("head").alias("node"), "root")


def _joined_further(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of both, where ``more`` joins roots of ``roots`` with each other and with nodes that it lacks."""
    further = more.select(F.col("node").alias("of"), F.col("root").alias("further"))
    moved = roots.join(further, F.col("root") == F.col("of"), "left").select("node", F.coalesce("further", "root").alias("root"))
    return moved.unionByName(more.join(roots.select("node"), "node", "left_anti"))


def _ties(nodes: DataFrame, bands: Iterable[int]) -> DataFrame:
    """Pairs (a, b) of labels that a posting list ties together, each once: stars around the least label of what is tied in a short list, and of the long ones around that of each part.

    Heads with the same label (a hash of the head, later of what it is tied to) count as tied; two heads with clashing hashes are thus compared in vain, never lost.
    """
    spark = nodes.sparkSession

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                rows = batch.slice(at, 1 << 12)
                raw = _read(rows).astype(np.int64)
                for n, (i, j, half) in ((n, BANDS[n]) for n in bands):
                    key = (n << 20) | (raw[:, i] << 12) | (raw[:, j] << 4) | (raw[:, half] >> 4)
                    yield pa.RecordBatch.from_arrays([pa.array(key), rows.column("head"), rows.column("label")], ["key", "head", "label"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in store.whole_keys(batches, "key"):
            key, heads, label = table.column("key").to_numpy(), _read(table, "head").view(np.uint64), table.column("label").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(at, len(key)))
            two = at[size == 2]
            two = two[_differ(heads[two], heads[two + 1]) <= HEAD_BITS]
            a, b = [label[two]], [label[two + 1]]
            for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                some = label[s : s + n]
                if (some == some[0]).all():
                    continue
                own, top = heads[s : s + n], np.arange(n)
                for i, j in _tree(n, lambda i, rest, own=own: rest[_differ(own[rest], own[i]) <= HEAD_BITS]):
                    top[j] = top[i]
                least = some.copy()
                np.minimum.at(least, top, some)
                a.append(least[top]), b.append(some)
            ends = np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1)
            ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], ["a", "b"])

    postings = nodes.mapInArrow(post, "key long, head binary, label long")
    long = _long_keys(postings)
    short = postings if long is None else postings.join(long, "key", "left_anti")
    ties = short.repartition(store.partitions(spark), "key").sortWithinPartitions("key").mapInArrow(match, "a long, b long")
    if long is not None:
        parted = postings.join(long, "key", "left_semi").select("key", "label").distinct().withColumn("salt", F.pmod(F.xxhash64("label"), F.lit(SALTS)))
        parted = store.written(parted, "long-list-labels")
        least = store.written(parted.groupBy("key", "salt").agg(F.min("label").alias("least")), "least-of-parts")
        inside = parted.join(least, ["key", "salt"]).select(F.col("least").alias("a"), F.col("label").alias("b"))
        across = least.join(least.groupBy("key").agg(F.min("least").alias("first")), "key").select(F.col("first").alias("a"), F.col("least").alias("b"))
        ties = ties.unionByName(inside).unionByName(across)
    return ties.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _long_keys(postings: DataFrame) -> DataFrame | None:
    """Keys of posting lists above LIST_ROWS, if there are any. Only lists in buckets above it are counted one by one."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    over = F.col("n") > LIST_ROWS
    full = store.written(postings.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(over).select("bucket"), "full-buckets")
    if not full.limit(1).count():
        return None
    counts = postings.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    long = store.written(counts.filter(over).select("key"), "long-lists")
    return long if long.limit(1).count() else None


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ."""
    return np.bitwise_count(a ^ b).sum(axis=1)


def _groups(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are tied to another: by their heads, or by the same one."""
    roots = _tied(nodes).select(F.col("node").alias("of"), "root")
    rooted = nodes.select("node", "head").join(roots, F.col("head") == F.col("of"), "left").select("node", F.coalesce("root", "head").alias("root"))
    rooted = store.written(rooted, "tied")
    several = rooted.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    return rooted.join(several, "root", "left_semi").select("node", "root")


def _members(docs: DataFrame, once: DataFrame, roots: DataFrame, shingle: int) -> DataFrame:
    """(root, node, sketch, shingles) of every node that is tied to another; the texts of one row of each are read again."""
    chosen = once.groupBy("node").agg(F.min(F.struct("k", "sha")).alias("row")).join(roots.select("node", F.col("root").alias("of")), "node")
    chosen = chosen.select(F.col("row.k").alias("k"), F.col("row.sha").alias("sha"), "node", F.col("of").alias("root")).hint("merge")
    k, sha = store.row_key()
    keyed = store.texts(docs).select("doc_id", "text", k.alias("k"), sha.alias("sha"))
    texts = keyed.join(chosen, ["k", "sha"]).select("root", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                hashed, doc, made = shingles(rows.column("text"), shingle)
                sets = [own.tobytes() for own in shingle_sets(hashed, doc, len(made))]
                raw = sketches(hashed, doc, len(made))
                yield pa.RecordBatch.from_arrays([rows.column("root"), rows.column("node"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(sets, pa.binary())], ["root", "node", "sketch", "shingles"])

    return texts.mapInArrow(run, "root binary, node binary, sketch binary, shingles binary").dropDuplicates(["node"])


def _asked(asks: list[bool], joined: list[bool], near) -> list[tuple[int, int]]:
    """Links of the asking rows of a block, only those that join what was apart; rows that are ``joined`` are so from the start."""
    at = list(range(len(asks)))

    def find(i: int) -> int:
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    first = next((i for i, j in enumerate(joined) if j), 0)
    for i, j in enumerate(joined):
        at[i] = first if j else i
    out = []
    for i in np.flatnonzero(asks).tolist():
        apart = np.array([j for j in range(len(asks)) if find(j) != find(i)], np.int64)
        for j in near(i, apart):
            if find(j) != find(i):  # one link into each set of rows is enough
                out.append((i, j))
                at[find(j)] = find(i)
    return out


def _compared(rows: DataFrame, keys: list[str], similarity: float, asking: bool) -> DataFrame:
    """Links (a, b) inside each group of rows with the same keys, no more than join what is linked: a spanning forest, or with ``asking`` links of the rows that ask (``asks``) only."""
    spark = rows.sparkSession
    named = rows.withColumn("key", F.struct(*keys)).select(F.xxhash64("key").alias("hash"), F.to_json("key").alias("key"), "node", "sketch", "shingles", "asks", "joined")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in store.whole_keys(batches, "key"):
            key, node, asks, joined_ = (table.column(c).to_pylist() for c in ("key", "node", "asks", "joined"))
            raw, sets, a, b = _read(table), [np.frombuffer(v, np.uint32) for v in table.column("shingles").to_pylist()], [], []
            at = [i for i in range(len(key)) if not i or key[i] != key[i - 1]]
            for s, e in zip(at, [*at[1:], len(key)], strict=True):
                own, some = raw[s:e], sets[s:e]
                if asking:
                    links = _asked(asks[s:e], joined_[s:e], lambda i, rest, own=own, some=some: (j for j in _maybe(own, i, rest).tolist() if alike(some[i], some[j], similarity)))
                else:
                    links = _tree(e - s, _near(own, some, similarity))
                a += [node[s + i] for i, _ in links]
                b += [node[s + j] for _, j in links]
            yield _pairs(a, b)

    dealt = named.repartition(store.partitions(spark), "hash").sortWithinPartitions("hash", "key")
    return dealt.select("key", "node", "sketch", "shingles", "asks", "joined").mapInArrow(run, "a binary, b binary")


def verified(members: DataFrame, similarity: float) -> DataFrame:
    """Links between nodes that are tied together and as similar as asked, enough of them to join what is linked.

    Small groups are compared in one task. Of larger ones every part is compared with the group's least node; the nodes unlike it, in parts too, with every part, where
    one link to those like it is enough.
    """
    no, yes = F.lit(False), F.lit(True)
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"), F.min("node").alias("first"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("bytes") / LIST_BYTES))
    sizes = store.written(sizes.select("root", parts.alias("parts"), "first"), "group-sizes")
    large = sizes.filter("parts > 1")
    small = members.join(large.select("root"), "root", "left_anti").withColumns({"asks": no, "joined": no})
    links = _compared(small, ["root"], similarity, False)
    if not large.limit(1).count():
        return links
    big = members.join(large, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    big = store.written(big, "large-groups")
    columns = ["root", "part", "node", "sketch", "shingles", "asks", "joined"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    first = big.filter(F.col("node") == F.col("first")).withColumns({"part": each("parts"), "asks": yes, "joined": no})
    others = big.filter(F.col("node") != F.col("first"))
    stars = store.written(_compared(first.select(columns).unionByName(others.withColumns({"asks": no, "joined": no}).select(columns)), ["root", "part"], similarity, True), "stars")
    like = stars.select(F.col("b").alias("like")).distinct()
    others = store.written(others.join(like, F.col("node") == F.col("like"), "left").withColumn("joined", F.col("like").isNotNull()).drop("like"), "like-the-first")
    left = others.filter("NOT joined")
    shares = left.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum(F.length("shingles")) / LIST_BYTES)).alias("shares"))
    shares = store.written(shares.withColumnRenamed("root", "of"), "left-sizes")
    block = [*columns, "share"]
    asks = left.join(shares, F.col("root") == F.col("of")).withColumn("share", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")))
    asks = asks.withColumns({"own": F.col("part"), "part": each("parts"), "asks": yes}).filter(F.col("own") != F.col("part"))
    asked = others.join(shares, F.col("root") == F.col("of")).withColumn("share", each("shares"))
    # a row that asks is in its own part already, in its share as asking and in the others as asked
    asked = asked.withColumn("asks", ~F.col("joined") & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")) == F.col("share")))
    rest = _compared(asks.select(block).unionByName(asked.select(block)), ["root", "part", "share"], similarity, True)
    return links.unionByName(stars).unionByName(rest)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: k and sha (its row's key), doc_id, its node, and root, which all documents joined by links share."""
    once = store.written(_sketched(docs, shingle), "sketches")
    nodes = once.groupBy("node").agg(F.first("sketch").alias("sketch")).withColumn("head", F.substring("sketch", 1, HEAD))
    members = store.written(_members(docs, once, _groups(store.written(nodes, "nodes")), shingle), "members")
    links = verified(members, similarity).filter("a <> b")
    roots = components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).select(F.col("node").alias("of"), "root")
    out = once.select("k", "sha", "doc_id", "node").join(roots, F.col("node") == F.col("of"), "left")
    return out.select("k", "sha", "doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of similar documents one row, with all its columns."""
    rows = store.written(similar_documents(docs, shingle, similarity), "similar")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "sha")
    first = rows.groupBy("root").agg(F.min(place).alias("first")).select("root", F.col("first.doc_id").alias("d"), F.col("first.sha").alias("s"))
    decided = rows.join(first, "root").select("k", "sha", (F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))).alias("kept"))
    return store.only_kept(docs, decided)
