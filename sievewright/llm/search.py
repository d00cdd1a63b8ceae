"""Ranked lexical search by Fagin's threshold algorithm over blocks of documents.

The index is dealt by documents: every block of rows has a forward index (the terms of each document with their counts) and, built from it in the task, one list
for each term, sorted by impact. For a query its lists are read in turns, a chunk of each; each document met for the first time is looked up in
the forward index and scored in full. What no list has shown yet scores at most the sum of the impacts at the places reached: once that is strictly below the
score of the k-th best, nothing unseen can enter, not even by a smaller doc_id, and the search stops. A task carries each query's best over all its blocks, so that later
blocks stop sooner, and hands on k rows a query; the best of these are ranked at the end.

Queries are a stated set that is searched in blocks: each holds up to ``BLOCK_CHARS`` characters of distinct terms (a single longer query is a block of its own, which a task must hold in any case),
and the documents are read once for each block. A block's terms and their document counts are what is broadcast. Documents, postings, statistics and
results stay distributed.

A term's weight is floor(1000 ln((2N+2)/(2df+1))), in doubles; a document counts a term w * ((10**9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L, in integers.
N counts documents with a term, L their terms, n a document's terms, df the documents with the term, tf its occurrences.

Cases: null and empty texts and those without terms count nowhere; a query without terms, or whose terms no document holds, has no rows; rows that repeat a
doc_id are documents of their own and may both be listed; query rows that repeat an item_id are one query with the terms of all; a null doc_id is listed after all
others of its score, a null item_id is a query like any other; scores of 0 are not listed; a text of any length is read in pieces; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import store

K = 10
BLOCK_CHARS = 2_000_000
PIECE = 1 << 22  # characters of a text that are cut into terms at a time
POSTINGS = 1 << 20  # postings of a block of documents
CHUNK = 16  # first chunk of a list; every further one is twice as long
# ASCII letters, figures and everything beyond ASCII make terms; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_INDEX = "doc_id long, n long, terms array<int>, tfs array<long>"


def terms(text: Column) -> Column:
    """The text's terms in order, repeats included."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def split(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, those of a piece at a time; pieces end at a character that is in no term."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        stop = end.start() if end else len(text)
        yield text[at:stop].encode().translate(_PLAIN).split()
        at = stop


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: all its terms counted, those of the vocabulary by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text")):
                n, counts = 0, Counter()
                for piece in split(text.as_py()):
                    n += len(piece)
                    counts.update(map(number, piece))
                counts.pop(None, None)
                if n:
                    rows.append((i, n, list(counts), list(counts.values())))
            at, n, said, tfs = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(said, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return store.texts(docs).mapInArrow(run, _INDEX)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms; products beyond 64 bits are taken whole."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // n_terms


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after another."""
    size = np.maximum(0, ends - starts)
    first = np.cumsum(size) - size
    return np.repeat(starts - first, size) + np.arange(size.sum())


class Block:
    """The index of a block of documents: forward rows and lists sorted by impact."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, words: np.ndarray, tfs: np.ndarray, m: np.ndarray, vocabulary: int) -> None:
        self.bounds, self.words, self.rows = bounds, words, len(n)
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        self.part = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc])  # impact without the term's weight
        order = np.lexsort((-self.part, words))
        self.docs, self.parts = doc[order], self.part[order]
        self.lists = np.searchsorted(words[order], np.arange(vocabulary + 1))

    def best(self, query: np.ndarray, weights: np.ndarray, worth: np.ndarray, least: int, k: int = K, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores, among them all of the k best that score at least ``least``; ``worth`` is an all-zero array over the vocabulary."""
        start, end = self.lists[query], self.lists[query + 1]
        some = end > start
        query, weights, start, end = query[some], weights[some], start[some], end[some]
        worth[query] = weights
        met, found, scores = np.zeros(self.rows, bool), [], np.zeros(0, np.int64)
        kth = least
        while len(start):
            stop = np.minimum(start + chunk, end)
            new = np.unique(self.docs[_spans(start, stop)])
            new = new[~met[new]]
            met[new] = True
            if len(new):
                found.append(new)
                scores = np.concatenate([scores, self.scored(new, worth)])
                if len(scores) >= k:
                    kth = max(least, int(np.partition(scores, -k)[-k]))
            more = stop < end
            if (weights * self.parts[stop - 1])[more].sum() < kth:  # what was read last bounds all that follows in its list
                break
            start, end, weights, chunk = stop[more], end[more], weights[more], 2 * chunk
        worth[query] = 0
        rows = np.concatenate(found) if found else np.zeros(0, np.int64)
        return rows[scores > 0], scores[scores > 0]

    def scored(self, rows: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Whole scores by random access to the forward index."""
        a, b = self.bounds[rows], self.bounds[rows + 1]
        at = _spans(a, b)
        sums = np.concatenate([[0], np.cumsum(worth[self.words[at]] * self.part[at])])
        ends = np.cumsum(b - a)
        return sums[ends] - sums[ends - (b - a)]


def blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The queries with their distinct terms, in blocks of up to ``most`` characters; made distinct in Spark."""
    each = items.select(F.col(key).cast("bigint").alias("item_id"), F.explode(terms(F.col(text))).alias("term"))
    block, chars = [], 0
    for r in each.groupBy("item_id").agg(F.collect_set("term").alias("terms")).toLocalIterator():
        size = sum(map(len, r.terms)) + len(r.terms)
        if block and chars + size > most:
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.terms))
        chars += size
    if block:
        yield block


def _candidates(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, vocabulary: int, k: int, postings: int, chunk: int) -> DataFrame:
    """Each task's best k documents of each query (by number), over all blocks that the task reads."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in shared.value]  # (-score, doc_id is null, doc_id), ascending
        worth = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for rows in _cut(batch, postings):
                said, tfs = rows.column("terms"), rows.column("tfs")
                n = rows.column("n").to_numpy()
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(said).to_numpy(zero_copy_only=False))]).astype(np.int64)
                block = Block(n, bounds, said.flatten().to_numpy(), tfs.flatten().to_numpy(), lengths(n, n_docs, n_terms), vocabulary)
                ids = rows.column("doc_id").to_pylist()
                for q, (_, query, weights) in enumerate(shared.value):
                    least = -best[q][-1][0] if len(best[q]) == k else 1
                    at, scores = block.best(query, weights, worth, least, k, chunk)
                    enough = scores >= least
                    best[q] = sorted(best[q] + [(-s, ids[i] is None, ids[i] or 0) for i, s in zip(at[enough].tolist(), scores[enough].tolist(), strict=True)])[:k]
        out = [(q, None if none else i, -s) for q, rows in enumerate(best) for s, none, i in rows]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "doc_id", "score"])

    return index.mapInArrow(run, "q long, doc_id long, score long")


def _cut(batch: pa.RecordBatch, postings: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in blocks of about that many postings."""
    ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + postings, "right")))
        yield batch.slice(at, end - at)
        at = end


def ranked(docs: DataFrame, items: DataFrame, k: int = K, key: str = "item_id", text: str = "text", postings: int = POSTINGS, chunk: int = CHUNK) -> DataFrame:
    """Each item's k highest-scoring documents: item_id, rank (from 1), doc_id, score."""
    spark, out = docs.sparkSession, None
    for block in blocks(items, key, text):
        numbers = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        index = store.written(forward_index(docs, {t.encode(): i for t, i in numbers.items()}), "forward-index")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r.term: r["count"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # as large as the block's vocabulary
        queries = []
        for item, own in block:
            at = np.array(sorted(i for t in own if (i := numbers[t]) in df), np.int64)
            queries.append((item, at, np.array([weight(n_docs, df[i]) for i in at.tolist()], np.int64)))
        names = spark.createDataFrame([(q, item) for q, (item, _, _) in enumerate(queries)], "q long, item_id long")
        part = _candidates(index, queries, n_docs, n_terms, len(numbers), k, postings, chunk).join(names, "q").select("item_id", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
