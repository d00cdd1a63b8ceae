"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Documents are cut only where longer than a sequence; lengths travel, tokens do not. Only ``capacity`` different lengths exist, so
all pieces are packed at once from their counts by length: longest first, each into the tightest open bin, which a segment
tree over the remaining capacities finds in logarithmic time. Equal pieces go into equal bins in runs, so the work
and the list of runs depend on the capacity, not on the data. A piece's number among those of its length comes from
its number within its task and the counts of the tasks before, and gives its run, bin and offset.

Cases: null text is an empty document (its end id alone); null or repeated doc_ids are packed like
any other row; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bitpack import with_end
from sievewright.llm.bytes import slices
from sievewright.llm.tokens import TOKEN_SLICE_BYTES, encoder, tokenizer_path

class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf keeps runs (first bin, bins) of open bins with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]
        self.open = [False] * (2 * self.leaves)

    def _mark(self, room: int) -> None:
        i = room + self.leaves
        self.open[i] = bool(self.runs[room])
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def put(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs[room].append((first, bins))
            self._mark(room)

    def tightest(self, need: int) -> tuple[int, int, int] | None:
        """Take a run of open bins with the least room that holds ``need``: (room, first bin, bins)."""
        i = need + self.leaves
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        room = i - self.leaves
        first, bins = self.runs[room].pop()
        self._mark(room)
        return room, first, bins


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, number of its first piece, first bin, pieces to a bin, offset) that place every piece of every length.

    The tightest open bin takes pieces until no other fits, so a run of n pieces fills its bins one after another.
    """
    tree, made, out = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        done, most = 0, counts[length]
        while done < most:
            found = tree.tightest(length)
            if found is None:
                bins = -(-(most - done) // (capacity // length))
                found, made = (capacity, made, bins), made + bins
            room, first, bins = found
            each = room // length
            used = min(bins, -(-(most - done) // each))
            n = min(most - done, used * each)
            out.append((length, done, first, each, capacity - room))
            whole = n // each
            tree.put(room, first + used, bins - used)
            tree.put(room - each * length, first, whole)
            if n % each:
                tree.put(room - n % each * length, first + whole, 1)
            done += n
    return out


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document, each numbered within its task and length; with ``keep_ids`` their ids too."""
    vocabulary = tokenizer_path(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task, before = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, limit=TOKEN_SLICE_BYTES):
                ids, bounds = with_end(*e.encode(rows.column("text")), end_id)
                n = np.diff(bounds)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                order = np.argsort(length, kind="stable")
                same = np.searchsorted(length[order], length[order])  # where each length begins
                nth = np.empty(len(length), np.int64)
                nth[order] = before[length[order]] + np.arange(len(length)) - same
                before += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = (bounds[:-1][doc] + start) * 4
                spans = [raw[a : a + 4 * b] for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                out = [rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if keep_ids:
                    out, names = [*out, pa.array([bytes(s) for s in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * keep_ids
    return store.texts(docs).mapInArrow(cut, schema)


def pack_sequences(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Place every piece of every document: adds sequence_id and offset (gapless from 0 in each sequence)."""
    cut = store.written(pieces(docs, capacity, tokenizer, end_id, keep_ids), "pieces")
    counts = store.written(cut.groupBy("task", "length").count(), "piece-counts")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    runs = best_fit(total, capacity)
    base = dict(zip(sorted(total), np.concatenate([[0], np.cumsum([total[n] for n in sorted(total)], dtype=np.int64)]).tolist(), strict=False))
    # every run by the number of its first piece over all lengths, shortest length first
    table = sorted((base[n] + done, done, first, each, offset) for n, done, first, each, offset in runs)
    known = cut.sparkSession.sparkContext.broadcast((base, np.array(table, np.int64).reshape(-1, 5)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = known.value
        at = np.zeros(capacity + 1, np.int64)
        for n, v in base.items():
            at[n] = v
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            _, done, first, each, offset = table[np.searchsorted(table[:, 0], at[length] + nth, "right") - 1].T
            step = nth - done
            columns = [batch.column(c) for c in names] + [pa.array(first + step // each), pa.array(offset + step % each * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = [c for c in cut.columns if c not in ("task", "nth")]
    numbered = cut.join(before, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("before")).select(*names, "nth")
    return numbered.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in cut.select(*names).dtypes) + ", sequence_id long, offset long")
