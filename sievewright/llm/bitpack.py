"""Fixed-width token files: every id in the fewest bits the vocabulary needs.

File layout (little-endian, bits least significant first):
payload blocks | doc table (doc_id i64, has doc_id i64, first token i64, tokens i64) | block offsets u64 | footer.
A block holds ``BLOCK_TOKENS`` ids, so any id is found from its block's offset alone. A reader fetches the footer, the
part of the doc table it wants, and whole blocks by their offsets, never the file.

Cases: null text is an empty document (only its end id); a null doc_id is marked so and sorts
first; repeated doc_ids are separate documents, in the order of a hash of their texts; an empty table gives
files without documents; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bytes import slices
from sievewright.llm.tokens import TOKEN_SLICE_BYTES, encoder, tokenizer_path

MAGIC = b"SWBITPK2"
FOOTER = struct.Struct("<QQQQII8s")  # payload bytes, tokens, documents, blocks, bits, block tokens, magic
BLOCK_TOKENS = 8192
FILE_BYTES = 128 << 20  # of stored input to a file
READ_DOCS = 4096  # documents to a reading task
READ_TOKENS = 1 << 20  # ids unpacked at a time


def bits_for(vocabulary: int) -> int:
    return max(1, (int(vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    data = np.frombuffer(raw, np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = data[: n * bits // 8].reshape(n, bits // 8)
    elif n:
        flags = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
        out = np.packbits(np.pad(flags, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class Reader:
    """Random access to one file, given as bytes or as an open file with ``size``, ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = memoryview(source) if isinstance(source, bytes | bytearray | memoryview) else source
        end = len(self.source) if isinstance(self.source, memoryview) else self.source.size()
        self.payload, self.tokens, self.n_docs, self.blocks, self.bits, self.block, magic = FOOTER.unpack(self._bytes(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")

    def _bytes(self, at: int, n: int):
        if isinstance(self.source, memoryview):
            return self.source[at : at + n]
        self.source.seek(at)
        return self.source.read(n)

    def docs(self, first: int = 0, n: int | None = None) -> np.ndarray:
        """Rows (doc_id, has doc_id, first token, tokens) of documents first .. first+n."""
        n = self.n_docs - first if n is None else min(n, self.n_docs - first)
        return np.frombuffer(self._bytes(self.payload + 32 * first, 32 * n), "<i8").reshape(-1, 4)

    def offsets(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self._bytes(self.payload + 32 * self.n_docs + 8 * first, 8 * n), "<u8")

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start+n of the file, from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        have = min((last + 1) * self.block, self.tokens) - first * self.block
        at = self.offsets(first, last - first + 1)
        raw = self._bytes(int(at[0]), int(at[-1] - at[0]) + ((have - (last - first) * self.block) * self.bits + 7) // 8)
        whole = self.block * self.bits % 8 == 0  # blocks without padding between them unpack as one
        if whole:
            out = unpack(raw, have, self.bits)
        else:
            parts = [(int(a - at[0]), min(self.block, have - i * self.block)) for i, a in enumerate(at)]
            out = np.concatenate([unpack(raw[a : a + (m * self.bits + 7) // 8], m, self.bits) for a, m in parts])
        return out[start - first * self.block :][:n]


class Writer:
    def __init__(self, out, bits: int, block: int = BLOCK_TOKENS):
        self.out, self.bits, self.block = out, bits, block
        self.tokens = self.bytes = 0
        self.rest = np.zeros(0, np.uint32)
        self.docs: list[np.ndarray] = []
        self.offsets: list[int] = []

    def _blocks(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), self.block):
            raw = pack(ids[i : i + self.block], self.bits)
            self.offsets.append(self.bytes)
            self.out.write(raw)
            self.bytes += len(raw)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray, has: np.ndarray | None = None) -> None:
        has = np.ones(len(doc_ids), np.int64) if has is None else has
        self.docs.append(np.stack([doc_ids, has, self.tokens + bounds[:-1], np.diff(bounds)], axis=1).astype("<i8"))
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> None:
        self._blocks(self.rest)
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 4), "<i8")
        self.out.write(docs.tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.bytes, self.tokens, len(docs), len(self.offsets), self.bits, self.block, MAGIC))


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append an end id to every document."""
    out = np.full(len(ids) + len(bounds) - 1, end_id, np.uint32)
    new = bounds + np.arange(len(bounds))
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write documents in ascending doc_id order as packed files ``part-NNNNN.bin`` under ``path``.

    ``path`` must be reachable by every executor (``pyarrow.fs`` address). A task writes a hidden
    file and renames it when whole, so retried tasks leave one complete file. Returns one row per
    file (part, n_docs, n_tokens), computed when an action runs.
    """
    vocabulary = tokenizer_path(tokenizer)
    files = files or max(store.partitions(docs.sparkSession), -(-store.stored_bytes(docs) // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        context, e = TaskContext.get(), encoder(vocabulary)
        part, bits = context.partitionId(), bits_for(max(e.size, end_id + 1))
        hidden = f"{base}/.part-{part:05d}-{context.taskAttemptId()}"
        with where.open_output_stream(hidden) as out:
            w = Writer(out, bits)
            for batch in batches:
                for piece in slices(batch, limit=TOKEN_SLICE_BYTES):
                    named = piece.column("doc_id")
                    ids = named.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    w.add(ids, *with_end(*e.encode(piece.column("text")), end_id), named.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
            w.close()
        where.move(hidden, f"{base}/part-{part:05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sum(map(len, w.docs))], pa.int64()), pa.array([w.tokens], pa.int64())], ["part", "n_docs", "n_tokens"])

    order = ["doc_id", F.xxhash64("text")]  # the hash spreads the rows of a repeated or missing doc_id over files
    ordered = store.texts(docs).repartitionByRange(files, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(write, "part int, n_docs long, n_tokens long")


def _crcs(r: Reader, at: np.ndarray, n: np.ndarray) -> list[int]:
    """The checksum of each document's ids; neighbours are unpacked together, a long one in parts."""
    out, i = [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at + n, at[i] + READ_TOKENS, "right")))
        if n[i] > READ_TOKENS:
            crc = 0
            for s in range(0, int(n[i]), READ_TOKENS):
                crc = zlib.crc32(np.ascontiguousarray(r.ids(int(at[i]) + s, min(READ_TOKENS, int(n[i]) - s))), crc)
            out.append(crc)
        else:
            ids = memoryview(np.ascontiguousarray(r.ids(int(at[i]), int(at[j - 1] + n[j - 1] - at[i])))).cast("B")
            out += [zlib.crc32(ids[4 * a : 4 * (a + b)]) for a, b in zip((at[i:j] - at[i]).tolist(), n[i:j].tolist(), strict=True)]
        i = j
    return out


def read_files(spark, path: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """One row per document of the files, given as (part, n_docs, n_tokens); a task reads up to READ_DOCS documents by their places."""
    wanted, total = [], 0
    for part, n_docs, n_tokens in sorted(files):
        wanted.append((part, n_docs, total))
        total += n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for part, begin, before in zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "before")), strict=True):
                with where.open_input_file(f"{base}/part-{part:05d}.bin") as source:
                    r = Reader(source)
                    doc, has, at, n = r.docs(begin, READ_DOCS).T
                    crc = _crcs(r, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=has == 0), pa.array(before + at), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(wanted, "part int, n_docs long, before long").filter("n_docs > 0")  # a row per file
    ranges = table.select("part", "before", F.explode(F.expr(f"sequence(0L, n_docs - 1, {READ_DOCS}L)")).alias("begin"))
    dealt = ranges.repartition(max(1, min(sum(-(-n // READ_DOCS) for _, n, _ in files), 4 * store.partitions(spark))), "part", "begin")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents as packed files in the shared folder and describe every document as read back."""
    spark = docs.sparkSession
    path = store.made(spark, store.new_path(spark, "tokens"))
    files = [(r.part, r.n_docs, r.n_tokens) for r in write_files(docs, path, tokenizer, end_id).collect()]  # a row per file
    return read_files(spark, path, files)
