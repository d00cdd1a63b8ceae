"""Substring deduplication on a De Bruijn graph of word k-mers.

Every window of k words is an edge between the nodes of its first and last k-1 words. Documents are dealt into
batches by a hash of doc_id and text; batches exchange short byte blobs with hash partitions of the graph:

1. *Candidates.* Each edge is named by its minimizer, the least hash of the m-word sequences inside it.
   A partition learns which minimizers occur in two documents; edges under another one are unique.
2. *Edges.* The candidate edges' 64-bit hashes go to the partition of their minimizer, so neighbours
   on a path travel together, each distinct edge once per batch. The partition finds the first place (smallest doc_id, then
   position) of each edge and the degrees of the nodes between them, compacts runs of edges whose inner nodes have one way in and
   one way out and whose first places follow each other, and answers with one source coordinate per compacted path.
3. *Compaction.* Joined back to its batch, paths that continue each other across partitions become one span.
4. *Verification.* Spans, cut at multiples of ``UNIT`` words of the source, are compared with the words at their
   source coordinates by 128-bit digests.
5. *Doubt.* Where a span differs, hashes of different windows were equal. The words of all windows under those hashes, in every
   batch that has them, are compared themselves, by one join on the words. Below some 10**9 windows the first four steps are one
   plan, made again in parts if there is doubt; beyond, where clashes are to be expected, each step's result is written.

Hot passages reach a partition once per batch, and a source once per batch and distinct unit. A batch has ``BATCH_BYTES`` of stored input
(eight times as much beyond ``WIDE_BYTES``), a partition ``PART_BYTES``, so both grow with the data and each task's memory
does not; a batch sends one message of about 40 bytes beside its content to each partition it has minimizers for.

Cases: null text is empty; texts shorter than k words keep every word; a null doc_id counts as larger
than any other, the largest number too; rows with one doc_id never remove each other's words; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bytes import flat, joined, runs, span_hashes, words

WINDOW = 13
MINIMIZER = 7
UNIT = 32
BATCH_BYTES = 2 << 20  # of stored input
WIDE_BYTES = 1 << 40
PART_BYTES = 128 << 20
NULL_AT = 1 << 40  # places of rows without doc_id: the largest doc_id, behind all positions


def _smaller(doc: np.ndarray, pos: np.ndarray, than: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the document of one place is smaller than that of another; a missing doc_id is the largest."""
    return (doc < than) | ((doc == than) & (pos < NULL_AT) & (at >= NULL_AT))


def _delta(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=0).astype("<i8").tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<i8"))


def _blob(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


class Batch:
    """Words, windows and minimizers of one batch of documents, in (doc_id, text) order."""

    def __init__(self, docs: pa.Table, k: int, m: int, bits: int = 64):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # nulls last
        self.k, self.m, self.mask = k, m, np.uint64((1 << bits) - 1)
        self.null = docs.column("doc_id").is_null().to_numpy().astype(bool)
        self.ids = docs.column("doc_id").fill_null(int(np.iinfo(np.int64).max)).to_numpy().astype(np.int64)
        self.behind = np.where(self.null, NULL_AT, 0)
        self.data, bounds = flat(docs.column("text"))
        self.starts, self.ends, self.rows = words(self.data, bounds)

    def text(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        return joined(self.data, self.starts, self.ends, self.rows, keep)

    def hash(self) -> Batch:
        h = span_hashes(self.data, self.starts, self.ends)
        count = np.diff(self.rows)
        n, k, m = len(h), self.k, self.m
        end = np.repeat(self.rows[1:], count)
        self.win = np.flatnonzero(end - np.arange(n) >= k)
        self.doc = np.repeat(np.arange(len(count)), count)[self.win]
        if len(self.win):
            small, self.edges = runs(h, m), runs(h, k)[self.win] & self.mask
            least = small[: n - k + 1].copy()
            for j in range(1, k - m + 1):
                np.minimum(least, small[j : j + n - k + 1], out=least)
            self.least = least[self.win]
        else:
            self.least = self.edges = np.zeros(0, np.uint64)
        return self

    def minimizers(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers by value, whether in two documents here; then their order and bounds by partition."""
        new = np.ones(len(self.least), bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.doc[1:] != self.doc[:-1])
        value, docs = self.least[new], self.doc[new]
        order = np.argsort(value, kind="stable")
        value, ids, null = value[order], self.ids[docs[order]], self.null[docs[order]]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(value))[: len(first)] - 1
        value, twice = value[first], (ids[first] != ids[last]) | (null[first] != null[last])
        part = (value % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        return value, twice, by_part, np.searchsorted(part[by_part], np.arange(parts + 1))

    def candidates(self, parts: int, bits: pa.Table) -> None:
        """Keep the windows whose minimizer occurs in two documents of the corpus; find each edge's first place here."""
        value, _, by_part, bounds = self.minimizers(parts)
        known = np.zeros(len(value), bool)
        for r, raw in zip(bits.column("r").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            a, b = bounds[r], bounds[r + 1]
            known[by_part[a:b]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
        keep = np.flatnonzero(known[np.searchsorted(value, self.least)]) if len(value) else np.zeros(0, np.int64)
        self.cdoc, part = self.doc[keep], self.least[keep] % np.uint64(parts)
        # an edge's name ends with its partition, so that windows of one name meet there
        self.cedge, self.cpart = (self.edges[keep] << np.uint64((parts - 1).bit_length())) | part, part.astype(np.int64)
        self.cpos = self.win[keep] - self.rows[self.cdoc]
        self.cplace = self.cpos + self.behind[self.cdoc]
        order = np.argsort(self.cedge, kind="stable")
        edge = self.cedge[order]
        new = np.concatenate([[True], edge[1:] != edge[:-1]]) if len(edge) else np.zeros(0, bool)
        self.group = np.empty(len(edge), np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = order[new]
        self.source_doc, self.source_pos = self.ids[self.cdoc[first]], self.cplace[first].copy()
        self.source_batch, self.source_row = np.full(len(first), -1), self.cdoc[first].copy()  # -1: this batch
        sent = np.sort(first)
        part = self.cpart[sent]
        by = np.argsort(part, kind="stable")
        self.sent, self.sent_bounds = sent[by], np.searchsorted(part[by], np.arange(parts + 1))

    def sources(self, answers: pa.Table) -> None:
        """Take over the corpus-wide first places of the compacted paths where they are not in this batch."""
        for r, paths in zip(answers.column("r").to_pylist(), answers.column("paths").to_pylist(), strict=True):
            idx, n, doc, pos, batch, row = np.frombuffer(paths, "<i8").reshape(6, -1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            g = self.group[self.sent[self.sent_bounds[r] + np.repeat(idx, n) + step]]
            self.source_doc[g], self.source_pos[g] = np.repeat(doc, n), np.repeat(pos, n) + step
            self.source_batch[g], self.source_row[g] = np.repeat(batch, n), np.repeat(row, n)

    def spans(self, without: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Compacted paths: document row, start, words, source batch, row and start; windows with an edge of ``without`` take no part."""
        sdoc, spos = self.source_doc[self.group], self.source_pos[self.group]
        found = _smaller(sdoc, spos, self.ids[self.cdoc], self.cplace)
        if without is not None:
            found &= ~np.isin(self.cedge, without)
        hit = np.flatnonzero(found)
        doc, pos, spos = self.cdoc[hit], self.cpos[hit], spos[hit] % NULL_AT
        batch, row = self.source_batch[self.group][hit], self.source_row[self.group][hit]
        new = np.ones(len(hit), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (batch[1:] != batch[:-1]) | (row[1:] != row[:-1]) | (spos[1:] != spos[:-1] + 1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(hit))) + self.k - 1
        return doc[at], pos[at], n, batch[at], row[at], spos[at]

    def units(self, spans: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Spans cut at multiples of UNIT source words: span, source batch, row and start, words, digest."""
        doc, pos, n, batch, row, spos = spans
        count = (spos + n - 1) // UNIT - spos // UNIT + 1
        span = np.repeat(np.arange(len(doc)), count)
        nth = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
        a = np.where(nth == 0, spos[span], (spos[span] // UNIT + nth) * UNIT)
        b = np.minimum((spos[span] // UNIT + nth + 1) * UNIT, spos[span] + n[span])
        first = self.rows[doc[span]] + pos[span] + a - spos[span]
        return span, batch[span], row[span], a, b - a, self.digests(first, first + (b - a) - 1)

    def window_texts(self, at: np.ndarray) -> list[str]:
        """The words of the candidate windows at these places, joined by one space."""
        text, _, begin = self.text()
        first = self.rows[self.cdoc[at]] + self.cpos[at]
        last = first + self.k - 1
        return [text[i:j].decode() for i, j in zip(begin[first].tolist(), (begin[last] + (self.ends - self.starts)[last]).tolist(), strict=True)]

    def digests(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        text, _, at = self.text()
        if not len(first):
            return []
        a, b = at[first], at[last] + (self.ends - self.starts)[last]
        return [xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


NOTE = "b int, r int, bits binary, paths binary, bad_batch int, bad_row int, bad_pos int, bad_n int, bad_digest binary, edge long, least_null boolean, least long, words string"


def _note(n: int, **columns) -> pa.Table:
    """Rows for a batch, with nulls in the columns not given."""
    types = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    given = dict(f.split() for f in NOTE.split(", "))
    return pa.table({c: columns[c] if c in columns else pa.nulls(n, types[t]) for c, t in given.items()})


def _some(table: pa.Table, column: str) -> pa.Table:
    return table.filter(table.column(column).is_valid())


def substring_dedup(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, with_text: bool = False, edge_bits: int = 64) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    k, m, stored = window, minimizer, store.stored_bytes(docs)
    parts = max(store.partitions(docs.sparkSession), -(-stored // PART_BYTES))
    batches = max(store.partitions(docs.sparkSession), -(-stored // (BATCH_BYTES * (8 if stored > WIDE_BYTES else 1))))
    dealt = store.texts(docs).withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))

    def ask(docs: pa.Table) -> pa.Table:
        x = Batch(docs, k, m).hash()
        value, twice, order, bounds = x.minimizers(parts)
        low, b = (value // np.uint64(parts)).astype(np.uint32)[order], docs.column("b")[0].as_py()
        has = np.flatnonzero(np.diff(bounds)).tolist()
        cut = [(bounds[r], bounds[r + 1]) for r in has]
        twice = twice[order]
        return pa.table({"r": pa.array(has, pa.int32()), "b": pa.array([b] * len(has), pa.int32()), "vals": _blob([low[i:j].tobytes() for i, j in cut]), "twice": _blob([np.packbits(twice[i:j]).tobytes() for i, j in cut])})

    def answer(asked: pa.Table) -> pa.Table:
        vals = [np.frombuffer(v, "<u4") for v in asked.column("vals").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)) for v, t in zip(vals, asked.column("twice").to_pylist(), strict=True)]).astype(bool)
        _, inverse, count = np.unique(np.concatenate(vals), return_inverse=True, return_counts=True)
        often = count > 1
        often[inverse[twice]] = True
        ends = np.cumsum([len(v) for v in vals])[:-1]
        return _note(len(vals), b=asked.column("b"), r=asked.column("r"), bits=_blob([np.packbits(x).tobytes() for x in np.split(often[inverse], ends)]))

    def send(docs: pa.Table, bits: pa.Table) -> pa.Table:
        names = ("docs", "rows", "pos", "edges")
        if not docs.num_rows:
            return pa.table({"r": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), **{c: _blob([]) for c in names}})
        x = Batch(docs, k, m, edge_bits).hash()
        x.candidates(parts, bits)
        has = np.flatnonzero(np.diff(x.sent_bounds)).tolist()
        cut = [x.sent[x.sent_bounds[r] : x.sent_bounds[r + 1]] for r in has]
        b = docs.column("b")[0].as_py()
        columns = ([_delta(x.ids[x.cdoc[c]]) for c in cut], [_delta(x.cdoc[c]) for c in cut], [_delta(x.cplace[c]) for c in cut], [x.cedge[c].tobytes() for c in cut])
        return pa.table({"r": pa.array(has, pa.int32()), "b": pa.array([b] * len(has), pa.int32()), **{n: _blob(c) for n, c in zip(names, columns, strict=True)}})

    def first_places(sent: pa.Table) -> pa.Table:
        edge = [np.frombuffer(e, "<u8") for e in sent.column("edges").to_pylist()]
        ends = np.cumsum([len(e) for e in edge])
        edge = np.concatenate(edge)
        doc, row, pos = (np.concatenate([_whole(x) for x in sent.column(c).to_pylist()]) for c in ("docs", "rows", "pos"))
        batch = np.repeat(sent.column("b").to_numpy().astype(np.int64), np.diff(ends, prepend=0))
        order = np.lexsort((row, batch, pos, doc, edge))  # rows that repeat a doc_id by their batch
        new = np.concatenate([[True], edge[order][1:] != edge[order][:-1]])
        name, first = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
        name[order] = np.cumsum(new) - 1
        first[order] = order[np.flatnonzero(new)[name[order]]]
        # nodes between neighbouring edges: how many different edges leave and enter them
        after = np.zeros(len(edge), bool)
        after[:-1] = (batch[1:] == batch[:-1]) & (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1)
        after[ends[:-1] - 1] = False
        a, b = (np.unique(np.stack([name[:-1][after[:-1]], name[1:][after[:-1]]]), axis=1)) if after.any() else np.zeros((2, 0), np.int64)
        out, into = np.bincount(a, minlength=int(new.sum())), np.bincount(b, minlength=int(new.sum()))
        plain = after.copy()
        plain[:-1] &= (out[name[:-1]] == 1) & (into[name[1:]] == 1)
        # paths: unbranched runs of repeated edges whose first places follow each other
        hit = np.flatnonzero(_smaller(doc[first], pos[first], doc, pos))
        source = first[hit]
        starts = np.ones(len(hit), bool)
        starts[1:] = ~plain[hit[:-1]] | (hit[1:] != hit[:-1] + 1) | (batch[source[1:]] != batch[source[:-1]]) | (row[source[1:]] != row[source[:-1]]) | (pos[source[1:]] != pos[source[:-1]] + 1)
        at = np.flatnonzero(starts)
        n = np.diff(np.append(at, len(hit)))
        owner, begin = np.searchsorted(ends, hit[at], "right"), np.concatenate([[0], ends])
        paths = np.stack([hit[at] - begin[owner], n, doc[source[at]], pos[source[at]], batch[source[at]], row[source[at]]]) if len(at) else np.zeros((6, 0), np.int64)
        owners = np.unique(owner)
        cut = np.searchsorted(owner, np.append(owners, len(ends)))
        taken = pa.array(owners)
        return _note(len(owners), b=sent.column("b").take(taken), r=sent.column("r").take(taken), paths=_blob([paths[:, i:j].astype("<i8").tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]))

    def whole(docs: pa.Table, notes: pa.Table) -> Batch:
        """The batch with everything known about its edges."""
        x = Batch(docs, k, m, edge_bits).hash()
        x.candidates(parts, _some(notes, "bits"))
        x.sources(_some(notes, "paths"))
        return x

    def claim(docs: pa.Table, notes: pa.Table) -> pa.Table:
        schema = pa.schema([("sb", pa.int32()), ("srow", pa.int32()), ("spos", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("b", pa.int32())])
        if not docs.num_rows:
            return schema.empty_table()
        x, own = whole(docs, notes), docs.column("b")[0].as_py()
        _, batch, row, spos, n, digest = x.units(x.spans())
        batch = np.where(batch < 0, own, batch)
        kept = list(dict.fromkeys(zip(batch.tolist(), row.tolist(), spos.tolist(), n.tolist(), digest, strict=True)))
        return pa.table([*(list(zip(*kept, strict=True)) or [[]] * 5), [own] * len(kept)], schema=schema)

    def differ(docs: pa.Table, claims: pa.Table) -> pa.Table:
        """Claims that the words at their source coordinates do not bear out, for the batch that made them."""
        bad = np.ones(claims.num_rows, bool)
        if docs.num_rows and claims.num_rows:
            x = Batch(docs, k, m)
            row, spos, n = (claims.column(c).to_numpy() for c in ("srow", "spos", "n"))
            fits = np.flatnonzero(spos + n <= np.diff(x.rows)[row])
            first = x.rows[row[fits]] + spos[fits]
            said = claims.column("digest").to_pylist()
            bad[[i for i, d in zip(fits.tolist(), x.digests(first, first + n[fits] - 1), strict=True) if d == said[i]]] = False
        wrong = claims.filter(pa.array(bad))
        return _note(wrong.num_rows, b=wrong.column("b"), bad_batch=wrong.column("sb"), bad_row=wrong.column("srow"), bad_pos=wrong.column("spos"), bad_n=wrong.column("n"), bad_digest=wrong.column("digest"))

    def doubt(docs: pa.Table, notes: pa.Table) -> pa.Table:
        """(r, edge) of every window in a span that failed."""
        wrong = _some(notes, "bad_digest")
        if not docs.num_rows or not wrong.num_rows:
            return pa.table({"r": pa.array([], pa.int32()), "edge": pa.array([], pa.int64())})
        x, own = whole(docs, notes), docs.column("b")[0].as_py()
        spans = x.spans()
        failed = set(zip(*(wrong.column(c).to_pylist() for c in ("bad_batch", "bad_row", "bad_pos", "bad_n", "bad_digest")), strict=True))
        span, batch, *unit, digest = x.units(spans)
        bad = np.zeros(len(spans[0]), bool)
        bad[[s for s, *u in zip(span.tolist(), np.where(batch < 0, own, batch).tolist(), *(u.tolist() for u in unit), digest, strict=True) if tuple(u) in failed]] = True
        doc, pos, n = (v[bad] for v in spans[:3])
        place = x.rows[doc] + pos
        mark = np.zeros(len(x.starts) + 1, np.int64)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + n - k + 1, -1)
        at = np.flatnonzero(np.cumsum(mark)[x.rows[x.cdoc] + x.cpos] > 0)
        edges, where = np.unique(x.cedge[at], return_index=True)
        return pa.table({"r": pa.array(x.cpart[at][where], pa.int32()), "edge": pa.array(edges.view(np.int64))})

    def holders(sent: pa.Table, edges: pa.Table) -> pa.Table:
        """The batches that sent an edge in doubt."""
        wanted, b, e = edges.column("edge").to_numpy().view(np.uint64), [], []
        for batch, raw in zip(sent.column("b").to_pylist(), sent.column("edges").to_pylist(), strict=True):
            found = np.intersect1d(np.frombuffer(raw, "<u8"), wanted)
            b += [batch] * len(found)
            e += found.astype(np.uint64).view(np.int64).tolist()
        return _note(len(b), b=pa.array(b, pa.int32()), edge=pa.array(e, pa.int64()))

    def spelled(docs: pa.Table, notes: pa.Table) -> pa.Table:
        """The different windows of a batch under the edges in doubt, each with its least doc_id there."""
        if not docs.num_rows or not notes.num_rows:
            return pa.table({"b": pa.array([], pa.int32()), "edge": pa.array([], pa.int64()), "words": pa.array([], pa.string()), "own_null": pa.array([], pa.bool_()), "own": pa.array([], pa.int64())})
        x, b = whole(docs, notes), docs.column("b")[0].as_py()
        at = np.flatnonzero(np.isin(x.cedge, _some(notes, "edge").column("edge").to_numpy().view(np.uint64)))
        least = {}
        for i, t in zip(at.tolist(), x.window_texts(at), strict=True):  # in ascending order of doc_id, nulls last
            least.setdefault(t, i)
        first = np.array(list(least.values()), np.int64)
        return pa.table({"b": pa.array([b] * len(least), pa.int32()), "edge": pa.array(x.cedge[first].view(np.int64)), "words": pa.array(list(least), pa.string()), "own_null": pa.array(x.null[x.cdoc[first]]), "own": pa.array(x.ids[x.cdoc[first]])})

    def finish(docs: pa.Table, notes: pa.Table) -> pa.Table:
        schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("doubt", pa.bool_())] + [("text", pa.string())] * with_text
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in schema})
        x, exact = whole(docs, notes), _some(notes, "words")
        edges = exact.column("edge").to_numpy().view(np.uint64) if exact.num_rows else None
        doc, pos, n, *_ = x.spans(edges)
        if edges is not None:
            known = {w: (null, d) for w, null, d in zip(*(exact.column(c).to_pylist() for c in ("words", "least_null", "least")), strict=True)}
            at = np.flatnonzero(np.isin(x.cedge, edges))
            own = zip(x.null[x.cdoc[at]].tolist(), x.ids[x.cdoc[at]].tolist(), strict=True)
            more = at[[known[t] < o for t, o in zip(x.window_texts(at), own, strict=True)]]
            doc, pos, n = np.append(doc, x.cdoc[more]), np.append(pos, x.cpos[more]), np.append(n, np.full(len(more), k))
        mark = np.zeros(len(x.starts) + 1, np.int64)
        np.add.at(mark, x.rows[doc] + pos, 1)
        np.add.at(mark, x.rows[doc] + pos + n, -1)
        keep = np.cumsum(mark[:-1]) == 0
        text, bounds, _ = x.text(keep)
        kept = [text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[x.rows])
        out = {"doc_id": pa.array(x.ids, mask=x.null), "n_words": pa.array(np.diff(x.rows)), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept]), "doubt": pa.array([_some(notes, "bad_digest").num_rows > 0] * len(kept), pa.bool_())}
        return pa.table(out | ({"text": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))

    by_batch = dealt.groupBy("b")
    asked = by_batch.applyInArrow(ask, "r int, b int, vals binary, twice binary")
    bits = asked.groupBy("r").applyInArrow(answer, NOTE)
    sent = by_batch.cogroup(bits.groupBy("b")).applyInArrow(send, "r int, b int, docs binary, rows binary, pos binary, edges binary")
    notes = sent.groupBy("r").applyInArrow(first_places, NOTE).unionByName(bits)
    claims = by_batch.cogroup(notes.groupBy("b")).applyInArrow(claim, "sb int, srow int, spos int, n int, digest binary, b int")
    failed = by_batch.cogroup(claims.groupBy("sb")).applyInArrow(differ, NOTE)

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, doubt boolean" + ", text string" * with_text
    if (stored / 4) ** 2 < 2.0**62:  # windows squared, where a clash of 64-bit hashes is unlikely: all in one plan
        once = store.written(by_batch.cogroup(notes.unionByName(failed).groupBy("b")).applyInArrow(finish, result), "deduplicated")
        if not once.filter("doubt").limit(1).count():
            return once.drop("doubt")
    notes, failed = store.written(notes, "notes"), store.written(failed, "failed")

    def of(some: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
        return some.join(wanted.select(column).distinct(), column, "left_semi")

    in_doubt = of(dealt, "b", failed).groupBy("b").cogroup(of(notes, "b", failed).unionByName(failed).groupBy("b")).applyInArrow(doubt, "r int, edge long")
    in_doubt = store.written(in_doubt.distinct(), "in-doubt")
    again = store.written(of(sent, "r", in_doubt).groupBy("r").cogroup(in_doubt.groupBy("r")).applyInArrow(holders, NOTE), "holders")
    texts = of(dealt, "b", again).groupBy("b").cogroup(of(notes, "b", again).unionByName(again).groupBy("b")).applyInArrow(spelled, "b int, edge long, words string, own_null boolean, own long")
    texts = store.written(texts, "spelled")
    least = texts.groupBy("words").agg(F.min(F.struct("own_null", "own")).alias("l")).select("words", F.col("l.own_null").alias("least_null"), F.col("l.own").alias("least"))
    exact = store.written(texts.select("b", "edge", "words").join(least, "words"), "settled")
    final = by_batch.cogroup(notes.unionByName(exact, allowMissingColumns=True).groupBy("b"))
    return final.applyInArrow(finish, result).drop("doubt")
