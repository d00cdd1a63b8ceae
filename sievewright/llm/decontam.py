"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment.

Text and items are compared by code points, A-Z lower-cased and white-space runs as one space. An item
of m characters may differ by ``budget(m)`` edits. k edits destroy at most k of its m//Q disjoint q-grams, so
an occurrence holds at least m//Q-k of them on diagonals that drift by at most k: it lies inside
one of the overlapping bands of width 2k. Frequent grams may be left out of the index if the bound
is lowered by their number. Bands that reach the bound are verified by alignment within the band.

The items are a stated query set: each different text is matched once, for all items that have it. The texts reach the driver one after
another and are cut into blocks of at most ``BLOCK_CHARS`` characters (one longer text is a block of its own), each matched against all
documents. A gram's hits are counted in runs of about ``RUN_HITS``, so memory does not grow with the number of items that share it.

Cases: null or empty items and texts match nothing; items too short for the lemma have a smaller
budget (none below Q characters: these are searched exactly); repeated rows of either table give repeated results; a
null doc_id or item_id is reported as null; empty tables give no rows; other columns are ignored by ``contaminated`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bytes import LOWER, SPACE, flat, mix, slices

Q = 8
EDIT_SHARE = 0.1
BLOCK_CHARS = 4_000_000
MAP_BITS = 22
OFTEN = 20
RUN_HITS = 1 << 20
OUTSIDE = 0xFFFFFFFF  # no code point: equal to no character of an item


def budget(m: int, share: float = EDIT_SHARE) -> int:
    return max(0, min(int(share * m), (m - Q) // Q))


def normalised(text: str) -> np.ndarray:
    out, _, _ = _normalise(np.frombuffer(text.encode("utf-32-le"), "<u4"), np.array([0, len(text)]))
    a, b = 0, len(out)
    while a < b and out[a] == 32:
        a += 1
    while b > a and out[b - 1] == 32:
        b -= 1
    return out[a:b]


def _normalise(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with folded spaces, their row bounds and original places."""
    small = np.minimum(points, 255).astype(np.uint8)
    blank = SPACE[small] & (points < 128)
    again = np.zeros(len(points), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[bounds[:-1][bounds[:-1] < len(points)]] = False
    place = np.flatnonzero(~again)
    out = np.where(points < 128, LOWER[small], points)
    out[blank] = 32
    return out[place].astype(np.uint32), np.searchsorted(place, bounds), place


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of the Q=8 code points that start at each place."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    g = points.astype(np.uint64)
    for step, base in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        g = g[:-step] * np.uint64(base) + g[step:]
    return mix(g)


FAR = 1 << 29


def edit_distance(item: np.ndarray, region: np.ndarray, width: int, most: int) -> tuple[int, int, int]:
    """Least edits between the item and a substring of the region, with that substring's bounds.

    Only diagonals 0..width are filled: place t of row i stands for the first i characters of the item
    and an end at i + t in the region, which has len(item) + width characters (padded where the text ends).
    """
    ramp = np.arange(width + 1)
    row, origin = np.zeros(width + 1, np.int64), ramp.copy()
    for i, c in enumerate(item):
        across = row + (region[i : i + width + 1] != c)
        down = np.append(row[1:] + 1, FAR)
        source = np.where(across <= down, origin, np.append(origin[1:], 0))
        level = np.minimum(across, down) - ramp
        lowest = np.minimum.accumulate(level)
        new = np.ones(width + 1, bool)
        new[1:] = level[1:] < lowest[:-1]
        row, origin = lowest + ramp, source[np.maximum.accumulate(np.where(new, ramp, 0))]
        if row.min() > most:
            return most + 1, 0, 0
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), len(item) + end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], share: float = EDIT_SHARE):
        self.items = [(i, p) for i, t in items if len(p := normalised(t or ""))]
        self.long = [(n, p) for n, (_, p) in enumerate(self.items) if len(p) >= Q]
        self.short = [(n, p) for n, (_, p) in enumerate(self.items) if len(p) < Q]
        gram, item, place = [], [], []
        for n, p in self.long:
            at = np.arange(len(p) // Q) * Q
            gram.append(grams(p)[at]), item.append(np.full(len(at), n)), place.append(at)
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((gram, np.uint64), (item, np.int64), (place, np.int64)))
        _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
        often, keep = count[inverse] if len(gram) else count, np.ones(len(gram), bool)
        self.k, self.least = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        for n, p in self.long:
            mine = np.arange(*np.searchsorted(item, [n, n + 1]))
            self.k[n] = budget(len(p), share)
            bound = len(mine) - self.k[n]
            drop = mine[np.argsort(-often[mine], kind="stable")][: int(bound // 3)]
            drop = drop[often[drop] > OFTEN]
            keep[drop] = False
            self.least[n] = bound - len(drop)
        self.reach = max((len(p) + 2 * max(1, int(self.k[n])) for n, p in self.long), default=0)  # all hits of a band lie within
        gram, item, place = gram[keep], item[keep], place[keep]
        order = np.argsort(gram, kind="stable")
        self.post_item, self.post_place = item[order], place[order]
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(gram))
        self.whole: dict[int, np.ndarray] = {}  # all grams of the items that were verified
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[self.gram >> np.uint64(64 - MAP_BITS)] = True

    def match(self, column) -> list[tuple[int, object, int, int, int]]:
        """(row, the item's name, least edits, start, end) for every row and item that match; code points of the original."""
        data, bounds = flat(column)
        if not len(data) or not self.items:
            return []
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        row_start = heads[bounds]
        text, rows, place = _normalise(points, row_start)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def offer(row: int, n: int, edits: int, a: int, b: int) -> None:
            span = (edits, int(place[a] - row_start[row]), int(place[b - 1] + 1 - row_start[row]) if b > a else 0)
            if (row, n) not in best or span < best[row, n]:
                best[row, n] = span

        for n, p in self.short:
            raw, word = text.astype("<u4").tobytes(), p.astype("<u4").tobytes()
            at = raw.find(word)
            while at >= 0:
                if at % 4 == 0:
                    a = at // 4
                    row = int(np.searchsorted(rows, a, "right")) - 1
                    if a + len(p) <= rows[row + 1]:
                        offer(row, n, 0, a, a + len(p))
                at = raw.find(word, at + 1)
        g = grams(text)
        hit = np.flatnonzero(self.map[g >> np.uint64(64 - MAP_BITS)]) if len(g) else np.zeros(0, np.int64)
        if not len(hit) or not len(self.gram):
            return self._out(best)
        nth = np.minimum(np.searchsorted(self.gram, g[hit]), len(self.gram) - 1)
        same = self.gram[nth] == g[hit]
        hit, nth = hit[same], nth[same]
        row = np.searchsorted(rows, hit, "right") - 1
        inside = hit + Q <= rows[row + 1]
        hit, nth, row = hit[inside], nth[inside], row[inside]
        size = self.first[nth + 1] - self.first[nth]
        for run, until in self._runs(hit, size):
            self._verify(text, g, rows, hit[run], nth[run], row[run], size[run], until, best, offer)
        return self._out(best)

    def _runs(self, hit: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, int]]:
        """Runs of hits with about ``RUN_HITS`` postings, each with all hits within reach of those before the place ``until``."""
        total, at = np.cumsum(size), 0
        while at < len(hit):
            end = max(int(np.searchsorted(total, total[at] - size[at] + RUN_HITS, "right")), int(np.searchsorted(hit, hit[at] + self.reach)))
            until = int(hit[end]) if end < len(hit) else int(hit[-1]) + 1
            yield slice(at, int(np.searchsorted(hit, until + self.reach))), until
            at = end

    def _least_edits(self, n: int, region: np.ndarray) -> int:
        """Edits that it takes at least to destroy the item's grams that the region lacks, overlapping ones too; one edit destroys grams at Q places in a row."""
        if n not in self.whole:
            self.whole[n] = grams(self.items[n][1])
        whole, region = self.whole[n], np.sort(region)
        lacks = np.flatnonzero(region[np.searchsorted(region[:-1], whole)] != whole).tolist() if len(region) else list(range(len(whole)))
        edits = at = 0
        while at < len(lacks):
            edits, at = edits + 1, bisect_left(lacks, lacks[at] + Q)
        return edits

    def _verify(self, text: np.ndarray, g: np.ndarray, rows: np.ndarray, hit: np.ndarray, nth: np.ndarray, row: np.ndarray, size: np.ndarray, until: int, best: dict, offer: Callable[..., None]) -> None:
        """Offer what is found in the bands that reach the bound and have a hit before the place ``until``."""
        post = np.repeat(self.first[nth] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        hit, row = np.repeat(hit, size), np.repeat(row, size)
        item = self.post_item[post]
        diagonal = hit - rows[row] - self.post_place[post] + (1 << 40)
        width = np.maximum(self.k[item], 1)
        band = diagonal // width
        pair = row * len(self.items) + item
        order = np.lexsort((band, pair))
        pair, band, hit = pair[order], band[order], hit[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(pair)))
        pair, band, begin = pair[at], band[at], hit[at]
        follows = np.zeros(len(at), np.int64)  # the overlapping band also holds the next cell's grams
        if len(at) > 1:
            next_to = (pair[1:] == pair[:-1]) & (band[1:] == band[:-1] + 1)
            follows[:-1][next_to] = count[1:][next_to]
            begin[:-1][next_to] = np.minimum(begin[:-1], begin[1:])[next_to]
        item = pair % len(self.items)
        for i in np.flatnonzero((count + follows >= self.least[item]) & (begin < until)).tolist():
            n, r = int(item[i]), int(pair[i]) // len(self.items)
            p, k, w = self.items[n][1], int(self.k[n]), max(1, int(self.k[n]))
            if (r, n) in best and best[r, n][0] == 0:
                continue
            a = int(rows[r]) + int(band[i]) * w - (1 << 40) - k  # the text's place on the band's first diagonal
            b = a + len(p) + 2 * w + 2 * k
            left, right = max(int(rows[r]), a), min(int(rows[r + 1]), b)
            region = text[left:right]
            exact = region.tobytes().find(p.tobytes())
            if exact >= 0 and exact % 4 == 0:
                offer(r, n, 0, left + exact // 4, left + exact // 4 + len(p))
            elif k and self._least_edits(n, g[left : max(left, right - Q + 1)]) <= k:
                edits, s, e = edit_distance(p, np.pad(region, (left - a, b - right), constant_values=OUTSIDE), 2 * w + 2 * k, k)
                if edits <= k:
                    offer(r, n, edits, max(left, a + s), min(right, a + e))

    def _out(self, best: dict) -> list[tuple[int, object, int, int, int]]:
        return [(r, self.items[n][0], *span) for (r, n), span in sorted(best.items())]


def _text_key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _blocks(items: DataFrame, text: str, most: int | None = None) -> Iterator[list[tuple[str, str]]]:
    """The different texts of the query set under their keys, in blocks of at most ``most`` characters, partition after partition; one block if it is empty."""
    rows = items.select(_text_key(text).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["k"])
    block, chars, some, most = [], 0, False, most or BLOCK_CHARS
    for r in rows.toLocalIterator():
        if block and chars + len(r.t) + 16 > most:
            yield block
            block, chars = [], 0
        some = True
        block.append((r.k, r.t))
        chars += len(r.t) + 16
    if block or not some:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: its least edits and where."""
    out = None
    for block in _blocks(items, text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in batches:
                for rows in slices(batch):
                    found = matcher.match(rows.column("text"))
                    at, texts, *spans = list(zip(*found, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in spans)], ["doc_id", "k", "edits", "start", "end"])

        part = store.texts(docs).mapInArrow(run, "doc_id long, k string, edits long, start long, end long")
        out = part if out is None else out.unionByName(part)
    named = items.select(_text_key(text).alias("k"), F.col(key).cast("bigint").alias("item_id"))
    return out.join(named, "k").select("doc_id", "item_id", "edits", "start", "end")


def keep_clean(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns; tested in place."""
    out = docs
    for block in _blocks(items, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in batches:
                for rows in slices(batch):
                    keep = np.ones(rows.num_rows, bool)
                    keep[[m[0] for m in matcher.match(rows.column("text"))]] = False
                    yield rows.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
