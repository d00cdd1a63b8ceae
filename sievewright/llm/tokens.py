"""Byte-level BPE ids of whole texts, computed batch-wise with the tokenizers library.

Byte-level pre-tokens of this vocabulary never hold a space between two non-space characters
except as their first character, so a text may be cut before each such space without changing
its ids. Every distinct piece of a batch is encoded once and its ids are gathered for all places.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa

from sievewright.llm.bytes import SPACE, flat

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
CACHE_PIECES = 600_000
JOINED_PIECES = 4096
TOKEN_SLICE_BYTES = 8 << 20
_loaded: dict[str, "Encoder"] = {}


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)
        self.known: dict[bytes, int] = {}  # piece -> slot
        self.ids = np.zeros(0, np.uint32)  # ids of all slots, one after another
        self.first = np.zeros(1, np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their bounds of pieces that may be encoded as one text; None if a cut fell inside a token."""
        data, bounds = flat(pieces)
        raw, out, ends = data.tobytes(), [], bounds[1:]
        for i in range(0, len(ends), JOINED_PIECES):
            part = raw[bounds[i] : ends[min(i + JOINED_PIECES, len(ends)) - 1]]
            out.append(np.array(self.tokenizer.encode_batch_fast([part.decode()], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(out)
        reached = np.cumsum(self.lengths[ids])
        last = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or not np.array_equal(reached[last], ends):
            return None
        return ids, np.concatenate([[0], last + 1])

    def _single(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces.to_pylist()], add_special_tokens=False)]
        sizes = [len(f) for f in found]
        return np.fromiter((i for f in found for i in f), np.uint32, sum(sizes)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first, last) of distinct pieces; the first ``CACHE_PIECES`` short ones stay known to this worker."""
        names = pieces.to_pylist()
        slot = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        if not len(new):
            return self.ids, self.first[slot], self.first[slot + 1]
        fresh = pieces.take(pa.array(new))
        data, bounds = flat(fresh)
        size = np.diff(bounds)
        simple = (size > 1) & (data[bounds[:-1]] == 32) & ~SPACE[data[np.minimum(bounds[:-1] + 1, len(data) - 1)]] & ~SPACE[data[bounds[1:] - 1]]
        # pieces encoded as one text first, then the rest one by one
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        both = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for picked, ways in ((np.flatnonzero(simple), (self._joined, self._single)), (np.flatnonzero(~simple), (self._single,))):
            if len(picked):
                part = fresh.take(pa.array(picked))
                ids, cut = next(x for x in (way(part) for way in ways) if x is not None)
                both[0].append(ids), both[1].append(cut[1:] + both[1][-1][-1])
        ids, cut = np.concatenate(both[0]), np.concatenate(both[1])
        slot[new[order]] = len(self.first) - 1 + np.arange(len(new))
        all_ids, all_first = np.concatenate([self.ids, ids]), np.concatenate([self.first, cut[1:] + self.first[-1]])
        room = CACHE_PIECES - len(self.known)
        if room > 0:
            kept = new[order][:room]
            self.known.update(zip([names[i] for i in kept.tolist()], slot[kept].tolist(), strict=True))
            self.first = all_first[: len(self.first) + len(kept)]
            self.ids = all_ids[: self.first[-1]]
        return all_ids, all_first[slot], all_first[slot + 1]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a string column, one after another, and the n+1 row bounds."""
        data, bounds = flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        at = np.flatnonzero(data == 32)
        at = at[(at > 0) & (at < len(data) - 1)]
        at = at[~SPACE[data[at - 1]] & ~SPACE[data[at + 1]] & ~self._wide_space(data, at)]
        cut = np.sort(np.concatenate([at, bounds]), kind="stable")
        cut = cut[np.concatenate([[True], cut[1:] != cut[:-1]])]
        pieces = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids, first, last = self._distinct(pieces.dictionary)
        index = pieces.indices.to_numpy()
        size = (last - first)[index]
        ends = np.cumsum(size)
        rows = np.concatenate([[0], ends])[np.searchsorted(cut, bounds)]
        gather = np.repeat((first[index] - (ends - size)).astype(np.int32), size)
        gather += np.arange(ends[-1], dtype=np.int32)
        return ids[gather], rows

    @staticmethod
    def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Spaces next to a possible non-ASCII white space (lead bytes C2, E1, E2, E3): not cut there."""
        after, third = data[at + 1], data[np.maximum(at - 3, 0)]
        lead = np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
        return lead | np.isin(third, (0xE1, 0xE2, 0xE3)) | np.isin(data[np.maximum(at - 2, 0)], (0xC2,)) | (data[at - 1] < 0x20) | ((data[at + 1]) < 0x20)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
