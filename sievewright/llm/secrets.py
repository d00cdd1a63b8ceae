"""Secret spans: fixed patterns plus a randomness battery under false-discovery control.

Candidates are the parts of 16 or more characters that base spans leave of maximal runs of ``[A-Za-z0-9+/_=-]``. The encoding (letters of one case or of both, hex, base32, base64url, base64, or a mixture)
is inferred from the characters and names the alphabet. Three statistics measure randomness: chi-squared of the alphabet's uniformity, the number of runs (of character classes, or above and below the
alphabet's middle where there is one class), and lag-one serial correlation. What they are in writing and in keys is simulated for each encoding and length: keys are uniform over the alphabet, writing is made of words
with the corpus's own letter pairs, counted over all documents, joined in the ways names are. The statistics depend on each other, so they are weighed by their joint covariance (the linear discriminant of the two) and
the weighed sum is referred to its own distribution in writing, by length; a run that the battery tells from keys, one in a thousand of which it would, has p = 1. Benjamini-Hochberg control runs over all candidates of the corpus within each length stratum, from a histogram of bounded size; a run is a
secret if it is a discovery there.

Cases: null text is empty; empty texts have no spans; a text of any length is read whole, in time linear in it and its spans; repeated rows give repeated results; a null doc_id is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bytes import flat, slices

# The base patterns, in their listed order, and the least length of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more; shorter runs fail whole
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CANDIDATE_LEAST = 16
Q = 0.01  # false-discovery rate
BIN = 0.25  # histogram bins of -log10 p
BINS = 160
_LOW, _UP, _FIGURES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings in the order in which they are tried: what a run of one looks like, and the alphabet; characters outside of it take no part.
ENCODINGS = {
    "lower": (re.compile(r"[a-z+/_=-]+\Z"), _LOW), "upper": (re.compile(r"[A-Z+/_=-]+\Z"), _UP), "letters": (re.compile(r"[A-Za-z+/_=-]+\Z"), _UP + _LOW), "hex": (re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z"), _FIGURES + "abcdef"),
    "base32": (re.compile(r"[A-Z2-7=]+\Z"), _UP + "234567"), "base64url": (re.compile(r"[A-Za-z0-9_=-]+\Z"), _UP + _LOW + _FIGURES + "-_"), "base64": (re.compile(r"[A-Za-z0-9+/=]+\Z"), _UP + _LOW + _FIGURES + "+/"),
    "mixed": (re.compile(r""), _UP + _LOW + _FIGURES + "+/-_"),
}
LENGTHS = (16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256)
DRAWS, DRAW_SEED = 1500, 7
UNLIKE = 16.27  # squared distance from keys (three degrees of freedom) that one key in a thousand has
# Percentages of the letters a to z in English, which stand for as many letter pairs where the corpus is small.
ENGLISH = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
PRIOR_PAIRS = 50_000
# Codes of characters in simulated writing: small letters, capitals, figures, separators.
_CODES = _LOW + _UP + _FIGURES + "_-/"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def encoding(run: str) -> str:
    return next(name for name, (pattern, _) in ENCODINGS.items() if pattern.match(run))


def _table(name: str, source: str) -> np.ndarray:
    """Places in the encoding's alphabet of the characters of ``source``, -1 outside; hex has one case."""
    alphabet = ENCODINGS[name][1]
    return np.array([alphabet.find(c.lower() if name == "hex" else c) for c in source], np.int16)


_PLACES = {name: _table(name, "".join(map(chr, range(128)))) for name in ENCODINGS}
_CLASSES = np.array([0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 for c in range(128)], np.int8)


def statistics(places: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """Three statistics of rows of places in an alphabet (-1: takes no part): logarithm of chi-squared of uniformity by degree of freedom, runs by step, lag-one serial correlation."""
    valid = places >= 0
    n = np.maximum(1, valid.sum(axis=1))
    rows = np.repeat(np.arange(len(places)), places.shape[1])[valid.ravel()]
    counts = np.bincount(rows * size + places[valid], minlength=len(places) * size).reshape(-1, size)
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    if size in (16, 26):  # one class, or two of no meaning: runs above and below the middle
        classes = places >= size // 2
    pairs = valid[:, 1:] & valid[:, :-1]
    runs = ((classes[:, 1:] != classes[:, :-1]) & pairs).sum(axis=1) / np.maximum(1, pairs.sum(axis=1))
    spread = np.where(valid, places - (places * valid).sum(axis=1, keepdims=True) / n[:, None], 0.0)
    power = (spread**2).sum(axis=1)
    serial = np.where(power > 0, (spread[:, 1:] * spread[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1), 1.0)
    return np.stack([np.log(np.maximum(chi, 1) / (size - 1)), runs, serial], axis=1)


def _written(rng: np.random.Generator, pairs: np.ndarray, name: str, n: int) -> np.ndarray:
    """Rows of n character codes of ordinary writing: words by the corpus's letter pairs, in camel case or not, with figures and separators where the encoding has them."""
    alphabet = ENCODINGS[name][1]
    if name == "hex":  # numbers
        return 52 + rng.integers(0, 10, (DRAWS, n))
    share = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    inner = share.copy()
    inner[:, 0] = 0  # names have no words of one or two letters, or few
    cum, inner = np.cumsum(share, axis=1), np.cumsum(inner / inner.sum(axis=1, keepdims=True), axis=1)
    out, last, figures, length = (np.zeros((DRAWS, n) if i == 0 else DRAWS, np.int64) for i in range(4))
    capital = np.full(DRAWS, "A" in alphabet) & ((rng.random(DRAWS) < 0.7) | ("a" not in alphabet))
    numbers = 0.15 if "0" in alphabet else 0.0
    breaks = 0.5 if name in ("lower", "upper", "base64url", "mixed") else 0.0
    for at in range(n):
        new = (np.where((length < 3)[:, None], inner[last], cum[last]) < rng.random(DRAWS)[:, None]).sum(axis=1)
        ends = (new == 0) & (last > 0)
        begin = rng.random(DRAWS)
        figures = np.where(ends & (begin < numbers), rng.integers(1, 5, DRAWS), figures)
        broken = ends & (figures == 0) & (begin < numbers + breaks)
        first = (inner[0] < rng.random(DRAWS)[:, None]).sum(axis=1)
        fresh = (last == 0) | ends
        letter = np.clip(np.where(fresh, np.maximum(first, 1), new) - 1, 0, 25)
        big = np.full(DRAWS, "a" not in alphabet) | (fresh & capital)
        out[:, at] = np.where(figures > 0, 52 + rng.integers(0, 10, DRAWS), np.where(broken, 62 + rng.integers(0, 2, DRAWS), letter + 26 * big))
        last = np.where((figures > 0) | broken, 0, letter + 1)
        length = np.where(last == 0, 0, np.where(fresh, 1, length + 1))
        figures = np.maximum(figures - 1, 0)
    return out


def _prior() -> np.ndarray:
    """Letter pairs of independent letters in words of five."""
    share = np.array([20.0, *ENGLISH]) / (20 + sum(ENGLISH))
    out = np.outer(share, share)
    out[0, 0] = 0
    return out * PRIOR_PAIRS


def references(pairs: np.ndarray) -> dict[tuple[str, int], tuple]:
    """For each encoding and length: the weights of the statistics, mean and deviation of their sum in ordinary writing, and mean and inverse covariance of the statistics of keys."""
    pairs = pairs + _prior()
    rng, out, ascii_ = np.random.default_rng(DRAW_SEED), {}, np.array([ord(c) for c in _CODES])
    for name, (_, alphabet) in ENCODINGS.items():
        letters = np.array([ord(c) for c in alphabet])
        for n in LENGTHS:
            both = []
            for codes in (ascii_[_written(rng, pairs, name, n)], letters[rng.integers(0, len(alphabet), (DRAWS, n))]):
                both.append(statistics(_PLACES[name][codes], _CLASSES[codes], len(alphabet)))
            plain, keys = both
            spread = (np.cov(plain.T) + np.cov(keys.T)) / 2
            weights = np.linalg.pinv(spread) @ (keys.mean(axis=0) - plain.mean(axis=0))
            told = plain @ weights
            mean = float(told.mean())
            out[name, n] = weights, mean, max(float(told.std()), (float(np.quantile(told, 0.995)) - mean) / 2.576, 1e-9), keys.mean(axis=0), np.linalg.pinv(np.cov(keys.T))  # never a lighter tail than it has
    return out


def p_value(run: str, known: dict) -> float:
    """Probability that ordinary writing of this encoding and length looks as random as the run does."""
    s = run.rstrip("=")
    n = len(s)
    if n < CANDIDATE_LEAST:
        return 1.0
    name = encoding(run)
    near = max(m for m in LENGTHS if m <= n)
    codes = np.frombuffer(s.encode(), np.uint8)[None, :]
    places = _PLACES[name][codes]
    if (places >= 0).sum() < CANDIDATE_LEAST // 2:
        return 1.0
    weights, mean, deviation, keys, inverse = known[name, near]
    own = statistics(places, _CLASSES[codes], len(ENCODINGS[name][1]))[0]
    if (own - keys) @ inverse @ (own - keys) * n / near > UNLIKE:
        return 1.0
    z = (float(own @ weights) - mean) / (deviation * math.sqrt(near / n))
    return min(1.0, max(1e-40, 0.5 * math.erfc(z / math.sqrt(2))))


def candidates(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Parts of the runs that base spans (sorted) leave, if long enough; both lists are walked once."""
    covered: list[list[int]] = []
    for s, e, _ in spans:  # spans of different kinds may overlap
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        while at < len(covered) and covered[at][0] < b:
            if covered[at][0] - a >= CANDIDATE_LEAST:
                yield a, covered[at][0]
            a = covered[at][1]
            if a >= b:
                break
            at += 1
        if b - a >= CANDIDATE_LEAST:
            yield a, b


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """How often each letter follows each in words of all documents, 27 by 27: 0 stands for no letter, case does not count.

    Words long enough to be candidates are left out: they are what is judged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(256, np.int64)
        place[97:123] = place[65:91] = np.arange(1, 27)
        sums = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for rows in slices(batch):
                data, bounds = flat(rows.column("text"))
                codes = place[data]
                ends = np.flatnonzero(np.diff((codes > 0).astype(np.int8), prepend=0, append=0))  # starts and ends of words in turn
                long = ends[1::2] - ends[::2] >= CANDIDATE_LEAST
                if long.any():
                    codes[_spans(ends[::2][long], ends[1::2][long])] = 0
                if len(codes) > 1:
                    both = codes[:-1] * 27 + codes[1:]
                    both[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(codes))] - 1] = 0  # no pair over two texts
                    sums += np.bincount(both, minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27)), pa.array(sums)], ["pair", "n"])

    counted = store.texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 729 rows
    out = np.zeros(27 * 27)
    for r in counted:
        out[r.pair] = r.n
    out[0] = 0
    return out.reshape(27, 27)


def stratum(n: int) -> int:
    """Length strata: 16-19, 20-23, 24-31, 32-47, 48-63, 64-127, ... in powers of two from there."""
    for i, end in enumerate((20, 24, 32, 48, 64)):
        if n < end:
            return i
    return min(12, n.bit_length() - 2)


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log10(p) / BIN))


def found(docs: DataFrame, known: dict) -> DataFrame:
    """Per row: base spans, and candidates (start, end, stratum, bin of -log10 p); ``known`` are ``references``."""
    wants = {"assign": "password|passwd|secret|token|api_?key", "access": "AKIA[A-Z0-9]", "hex": "[0-9a-f]{24}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                column = rows.column("text")
                hit = np.zeros(rows.num_rows, bool)
                for name, pattern in wants.items():
                    hit |= pc.match_substring_regex(column, pattern, ignore_case=name == "assign").to_numpy(zero_copy_only=False)
                maybe = hit | pc.match_substring_regex(column, "[A-Za-z0-9+/_=-]{16}").to_numpy(zero_copy_only=False)
                out = []
                for i in range(rows.num_rows):
                    spans, tried = [], []
                    if maybe[i]:
                        text = column[i].as_py()
                        spans = sorted(base_spans(text) if hit[i] else [], key=lambda s: (s[0], KINDS.index(s[2])))
                        for a, b in candidates(text, spans):
                            tried.append({"start": a, "end": b, "stratum": stratum(b - a), "bin": _bin(p_value(text[a:b], known))})
                    out.append((len([1 for s in spans if s[2] == "assign"]), len([1 for s in spans if s[2] == "access"]), len([1 for s in spans if s[2] == "hex"]), [{"start": a, "end": b, "kind": k} for a, b, k in spans], tried))
                span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
                tried_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                shas = [hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x).encode()).hexdigest() for x in columns[3]]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(shas, pa.string()), pa.array(columns[3], span_type), pa.array(columns[4], tried_type)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tried"])

    return store.texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,end:int,kind:string>>, tried array<struct<start:int,end:int,stratum:int,bin:int>>")


def thresholds(counts: list[tuple[int, int, int]], q: float = Q) -> dict[int, int]:
    """Benjamini-Hochberg per stratum from (stratum, bin, count): the least bin that counts as a discovery."""
    out = {}
    for s in {c[0] for c in counts}:
        bins = {b: n for t, b, n in counts if t == s}
        total, seen, least = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b * BIN) <= q * seen / total:  # the bin's largest p against its rank
                least = b
        if least is not None:
            out[s] = least
    return out


def secret_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """One row per document: base counts and digest, and all spans as ``kind:start:end``."""
    once = store.written(found(docs, references(letter_pairs(docs))), "secrets")
    tried = once.select(F.explode("tried").alias("t")).groupBy("t.stratum", "t.bin").count()
    least = thresholds([tuple(r) for r in tried.collect()], q)  # at most 13 strata times BINS rows
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<int,int>")
    picked = F.filter("tried", lambda t: F.coalesce(t["bin"] >= F.element_at(limit, t["stratum"]), F.lit(False)))
    extra = F.transform(picked, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    order = F.array_sort(F.transform(F.concat("base", extra), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"))))
    named = F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return once.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(named, ",").alias("spans"), F.size(picked).cast("long").alias("n_random"))
