"""Every operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievewright.llm import bitpack, decontam, exact, licences, packing, quality, secrets, shards, simhash, store, substrings
from sievewright.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b int, r string, key string, fp string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "a b c d e f g h i j k l m n o p q r s t u"),
    (7, "x a b c d e f g h i j k l m y a b c d e f g h i j k l m"), (8, "a b c d e f g h i j k l m n o p q r s t u"), (8, "a b c d e f g h i j k l m n o p q r s t u"),
    (None, "a b c d e f g h i j k l m n o p q r s t u"), (10, "漢字 emoji 😀 naïve 　 wide"), (11, "same word " * 5000), (12, "z" * 30000), (13, "same word " * 5000),
    (14, "All rights reserved " + "a." * 50000 + " end"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, None, None, 7, "r", "k", "f", "l") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# substring deduplication


def removed(rows):
    first, out = {}, []
    big = 1 << 70
    said = [(big if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in said:
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, big), i)
    for (doc, _), (i, w) in zip(rows, said, strict=True):
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                keep[j : j + 13] = [False] * 13
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substrings(docs, rows, awkward, empty):
    assert Counter(tuple(r) for r in substrings.substring_dedup(docs).collect()) == removed(rows)
    assert Counter(tuple(r) for r in substrings.substring_dedup(awkward).collect()) == removed(AWKWARD)
    assert substrings.substring_dedup(empty).count() == 0
    kept = substrings.substring_dedup(docs.limit(50), with_text=True).collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in kept)


@pytest.mark.parametrize("edge_bits", [4, 9, 14])
def test_substring_hash_collisions_lose_nothing(docs, rows, awkward, edge_bits):
    """With window hashes of a few bits most spans fail their verification; every word is still judged by the words themselves."""
    few = docs.filter("doc_id % 4 = 0 AND length(text) < 6000")
    given = [(i, t) for i, t in rows if i % 4 == 0 and len(t or "") < 6000]
    assert Counter(tuple(r) for r in substrings.substring_dedup(few, edge_bits=edge_bits).collect()) == removed(given)
    assert Counter(tuple(r) for r in substrings.substring_dedup(awkward, edge_bits=edge_bits).collect()) == removed(AWKWARD)


def test_substring_largest_and_repeated_ids(spark):
    w, top = "a b c d e f g h i j k l m n", (1 << 63) - 1
    given = [(top, w + " x"), (None, w + " y"), (None, w + " z"), (top, "q " + w)] + [(None, f"{n} {w} {n}") for n in range(50)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    assert Counter(tuple(r) for r in substrings.substring_dedup(frame).collect()) == removed(given)
    only = [r for r in given if r[0] is None]
    assert Counter(tuple(r) for r in substrings.substring_dedup(frame.filter("doc_id IS NULL")).collect()) == removed(only)


# tokens, packed files, packing


FRESH = Tokenizer.from_file(tokenizer_path())


def ids_of(text, end):
    return FRESH.encode(text or "", add_special_tokens=False).ids + [end]


def test_tokens_equal_the_library():
    random.seed(3)
    alphabet = " \n\t  aB'sé 　\u0085\x1c\x0b12!?漢😀"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["", " ", "<|endoftext|>"]
    e = encoder(tokenizer_path())
    ids, bounds = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5001, dtype=np.uint32)
    raw = bitpack.pack(ids, bits)
    assert len(raw) == (5001 * bits + 7) // 8 and np.array_equal(bitpack.unpack(raw, 5001, bits), ids)
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << min(bits, 31)], np.uint32) if bits < 32 else np.array([0], np.uint32), min(bits, 31) if bits < 32 else -1)


def test_packed_reader_random_access(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = bitpack.Writer(f, 17, block=64)
        ids = np.random.default_rng(0).integers(0, 1 << 17, 1000, dtype=np.uint32)
        w.add(np.array([5, 6]), ids[:300], np.array([0, 100, 300]))
        w.add(np.array([7]), ids[300:], np.array([0, 700]))
        w.close()
    r = bitpack.Reader((tmp_path / "x").read_bytes())
    assert r.docs().tolist() == [[5, 1, 0, 100], [6, 1, 100, 200], [7, 1, 300, 700]] and r.docs(1, 1).tolist() == [[6, 1, 100, 200]]
    for a, n in ((0, 1000), (63, 2), (64, 64), (999, 1), (500, 0), (130, 333)):
        assert np.array_equal(r.ids(a, n), ids[a : a + n])


def packed_rows(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # rows of one doc_id here are equal
        ids = np.array(ids_of(t, 2), "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_packed_files(spark, docs, rows, awkward, empty):
    special = [(-1, "<|endoftext|>"), (None, "a <|endoftext|> b"), (2, "end<|endoftext|>begin"), (-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    for frame, given in ((docs, rows), (awkward, AWKWARD), (spark.createDataFrame(special, "doc_id long, text string"), special)):
        got = sorted(map(tuple, bitpack.packed_round_trip(frame).collect()), key=lambda r: r[1])
        assert got == packed_rows(given)
    assert bitpack.packed_round_trip(empty).count() == 0


def check_packing(got, rows, capacity):
    want = Counter()
    for i, t in rows:
        ids = np.array(ids_of(t, 0), "<u4")
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(n for parts in bins.values() for _, n in parts) // capacity)


def test_packing(spark, docs, rows, awkward, empty):
    used, least = check_packing(packing.pack_sequences(docs).collect(), rows, 2048)
    assert used == len(plain_best_fit([n for r in packing.pieces(docs, 2048).collect() for n in [r.length]], 2048)) and used <= least * 1.05 + 1
    special = [(-1, "<|endoftext|>"), (None, "a <|endoftext|> b"), (2, "end<|endoftext|>begin")] + AWKWARD
    frame = spark.createDataFrame(special, "doc_id long, text string")
    check_packing(packing.pack_sequences(frame, capacity=64).collect(), special, 64)
    assert packing.pack_sequences(awkward).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    without_id = [(None, f"{n} words here") for n in range(300)]
    check_packing(packing.pack_sequences(spark.createDataFrame(without_id, "doc_id long, text string")).collect(), without_id, 2048)
    assert packing.pack_sequences(empty).count() == 0


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("capacity, n", [(100, 400), (7, 300), (1000, 200)])
def test_best_fit_matches_plain_search(capacity, n):
    lengths = np.random.default_rng(5).integers(1, capacity + 1, n).tolist()
    counts, used = Counter(lengths), defaultdict(set)
    runs = sorted(packing.best_fit(counts, capacity))
    for length, count in counts.items():
        for i in range(count):
            _, done, first, each, offset = [r for r in runs if r[0] == length and r[1] <= i][-1]
            at = offset + (i - done) % each * length
            places = set(range(at, at + length))
            assert not places & used[first + (i - done) // each] and max(places) < capacity
            used[first + (i - done) // each] |= places
    assert sorted(capacity - len(v) for v in used.values()) == sorted(plain_best_fit(lengths, capacity))


# exact duplicates


def test_exact(docs, rows, awkward, empty):
    for frame, given in ((docs, rows), (awkward, AWKWARD)):
        groups = defaultdict(list)
        for i, t in given:
            groups[t or ""].append(i)
        want = Counter()
        for i, t in given:
            ids = [x for x in groups[t or ""] if x is not None]
            keep = max(ids) if ids else None
            want[i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, exact.exact_duplicates(frame).collect())) == want
    assert exact.exact_duplicates(empty).count() == 0
    assert exact.keep_one_copy(empty).count() == 0
    left = exact.keep_one_copy(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted({t or "" for _, t in AWKWARD})


def test_chunks_join_to_the_text_and_are_content_defined(spark):
    random.seed(1)
    body = " ".join("".join(random.choice("abcdef") for _ in range(6)) + random.choice(["", "", "."]) for _ in range(4000))
    frame = spark.createDataFrame([(body,), ("A different first line.\n" + body,), ("q" * 10000,)], "t string")
    got = [r[0] for r in frame.select(exact.chunks(F.col("t"))).collect()]
    assert ["".join(c) for c in got] == [r.t for r in frame.collect()]
    assert len(set(got[0]) & set(got[1])) > 0 or len(got[0]) < 3
    assert max(len(c) for chunks in got for c in chunks) <= exact.CHUNK_MAX


CLASHING = "doc_id long, text string, k string, sha string, kept boolean, place int, _key string, fp string, root string, n int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "k", "sha", False, 9, f"mine {n % 2}", "fp", "root", 5) for n, (i, t) in enumerate(rows)], CLASHING)


def test_exact_keeps_whole_rows(spark):
    given = AWKWARD + [(8, AWKWARD[7][1]), (11, AWKWARD[11][1]), (None, "only here"), (None, "only here"), (20, "x"), (20, "y")]
    got = exact.keep_one_copy(clashing(spark, given)).collect()
    ids = {}
    for i, t in given:
        ids[t or ""] = max(ids.get(t or "", -1), -1 if i is None else i)
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter((None if i < 0 else i, t) for t, i in ids.items())
    assert all((r.k, r.sha, r.kept, r.place, r.fp, r.root, r.n) == ("k", "sha", False, 9, "fp", "root", 5) for r in got)
    assert {r._key for r in got if r.text == AWKWARD[7][1]} == {"mine 0" if any(n % 2 == 0 for n, (i, t) in enumerate(given) if (i, t) == (8, AWKWARD[7][1])) else "mine 1"}


@pytest.mark.parametrize("most", [1000, 3])
def test_clashing_chunk_identifiers_are_told_apart(spark, docs, rows, monkeypatch, most):
    monkeypatch.setattr(exact, "identifier", lambda c: F.pmod(F.xxhash64(c), F.lit(16)))
    monkeypatch.setattr(exact, "CLASH_LIST", most)
    groups = Counter(t or "" for _, t in rows)
    assert {r.doc_id: r.group_size for r in exact.exact_duplicates(docs).collect()} == {i: groups[t or ""] for i, t in rows}


def test_chunks_fall_in_step_again_after_an_insertion(spark):
    rng = random.Random(2)
    base64, han = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60000))
    for body in (base64, han, " ".join(base64[i : i + 7] for i in range(0, 60000, 7))):
        a, b = (r[0] for r in spark.createDataFrame([(body,), ("+" + body,)], "t string").select(exact.chunks(F.col("t"))).collect())
        assert "".join(a) == body and len(set(a) & set(b)) > 0.8 * len(a)


# quality


def test_quality(spark, awkward, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    said = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = [(said[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(s.held_out for s, _ in truth)
    assert sum(s.predicted == q for s, q in truth) / len(truth) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in said.items())
    scored = quality.score(awkward, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert quality.score(empty, model).count() == 0
    assert {r.score for r in quality.score(awkward, quality.fit(awkward, labels.limit(0))).collect()} == {0.5}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped).slopes == pytest.approx(model.slopes)  # held-out labels are never seen
    assert quality.keep_good(awkward, labels).columns == awkward.columns
    doubled = quality.fit(docs.unionByName(docs), labels)  # repeated rows are learned once
    assert (doubled.good, doubled.bad) == (model.good, model.bad) and doubled.slopes == pytest.approx(model.slopes)


def test_quality_windows(spark):
    texts = {1: "é" * 300 + "x" * 700, 2: "", 3: "short"}
    rows = spark.createDataFrame([(v % 2, v, t) for v, t in texts.items()], "label int, h long, text string")
    raw = texts[1].encode()
    assert quality._windows(rows, 1, 99) == [raw[:512], raw[512:1024], raw[1024:], b"short"]
    assert quality._windows(rows, 0, 99) == []
    two = quality._windows(rows, 1, 2)
    assert len(two) == 2 and set(two) < set(quality._windows(rows, 1, 99))


# licences


def test_licences(spark, docs, rows, awkward, empty):
    made = [(n * 100 + m, t, f) for n, (f, ts) in enumerate(licences.TEMPLATES.items()) for m, t in enumerate(ts)]
    frame = spark.createDataFrame([(i, f"Some first line.\n{t}\nand a last one") for i, t, _ in made] + [(-n - 1, t) for n, t in enumerate(licences.ORDINARY)] + [(-100, "The fishing licence of Mr Miller was renewed."), (-101, "Copyright lawyers met at the warranty conference.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licence_scan(frame).collect()}
    right = sum(got[i].families == f for i, _, f in made)
    assert right >= 0.9 * len(made)
    assert all(not r.n_licence for i, r in got.items() if i < 0)
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    scanned = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    for i, t in rows:
        want = sorted({f for line in t.split("\n") for s, f in lines.items() if line == s})
        assert set(want) <= set(scanned[i].families.split(",")) | {""}, i
    assert licences.licence_scan(awkward).count() == len(AWKWARD) and licences.licence_scan(empty).count() == 0


def test_every_template_has_an_anchor():
    for ts in licences.TEMPLATES.values():
        for t in ts:
            assert any(a in t.lower() for a in licences.ANCHORS) or len(t) < 90, t


def test_licence_names_without_an_anchor_are_found(spark):
    named = {"Available under CC BY-SA 4.0.": "cc-by-sa", "This file is GPLv3": "gpl", "MPL 2.0": "mpl", "Code: BSD-3-Clause": "bsd", "Terms: Apache-2.0": "apache-2.0", "CC0 1.0": "public-domain"}
    other = {"Terms: CC BY-ND 4.0": 1, "Mit der Zeit kam der Mann in die Stadt.": 0, "She walked in the park of the city.": 0}
    lines = [*named, *other]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert {t: (got[i].families, got[i].n_unknown) for i, t in enumerate(lines)} == {t: (f, 0) for t, f in named.items()} | {t: ("", n) for t, n in other.items()}


def test_wrapped_notices_are_read_as_one_paragraph(spark):
    """Texts in forms the classifier was not trained on: wrapped, behind comment marks, with other words around."""
    gpl = "# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    isc = "// Permission to use, copy, modify, and distribute this software for any purpose\n// with or without fee is hereby granted, provided that the above copyright\n// notice and this permission notice appear in all copies."
    epl = "All of this is made available under the terms of the Eclipse Public License v2.0"
    prose = "The old man walked along the river until the evening came and the lights\nof the town shone over the water\nShort line\nEnd."
    frame = spark.createDataFrame(list(enumerate((gpl, mit, isc, epl, prose, "# GPL v3\nint main() {}"))), "doc_id long, text string")
    assert [r.families for r in sorted(licences.licence_scan(frame).collect())] == ["gpl", "mit", "isc", "epl", "", "gpl"]
    assert licences.paragraphs(frame).filter("doc_id = 4").count() == 3


def test_licence_threshold_is_fitted_on_held_out_rows(spark):
    found = [("gpl", "gpl", 0.9, True), ("gpl", "gpl", 0.8, True), ("lgpl", "gpl", 0.7, True), ("mit", "mit", 0.6, True), ("mit", "bsd", 0.95, False), ("mit", "none", 0.99, True)]
    assert licences.threshold(found, 0) == 0.8 and licences.threshold(found, 0.25) == 0.6 and licences.threshold([("mit", "bsd", 0.9, True)]) == 1.0
    held = licences.held_out(licences._training(spark))
    least = licences.threshold(held)
    accepted = [f == best for f, best, p, sure in held if sure and best != "none" and p >= least]
    assert len(accepted) >= 20 and accepted.count(False) <= licences.WRONG * len(accepted)
    assert sum(best == "none" for f, best, *_ in held if f == "none") >= 0.95 * sum(f == "none" for f, *_ in held)


# secrets


def base_by_hand(text):
    out = []
    for m in re.finditer(secrets.ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(secrets.ACCESS, text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(secrets.HEX, text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secrets(spark, docs, rows, awkward, empty):
    tricky = [(1, "password = \"hunter22\" token: token: abcdefgh ſecret=abcdefgh"), (2, "AKIA" + "A1B2" * 5 + " é " + "0123456789abcdef" * 3), (3, "api_key='x' apikey: abc+/=_.-1"), (4, "q7Xb2LkP9vTz4WmR8sYd1HnC6fGj3KtB"), (5, "TOKEN=" + "deadbeef" * 4)]
    for frame, given in ((docs, rows), (awkward, AWKWARD), (spark.createDataFrame(tricky, "doc_id long, text string"), tricky)):
        got = sorted(secrets.secret_spans(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        for r, (i, t) in zip(got, sorted(given, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
            want = base_by_hand(t or "")
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(filter(None, r.spans.split(",")))
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
            starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
            assert starts == sorted(starts)
    assert secrets.secret_spans(empty).count() == 0


@pytest.fixture(scope="module")
def known(docs):
    return secrets.references(secrets.letter_pairs(docs))


def test_letter_pairs_of_all_texts(spark, docs, rows):
    want = np.zeros((27, 27))
    for _, t in [*rows, (0, "abc" * 5 + "d " + "x" * 15)]:
        t = re.sub("[A-Za-z]{16,}", lambda m: " " * len(m[0]), t or "")
        codes = [ord(c) - 96 if "a" <= c <= "z" else ord(c) - 64 if "A" <= c <= "Z" else 0 for c in (t or "").encode().decode("latin-1")]
        for pair in zip(codes, codes[1:]):
            want[pair] += 1
    want[0, 0] = 0
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(0, "abc" * 5 + "d " + "x" * 15)], "doc_id long, text string"))
    assert (secrets.letter_pairs(more.repartition(3)) == want).all() and want[24, 24] >= 14
    assert secrets.letter_pairs(docs.limit(0)).sum() == 0


def test_random_runs_are_told_from_writing(known):
    rng = random.Random(9)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(200)]
    writing = ["version2-of-the-internal-documentation", "chapter-10-the-history-of-the-war-in-europe", "aaaaaaaaaaaaaaaaaaaa1111111111111111", "abcdefghijklmnopqrstuvwxyz", "-" * 40, "getUserAccountByIdentifier", "0" * 30]
    assert np.median([secrets.p_value(k, known) for k in keys]) < 1e-4
    assert all(secrets.p_value(w, known) > 1e-3 for w in writing)
    assert secrets.thresholds([(3, 40, 10), (3, 0, 990)]) == {3: 40} and secrets.thresholds([(1, 0, 5)]) == {}


def judged_by_hand(given, known, q=secrets.Q):
    """Random spans of every text: what base spans leave of the runs, by plain search, under Benjamini-Hochberg in each stratum."""
    tried = defaultdict(list)
    for i, t in given:
        taken = set()
        for span in base_by_hand(t or ""):
            _, a, b = span.split(":")
            taken |= set(range(int(a), int(b)))
        free = "".join(" " if at in taken else c for at, c in enumerate(t or ""))
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", free):
            b = secrets._bin(secrets.p_value(m[0], known))
            tried[secrets.stratum(len(m[0]))].append((b, (i, f"random:{m.start()}:{m.end()}")))
    out = set()
    for some in tried.values():
        for least in sorted({b for b, _ in some}, reverse=True):
            if 10 ** (-least * secrets.BIN) <= q * sum(b >= least for b, _ in some) / len(some):
                out |= {x for b, x in some if b >= least}
    return out


def test_random_spans_against_brute_force(spark, rows):
    """Keys planted in real texts, also right beside base spans: the same spans as by plain search, most of the keys, and little else."""
    rng = random.Random(12)
    kinds = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    given, keys = list(rows), {}
    for n in range(60):
        i, text = given[n]
        key = "".join(rng.choice(kinds[n % 4]) for _ in range(48))
        beside = "0123456789abcdef" * 2 if n % 3 == 0 and n % 4 != 1 else ""  # a base span of hex figures ends the run
        words = (text or "").split(" ")
        at = rng.randrange(len(words) + 1)
        words[at:at] = [key + beside]
        given[n] = (i, " ".join(words))
        keys[i] = key
    frame = spark.createDataFrame(given, "doc_id long, text string")
    got = {(r.doc_id, s) for r in secrets.secret_spans(frame).collect() for s in r.spans.split(",") if s.startswith("random")}
    assert got == judged_by_hand(given, secrets.references(secrets.letter_pairs(frame)))
    texts = dict(given)
    said = {(i, texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for i, s in got}
    right = sum(any(i == j and (k in t or t in k) for j, t in said) for i, k in keys.items())
    assert right >= 54 and len(said) - right <= 2  # 90 % of the keys; two in 56 or so would be a rate of 3 %


def test_text_beside_base_spans_is_judged():
    hexed, key = "deadbeef" * 4, "Zq9Xv" * 6
    text = f"{key}{hexed}{key} AKIA{'A1' * 10}/{key}"
    spans = sorted(secrets.base_spans(text))
    got = [text[a:b] for a, b in secrets.candidates(text, spans)]
    assert got == [key, key, "/" + key] and list(secrets.candidates("", [])) == []
    nested = [(0, 40, "assign"), (5, 10, "hex")]
    assert list(secrets.candidates("x" * 60, nested)) == [(40, 60)] and list(secrets.candidates("x" * 60, [(20, 30, "hex"), (55, 60, "hex")])) == [(0, 20), (30, 55)]


def test_a_hundred_thousand_spans_in_one_text():
    import time

    text = " ".join("AKIA" + "B" * 20 + "/qwertyuiopasdfghjk" for _ in range(100_000))
    began = time.time()
    assert sum(1 for _ in secrets.candidates(text, sorted(secrets.base_spans(text)))) == 100_000
    assert time.time() - began < 10


# near duplicates


def prints(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_hand(rows):
    fps = [prints(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash(docs, rows, awkward, empty):
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == by_hand(rows)
    assert Counter(map(tuple, simhash.near_duplicates(awkward).collect())) == by_hand(AWKWARD)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_of_each(awkward).columns == awkward.columns and simhash.keep_one_of_each(empty).count() == 0


def true_links(rows, size=5, similarity=0.8):
    """All pairs of rows whose sets of lower-cased five-word shingles are as similar as asked (texts without words are alike)."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    holds, out = defaultdict(list), []
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holds[s])
        out += [(i, j) for j, n in shared.items() if n / (len(own) + len(sets[j]) - n) >= similarity]
        out += [(i, j) for j in holds[None] if not own and not sets[j]]
        for s in own or (None,):
            holds[s].append(i)
    return out


def wide_groups(rows, shingle=5, similarity=0.8):
    """Groups of rows joined by true links."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in true_links(rows, shingle, similarity):
        parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def kept_rows(rows):
    best = {}
    for (i, t), g in zip(rows, wide_groups(rows), strict=True):
        key = (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        best[g] = min(best.get(g, (key, i, t)), (key, i, t), key=lambda x: x[0])
    return Counter((i, t or "") for _, i, t in best.values())


def test_one_of_each_group_stays(spark, docs, rows, monkeypatch):
    assert Counter((r.doc_id, r.text or "") for r in simhash.keep_one_of_each(docs).collect()) == kept_rows(rows)
    long = " ".join(f"w{n * n % 997}" for n in range(400))
    given = AWKWARD + [(3, long), (8, "quite another text"), (8, long + " more"), (None, long + " end"), (None, "alone"), (None, "alone"), (50, long)]
    got = simhash.keep_one_of_each(clashing(spark, given)).collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == kept_rows(given)
    assert (3, long) in {(r.doc_id, r.text) for r in got} and sum((r.text or "").startswith(long) for r in got) == 1
    assert all((r.k, r.sha, r.kept, r.place, r.fp, r.root, r.n) == ("k", "sha", False, 9, "fp", "root", 5) for r in got)


def edited(rng, words, n):
    """The words with n of them changed, apart from each other."""
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_recall_at_the_asked_similarity(spark):
    """600 pairs around 0.8: every link is right, and at least 95 % of the pairs at 0.80-0.85 are found (all of those above, but for chance)."""
    rng, rows = np.random.default_rng(11), []
    for n in range(600):
        words = [f"p{n}w{i}" for i in range(300)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, edited(rng, words, int(rng.integers(3, 9))))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: bytes(r.root) for r in simhash.similar_documents(frame).collect()}
    true = {(min(i, j) // 2) for i, j in true_links(rows)}
    found = {n for n in range(600) if root[2 * n] == root[2 * n + 1]}
    assert found <= true and len(set(root.values())) == 1200 - len(found)  # no link that is not there
    near = {n for n in true if not true_links(rows[2 * n : 2 * n + 2], similarity=0.85)}
    assert len(near) > 100 and len(found & near) >= 0.95 * len(near) and len(found - near) >= 0.99 * len(true - near)


def test_whole_table_against_true_links(spark):
    """All of a larger table, by groups of true links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    root = {r.doc_id: bytes(r.root) for r in simhash.similar_documents(docs).collect()}
    links = true_links(rows)
    lost = [(rows[i][0], rows[j][0]) for i, j in links if root[rows[i][0]] != root[rows[j][0]]]
    assert len(links) > 50 and len(lost) <= 0.01 * len(links)
    assert len(set(root.values())) >= len(set(wide_groups(rows)))


def test_long_lists_and_groups_in_parts(spark, monkeypatch):
    """Lists and groups far above the bound of a part, with members unlike the first one, give the same groups."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, words, 1 + i % 2)) for i in range(60)]  # one large group
    shared = [f"s{i}" for i in range(100)]
    rows += [(100 + i, " ".join(shared + [f"own{i // 3}x{j}" for j in range(60)] + [f"e{i}"])) for i in range(60)]  # many groups of three around one passage
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def groups():
        out = defaultdict(set)
        for r in simhash.similar_documents(frame).collect():
            out[bytes(r.root)].add(r.doc_id)
        return sorted(map(sorted, out.values()))

    want = defaultdict(set)
    for (i, _), g in zip(rows, wide_groups(rows), strict=True):
        want[g].add(i)
    assert groups() == sorted(map(sorted, want.values()))
    monkeypatch.setattr(simhash, "LIST_ROWS", 8), monkeypatch.setattr(simhash, "GROUP_ROWS", 8), monkeypatch.setattr(simhash, "SALTS", 3)
    assert groups() == sorted(map(sorted, want.values()))


def test_links_of_a_large_group_grow_with_it(spark, monkeypatch):
    """A chain of near copies of which few are like the first: every part is asked, but only links that join something are given."""
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(120):  # each differs from the one before by a word, so the ends are unlike
        words = [*words[1:], f"n{i}"]
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 16)
    counted, plain = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: counted.append(edges.count()) or plain(edges))
    assert len({bytes(r.root) for r in simhash.similar_documents(frame).collect()}) == 1
    assert counted[1] <= 120 * (120 // 16 + 2) < len(true_links(rows))


def test_sketches():
    texts = pa.array(["a b c d e f g", "", "a b c d e f g a b c d e f g", "a b c", "A b C"])
    hashed, doc, made = simhash.shingles(texts, 5)
    assert made.tolist() == [3, 0, 10, 1, 1] and np.bincount(doc, minlength=5).tolist() == made.tolist()
    raw, sets = simhash.sketches(hashed, doc, 5), simhash.shingle_sets(hashed, doc, 5)
    assert raw.shape == (5, simhash.PLACES) and (raw[3] == raw[4]).all() and (raw[1] == 255).all() and [len(v) for v in sets] == [3, 0, 7, 1, 1]
    one = [simhash.sketches(*simhash.shingles(texts.slice(i, 1), 5)[:2], 1)[0] for i in range(5)]
    assert (raw == np.array(one)).all()


def test_sketch_is_a_simhash():
    """Every bit of a sketch is the vote of the row's distinct shingles, by hand."""
    texts = [" ".join(f"w{i * i % 23}" for i in range(n)) for n in (1, 5, 6, 40, 200)] + ["a b c d e f " * 9, ""]
    got = simhash.sketches(*simhash.shingles(pa.array(texts), 5)[:2], len(texts))
    for text, row in zip(texts, got, strict=True):
        votes = {h >> 32 for h in simhash.shingles(pa.array([text]), 5)[0].tolist()}
        for n in range(simhash.PLACES // 8):
            seed = simhash.mix(np.array([n + 1], np.uint64))
            hashes = [int(simhash.mix(np.array([v], np.uint64) ^ seed)[0]) for v in votes]
            want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else (1 << 64) - 1
            assert int.from_bytes(row[8 * n : 8 * n + 8].tobytes(), "big") == want


def test_recall_of_the_shortest_texts(spark):
    """Eight words against the same and a ninth: four of five shingles, where a SimHash says least."""
    rows = [(2 * n + i, " ".join(f"p{n}w{k}" for k in range(8 + i))) for n in range(400) for i in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: bytes(r.root) for r in simhash.similar_documents(frame).collect()}
    found = sum(root[2 * n] == root[2 * n + 1] for n in range(400))
    assert found >= 0.92 * 400 and len(set(root.values())) == 800 - found


def test_ties_of_a_large_group_are_few(spark):
    """The many posting lists that near copies share tie them by few links."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(150)]
    frame = spark.createDataFrame([(i, edited(rng, words, 2)) for i in range(300)], "doc_id long, text string").repartition(5)
    nodes = simhash._sketched(frame, 5).select("node", "sketch", F.substring("sketch", 1, simhash.HEAD).alias("head"))
    ties = simhash._tied(nodes).collect()
    assert {bytes(v) for t in ties for v in t} == {bytes(r.head) for r in nodes.collect()} and len(ties) <= 20 * 300, len(ties)


def test_edges_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Near copies share up to 256 posting lists; what is joined into components stays a few edges for each text, over all steps."""
    rng, words = np.random.default_rng(9), [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, words, 1 + i % 2)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counted, plain = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: counted.append(edges.count()) or plain(edges))
    assert len({bytes(r.root) for r in simhash.similar_documents(frame).collect()}) == 1 == len(set(wide_groups(rows)))
    assert sum(counted) <= 6 * 300, counted


def test_waves_tie_what_all_bands_tie_at_once(spark, monkeypatch):
    """What an earlier wave has tied counts as one in the next, which loses no tie; every band is in one wave."""
    assert sorted(n for wave in simhash.WAVES for n in wave) == list(range(len(simhash.BANDS)))
    rng, rows = np.random.default_rng(13), []
    for n in range(40):
        words = [f"g{n}w{i}" for i in range(60)]
        rows += [(10 * n + i, edited(rng, words, 1 + i % 3)) for i in range(1 + n % 7)]
    nodes = simhash._sketched(spark.createDataFrame(rows, "doc_id long, text string"), 5).select("node", "sketch", F.substring("sketch", 1, simhash.HEAD).alias("head"))
    tied = lambda: sorted((bytes(r.node), bytes(r.root)) for r in simhash._tied(nodes).collect())
    waves = tied()
    monkeypatch.setattr(simhash, "WAVES", [range(len(simhash.BANDS))])
    assert waves == tied() and len(waves) > 100


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    dense = rng.integers(0, 1 << 10, 200, dtype=np.uint64)
    return np.unique(np.concatenate([base, near, dense]))


@pytest.mark.parametrize("limit", [4096, 100, 20])
def test_links_lose_nothing(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_ROWS", limit)
    fps = planted(300, 2)
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    got, at = defaultdict(set), {int(f): i for i, f in enumerate(fps.view(np.int64))}
    for f in at:
        got[roots.get(f, f)].add(f)
    want = by_hand_groups(fps)
    assert {frozenset(s) for s in got.values()} == want


def test_long_lists_are_refined_to_bounded_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_ROWS", 20)
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 24, 600, dtype=np.uint64))  # all share five bytes
    lists = simhash.posting_lists(spark.createDataFrame([(int(f),) for f in fps], "fp long"))
    assert max(r["count"] for r in lists.groupBy("key").count().collect()) < 40


def by_hand_groups(fps):
    left, out, signed = set(range(len(fps))), set(), fps.view(np.int64)
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            i = queue.pop()
            near = [j for j in left if int(fps[i] ^ fps[j]).bit_count() <= 3]
            left -= set(near)
            group |= set(near)
            queue += near
        out.add(frozenset(int(signed[i]) for i in group))
    return out


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i * 7919 % 101, (i + 1) * 7919 % 101) for i in range(90)], "a long, b long")
    assert len({r.root for r in simhash.components(edges).collect()}) == 1


# decontamination


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, awkward, empty, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(6, 14)))) for i in range(12)] + [(90, "short"), (91, ""), (92, None), (None, "this one has no id but is in a text word for word")]
    rows = []
    for n in range(120):
        i, t = rng.choice(items[:12])
        t = list(t)
        for _ in range(rng.randint(0, len(t) // 30)):
            at = rng.randrange(len(t))
            rng.choice([lambda t=t, at=at: t.__setitem__(at, "x"), lambda t=t, at=at: t.insert(at, "y"), lambda t=t, at=at: t.pop(at)])()
        rows.append((n, "Leading WORDS here \n " + "".join(t).upper() + "  trailing words"))
    rows += [(1000, None), (1001, ""), (1002, "a short one"), (1003, "nothing of the kind here at all"), (1004, "x this ONE has no id but is in a text word for word y")]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(frame, bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            p = plain(x).strip()
            if p and t:
                low = plain(t)
                e = least_edits(p, low)
                if e <= (decontam.budget(len(p)) if len(p) >= decontam.Q else 0):
                    want[d, i] = e
    assert {k: r.edits for k, r in got.items()} == want and len(want) > 20
    for (d, i), r in got.items():
        span = plain(dict(rows)[d][r.start : r.end])
        assert least_edits(plain(dict(items)[i]).strip(), span) == r.edits
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(awkward, bench.limit(0)).count() == 0
    assert got[1004, None].edits == 0
    both = spark.createDataFrame([(5, "a b c d e f g h i j k l m n"), (5, "a b c d e f g h i j k l m n"), (None, "same word same word same word"), (7, None), (8, "z" * 300)], "item_id long, text string")
    hits = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(awkward, both).collect())
    assert hits == Counter({(7, 5): 2, (6, 5): 2, (8, 5): 4, (None, 5): 2, (11, None): 1, (13, None): 1, (12, 8): 1})
    assert decontam.keep_clean(awkward, both).count() == len(AWKWARD) - 8
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert {(r.doc_id, r.item_id): r for r in decontam.contaminated(frame, bench).collect()} == got
    clean = decontam.keep_clean(frame, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_planted_passages_of_the_benchmark(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    inside = {(d, r.item_id) for d, t in rows for r in bench.collect() if r.text in t}
    assert inside <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}


def test_many_items_of_one_vocabulary(spark, rows, monkeypatch):
    rng = random.Random(6)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [*enumerate(bench), *((1000 + i, " ".join(rng.sample(w := bench[i % len(bench)].split(), len(w)))) for i in range(3000))]
    matcher, texts = decontam.Matcher(items), pa.array([t for _, t in rows])
    tracemalloc.start()
    found = matcher.match(texts)
    peak = tracemalloc.get_traced_memory()[1] / texts.nbytes
    tracemalloc.stop()
    assert {(n, i) for n, (_, t) in enumerate(rows) for i, x in enumerate(bench) if x in t} <= {(n, i) for n, i, e, *_ in found if not e}
    assert peak < 120  # bytes for each byte of text
    monkeypatch.setattr(decontam, "RUN_HITS", 50)
    assert matcher.match(texts) == found


def test_copies_of_items_are_matched_once(spark, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(value)) or broadcast(self, value))
    text = "the passage of the items"
    items = spark.createDataFrame([*((i, text) for i in range(40)), (None, text), (3, text), (50, "another passage that no text has"), (51, None)], "item_id long, text string")
    frame = spark.createDataFrame([(1, f"some words before {text} and after"), (2, None)], "doc_id long, text string")
    hits = Counter((r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(frame, items).collect())
    assert hits == Counter([*((1, i, 0) for i in range(40)), (1, None, 0), (1, 3, 0)])
    assert [r.doc_id for r in decontam.keep_clean(frame, items).collect()] == [2]
    assert sent == [3, 3]


# shards


def test_shards(spark, docs, awkward, empty, tmp_path):
    kept, back = shards.sharded(docs, f"file://{tmp_path}/s", target_bytes=1 << 20)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    assert kept.versions() == list(range(len(kept.versions()))) and len(kept.versions()) >= 4
    assert sum(r.n_rows for r in kept.manifest().collect()) == docs.count()
    sizes = Counter(kept.tier(r.bytes) for r in kept.manifest().collect())
    assert all(n < kept.fan_in for t, n in sizes.items() if t < 1 << 10)
    _, back = shards.sharded(awkward, f"file://{tmp_path}/a")
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, awkward.collect()))
    _, back = shards.sharded(empty, f"file://{tmp_path}/e")
    assert back.count() == 0


def test_a_version_is_committed_once(spark, docs, tmp_path):
    one = shards.ShardStore(spark, f"file://{tmp_path}/s")
    one.append(docs.limit(10))
    with pytest.raises(FileExistsError):
        one._commit(one.manifest(), at=0)
    assert one.manifest().count() > 0 and one.versions() == [0]


def test_two_writers_lose_nothing_and_versions_stay(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "CHECKPOINT", 3)
    one, two = (shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=2) for _ in range(2))
    parts = [docs.filter(F.col("doc_id") % 6 == n) for n in range(6)]
    counts, real = [], shards.ShardStore.versions
    for n in range(0, 6, 2):
        one.append(parts[n])
        counts.append(parts[n].count())
        stale = [one.versions()[:-1]]
        two.versions = lambda: stale.pop() if stale else real(two)  # has not seen the last version yet
        two.append(parts[n + 1])
        counts.append(parts[n + 1].count())
    assert one.versions() == list(range(6)) and one.read(docs.schema).count() == docs.count()
    open_reader, late = one.read(docs.schema, 5), f"{tmp_path}/s/data/a-uncommitted"
    docs.limit(5).write.parquet(f"file://{late}")
    last = one.compact(docs.schema)
    assert last and open_reader.count() == docs.count() and one.manifest().count() < one.manifest(5).count()
    for v in range(6):
        assert one.read(docs.schema, v).count() == sum(counts[: v + 1])
    assert one.vacuum(keep=1) == [] and one.vacuum(keep=1, age=0) == list(range(last))
    assert one.read(docs.schema).count() == docs.count() and spark.read.parquet(f"file://{late}").count() == 5
    with pytest.raises(LookupError):
        one.read(docs.schema, 0)
    one.append(docs.limit(3))
    assert one.read(docs.schema).count() == docs.count() + 3


def test_columns_that_differ_between_arrivals(spark, tmp_path):
    one = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=2)
    assert one.schema().fields == [] and one.append(spark.createDataFrame([(1, "a")], "id long, t string")) == 0
    one.append(spark.createDataFrame([(2, 0.5)], "id long, extra double"))
    one.append(spark.createDataFrame([("c", 3)], "T string, id long"))
    want = [(1, "a", None), (2, None, 0.5), (3, "c", None)]
    with pytest.raises(ValueError):
        one.compact(spark.createDataFrame([], "id long, t string").schema)
    assert sorted(map(tuple, one.read().collect())) == want and one.read().columns == ["id", "t", "extra"]
    last = one.compact()
    assert last is not None and one.manifest().count() == 1 and sorted(map(tuple, one.read().collect())) == want
    assert [len(one.schema(v).fields) for v in range(3)] == [2, 3, 3] and one.read(version=0).columns == ["id", "t"]
    with pytest.raises(ValueError):
        one.append(spark.createDataFrame([("x",)], "id string"))
    assert one.versions()[-1] == last


def test_crash_in_vacuum_leaks_nothing(spark, tmp_path, monkeypatch):
    import os

    one = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=2)
    for n in range(3):
        one.append(spark.createDataFrame([(n,)], "id long"))
    one.compact()
    files = lambda: sum(n.endswith(".parquet") for d, _, names in os.walk(f"{tmp_path}/s/data") for n in names)
    before = files()
    monkeypatch.setattr(shards.ShardStore, "_sweep", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        one.vacuum(keep=1, age=0)
    monkeypatch.undo()
    assert files() == before and len(one.versions()) == 1  # the markers are gone, the shards are not
    assert one.vacuum(keep=1, age=0) == [] and files() < before and sorted(r.id for r in one.read().collect()) == [0, 1, 2]
    assert not os.listdir(f"{tmp_path}/s/_dead")


def test_a_compaction_that_lost_its_shards_is_dropped(spark, docs, tmp_path):
    one = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=2)
    for n in range(2):
        one.append(docs.limit(20).coalesce(1))
    mine = one.manifest().collect()
    assert one._committed(one.manifest().limit(1), spark.createDataFrame([("gone.parquet", 1, 1, 0)], shards.MANIFEST)) is None
    assert sorted(one.manifest().collect()) == sorted(mine)


def test_shared_folder():
    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master))

    assert store.shared_dir(session("spark://far:7077", **{"spark.checkpoint.dir": "file:///shared/folder/"})) == "file:///shared/folder"
    assert store.shared_dir(session("local[4]")).startswith("file:///")
    for cluster in ("spark://far:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            store.shared_dir(session(cluster))


def test_work_tables_of_a_scope_are_removed(spark, docs):
    with store.scope(spark):
        store.written(docs.limit(3), "inner")
        path = store._scopes[-1][-1]
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_letter_only_keys_are_found_and_compounds_are_not(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choice(letters) for _ in range(48)) for _ in range(60)]
    words = "donau dampf schiff fahrts gesellschaft the quick brown fox jumps over counter revolution element class name value state of history station".split()
    compounds = ["".join(way(rng.choice(words)) for _ in range(9)) for way in (str, str.capitalize, str.upper) for _ in range(20)]
    frame = spark.createDataFrame([(i, f"it is {k} here") for i, k in enumerate(keys + compounds)], "doc_id long, text string")
    got = {r.doc_id: r.n_random for r in secrets.secret_spans(frame).collect()}
    assert sum(got[i] for i in range(60)) >= 54 and sum(got[i] for i in range(60, 120)) <= 1
    assert secrets.encoding("abc" * 6) == "lower" and secrets.encoding("aBc" * 6) == "letters" and secrets.encoding("XY2" * 6) == "base32"


def test_special_tokens_in_texts_equal_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(6)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "end<|endoftext|>begin"] + ["".join(rng.choice(["<|endoftext|>", " ", "  ", "a", "word", "<|", "\n", "é", "1"]) for _ in range(12)) for _ in range(2000)]
    ids, bounds = encoder(tokenizer_path()).encode(pa.array(texts))
    assert ids[: bounds[1]].tolist() == [50256]
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == fresh.encode(t, add_special_tokens=False).ids, t
