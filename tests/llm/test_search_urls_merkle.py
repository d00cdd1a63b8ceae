"""Ranked search, URL filters and the Merkle manifest against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import merkle, search, urls

from test_llm_operators import AWKWARD, SF, awkward, empty  # noqa: F401

TERM = re.compile(search.TERM)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search


def ranking(docs, items, k=10):
    cut = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    cut = [(i, w) for i, w in cut if w]
    n_docs, n_terms = len(cut), sum(len(w) for _, w in cut)
    counted = [(i, len(w), Counter(w)) for i, w in cut]
    df = Counter(t for _, _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall((text or "").translate(LOW)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, n, c in counted:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    want = ranking(*plain)
    assert len(want) == 400 and sorted(map(tuple, search.ranked(docs.repartition(3), items).collect()), key=str) == want


def test_ranked_search_in_small_blocks(spark, monkeypatch):
    """Ties, repeated rows and queries, many blocks of either side: the same rows."""
    docs = [(i, " ".join(f"t{(i * j) % 7}" for j in range(i % 9))) for i in range(300)] + [(7, "T1 t1"), (None, "t3"), (None, "t1 t1"), (8, None), (9, "— § 漢字, Ünï")]
    items = [(1, "t1 T2 t3"), (1, "t5"), (2, None), (3, "nowhere"), (None, "t4 ünï Ünï"), (5, "漢字"), (6, "t0-t1_t2")]
    keep = search.blocks
    monkeypatch.setattr(search, "blocks", lambda items, key, text: keep(items, key, text, 12))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "score": F.lit(0)}).repartition(3)
    got = search.ranked(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(2)), postings=50, chunk=1)
    assert sorted(map(tuple, got.collect()), key=str) == ranking(docs, items)


def test_ranked_search_awkward(spark, awkward, empty):  # noqa: F811
    items = [(1, "same a z"), (2, "")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, search.ranked(awkward, frame).collect()), key=str) == ranking(AWKWARD, items)
    assert search.ranked(empty, frame).collect() == [] and search.ranked(awkward, frame.limit(0)).collect() == []


def test_threshold_stops_early():
    """One rare heavy term: the search must not read the long list of the other to its end."""
    n = 4000
    words = np.concatenate([[0, 1]] * 20 + [[1]] * (n - 20)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([2] * 20 + [1] * (n - 20))])
    block = search.Block(np.ones(n, np.int64), bounds, words, np.ones(len(words), np.int64), np.full(n, 100), 2)
    seen, plain = [], block.scored
    block.scored = lambda rows, worth: seen.append(len(rows)) or plain(rows, worth)
    rows, scores = block.best(np.array([0, 1]), np.array([5000, 10]), np.zeros(2, np.int64), 1)
    assert sum(seen) < 200 and sorted(rows[np.argsort(-scores, kind="stable")][:10]) == list(range(10))


def test_split_in_pieces(monkeypatch):
    text = "Ab--cd é9 " * 5 + "x" * 20 + "\0y漢"
    whole = [w.encode() for w in TERM.findall(text.translate(LOW))]
    monkeypatch.setattr(search, "PIECE", 3)
    assert [w for piece in search.split(text) for w in piece] == whole and len(list(search.split(text))) > 5


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 5])
    assert search.lengths(n, 10**11, 10**14).tolist() == [10 + 90 * 10**9 * 10**11 // 10**14, 10 + 90 * 5 * 10**11 // 10**14]


# URL filters


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*)[\s\S]*", url.split("://", 1)[1]).groups()
        host = host.translate(LOW)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
         ("com", "/en/docs/very/long/", "block"), ("a.b.org", "", "block"), ("b.org", "/x", "allow"), ("b.org", "/x/y", "block"), ("b.org", "/x/y", "allow"), ("b.org", "/xz", "allow")]
URLS = ["http://example.com/en/1", "https://www.EXAMPLE.com/en/2?x", "http://notexample.com/en/", "http://example.com.evil.net/es/", "http://x-.com/", "http://example.com", "https://a.b.org#top", "ftp://c.a.b.org?q=://z",
        "//example.com/en/", None, "", "://", "http:///en/", "http://b.org/x/y/z", "http://b.org/xy", "http://b.org/xzz", "http://b.org/x", "http://b.org.", "http://user@b.org:80/x", "http://www.example.com/en/docs/very/long/1",
        "http://漢字.com/en/", "http://b.org/x\n/y", "http://a..b.org/x", "http://net/fr/", "http://com/", "http://example.com/" + "p/" * 20000, "http://" + "s." * 5000 + "net/es/1"]


def rule_frame(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_url_verdicts(spark):
    pages = list(enumerate(URLS)) + [(None, URLS[0]), (3, URLS[3]), (3, URLS[3])]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumns({"key": F.lit("k"), "host": F.lit("h"), "part": F.lit(1), "rule": F.lit("r")}).repartition(3)
    got = urls.url_verdicts(frame, rule_frame(spark, [*RULES, (None, "/", "block"), ("", "/", "block")]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *judged(u, RULES)) for i, u in pages), key=str)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]


def test_url_verdicts_dealt_wide(spark, monkeypatch):
    """One hot URL and one hot host, many ranges: every range has the rules that reach into it."""
    pages = [(i, "http://hot.example.com/en/same" if i % 3 == 0 else f"http://{'www.' * (i % 2)}{'h' * (i % 4)}.example.com/{'en' if i % 5 else 'de'}/{i}" if i % 3 == 1 else f"http://s{i}.net/fr/{i}") for i in range(900)]
    rules = RULES + [(f"s{i}.net", "/fr/", "allow") for i in range(0, 900, 7)]
    at = {}
    monkeypatch.setattr(urls.store, "partitions", lambda spark: 40)
    keep = urls.cuts
    monkeypatch.setattr(urls, "cuts", lambda keys, parts: at.setdefault("cuts", keep(keys, parts)))
    got = urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), rule_frame(spark, rules)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *judged(u, rules)) for i, u in pages)
    assert sum("same" in c for c in at["cuts"]) > 5  # the hot URL lies in many ranges


def test_url_verdicts_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.url_verdicts(none, rule_frame(spark, RULES)).collect() == []
    some = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in urls.url_verdicts(some, rule_frame(spark, RULES).limit(0), "block").collect()] == [(1, "a", "/b", None, "block")]


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def climb(nodes):
    """The root, and for each node its (left, right) siblings from the bottom up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            s = p - p % 3
            ways[i].append((nodes[s:p], nodes[p + 1 : s + 3]))
        at = [p // 3 for p in at]
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        now = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, now), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for x, way in zip(sorted(groups[s]), trees[s][1], strict=True):
            path, now = way + tops[n], x[3]
            for left, right in path:
                now = sha("".join([*left, now, *right]))
            out.append((x[4], x[2], trees[s][0], root, sha("".join(h for left, right in path for h in [*left, *right])), now, now == root))
    return sorted(out, key=str)


def proofs(frame, levels=merkle.LEVELS):
    return sorted(map(tuple, merkle.Manifest(frame, merkle.tampered(), levels).proofs().collect()), key=str)


def test_manifest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    assert proofs(docs.repartition(3)) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_many_rounds(spark, levels):
    """Small blocks: several rounds up and down, trees of many heights, a hot source."""
    rows = [(i, f"text\n{i}" if i % 4 else None, None if i % 5 else "en", "hot" if i % 2 else [None, "", "ä", "a", "z", *"bcdefghijk"][i % 15], i if i % 3 else None) for i in range(400)]
    rows += [(77, "again\n", "x", "hot", 1), (77, "again\n", "x", "hot", 1), (None, "\n", None, "hot", 2), (None, "", None, "only", None), (2, "\n\n", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({"g": F.lit(1), "pos": F.lit(2), "h": F.lit("x"), "level": F.lit(3), "now": F.lit("y"), "run": F.lit(9)})
    assert proofs(frame.repartition(5), levels) == manifest(rows)


def test_manifest_store(spark, awkward, empty):  # noqa: F811
    rows = [(i, t, None, None, None) for i, t in AWKWARD]
    assert proofs(awkward) == manifest(rows)
    assert proofs(empty) == []
    made = merkle.Manifest(awkward)
    tree = made.trees.upper()
    assert {r.level: r["count"] for r in tree.groupBy("level").count().collect()} == {1: 5, 2: 2, 3: 1}
    assert [tuple(r) for r in made.roots().collect()] == [(None, len(rows), manifest(rows)[0][2], manifest(rows)[0][3])]
    assert all(r.verified for r in made.proofs().collect())
