"""Order-dependent operators, repairs, profiles and records on small rows, whatever the partitioning."""

import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievewright.operators import clean, generate, incremental, profile, quality, records, userfn
from sievewright.plans.config import ConfigError, Constraint, Fallback, FieldSpec, Generate, Op, Task

SCHEMA = "_file_ord int, _row long, v string"


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("_file_ord", "_row").collect()]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_ffill_by_file(spark, parts):
    rng = random.Random(parts)
    data = [(f, r, rng.choice(["", None, "a", "b"])) for f in range(3) for r in range(40)]
    want, last = [], {}
    for f, r, v in data:
        last[f] = v if v else last.get(f)
        want.append((f, r, v if v else last[f] if last[f] else v))
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    assert rows_of(clean.fillable(df, "v", block=7), "_file_ord", "_row", "v") == want
    assert rows_of(df.withColumn("v", clean.forward_filled(df, "v", ["_file_ord"], ["_row"])), "_file_ord", "_row", "v") == want


def made_unique(values):
    """One value after another, each repeat with the least free number."""
    taken, out = set(), []
    for v in values:
        v = v or ""
        n, given = 1, v
        while v and given in taken:
            given, n = f"{v}_{n}", n + 1
        taken.add(given)
        out.append(given)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_suffix_is_sequential(spark, seed, monkeypatch):
    monkeypatch.setattr(quality, "SUFFIX_BLOCK", 5)
    rng = random.Random(seed)
    texts = ["x", "x_1", "y", "x_2", "y_1_1", "", None, "x_5", "x_9", "x_05", "_1", "_1_1", "x_1_2", "x_9_9", "z\n_1", "z\n", "x_3"]
    data = [(f, i, rng.choice(texts[: 5 + 6 * seed])) for f in range(2) for i in range(150)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert [v or "" for (v,) in rows_of(quality.resolve_unique(df, "v", "_"), "v")] == made_unique(v for _, _, v in data)
    got = [v or "" for (v,) in rows_of(quality.resolve_unique(df, "v", "_", by_file=True), "v")]
    assert got == made_unique(v for f, _, v in data if f == 0) + made_unique(v for f, _, v in data if f == 1)


def test_unique_numbers_of_one_stem():
    rng = random.Random(4)
    for _ in range(300):
        texts = ["x", *(f"x_{n}" for n in rng.sample(range(1, 14), 6)), "x_2_1", "x_2_2", "x_3_1"]
        values = [rng.choice(texts[: rng.randint(2, 10)]) for _ in range(rng.randint(2, 60))]
        rows = []
        for t in set(values):
            parent, _, n = t.rpartition("_")
            rows.append((t, values.count(t), parent or None, int(n) if parent else 0, values[: values.index(t)].count(parent)))
        table = {(t, b): rest for t, b, *rest in quality._numbered(pd.DataFrame(rows, columns=["__text", "n", "parent", "number", "earlier"]), 3)}
        got, seen = [], Counter()
        for v in values:
            first, base, steps = table[v, seen[v] // 3]
            j = seen[v] + first
            seen[v] += 1
            got.append(f"{v}_{j + max([s for at, s in steps if at <= j], default=base)}" if j else v)
        assert got == made_unique(values)


def test_unique_suffix_must_be_readable(spark):
    df = spark.createDataFrame([(0, 0, "a")], SCHEMA)
    for suffix in ("", "-1"):
        with pytest.raises(ValueError, match="suffix"):
            quality.resolve_unique(df, "v", suffix)


def test_dedupe_scopes(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 0, "a"), (1, 1, ""), (1, 2, None)], SCHEMA).repartition(3)
    assert rows_of(clean.apply_op(df, Op(op="dedupe", subset=("v",), scope="file")), "_file_ord", "_row") == [(0, 0), (1, 0), (1, 1)]
    assert rows_of(clean.apply_op(df, Op(op="dedupe", subset=("v",))), "_file_ord", "_row") == [(0, 0), (1, 1)]


def test_text_operators_leave_typed_cells(spark):
    df = spark.createDataFrame([(0, 0, "3.0"), (0, 1, "x3"), (0, 2, "")], SCHEMA)
    out = clean.apply_ops(df, [Op(op="cast", field="v", value_kind="int"), Op(op="replace", field="v", pattern="3", replacement="9")])
    assert rows_of(out, "v") == [("3",), ("x9",), ("",)]


def test_missing_field_is_skipped(spark):
    df = spark.createDataFrame([(0, 0, "a")], SCHEMA)
    assert rows_of(clean.apply_op(df, Op(op="upper", field="zz")), "v") == [("a",)]


def scalar(v, k):
    """One constraint on one text, in plain Python."""
    import math
    import re

    t = v or ""
    if k.kind == "non_null":
        return t == ""
    if k.kind == "enum":
        return t not in k.values
    if k.kind == "regex":
        return not (re.fullmatch(k.pattern, t) if k.mode == "fullmatch" else re.search(k.pattern, t))
    if k.kind == "length":
        return not (k.min_length or 0) <= len(t) <= (k.max_length if k.max_length is not None else 10**9)
    try:
        x = float(t.strip()) if t else None
    except ValueError:
        x = None
    if x is None:
        return True
    return not math.isnan(x) and not ((k.min_value is None or x >= k.min_value) and (k.max_value is None or x <= k.max_value))


def test_random_constraint_sets(spark):
    rng = random.Random(7)
    pool = [Constraint("non_null"), Constraint("enum", values=("a", "42", "bb")), Constraint("regex", pattern="[a-z]+"), Constraint("regex", pattern=r"\d", mode="search"), Constraint("length", min_length=1, max_length=3), Constraint("range", min_value=0, max_value=50), Constraint("range", max_value=10)]
    order = ["non_null", "format", "type", "enum", "regex", "length", "range", "unique"]
    values = ["", None, "a", "bb", "abcd", "42", "7", "-1", "nan", "1e1", "A", " 5 ", "漢字", "4 2"]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], SCHEMA)
    sets = [tuple(rng.sample(pool, rng.randint(1, 4))) for _ in range(40)]
    out = df.select("_file_ord", "_row", *[quality.violation(df, FieldSpec("v", constraints=s)).alias(f"k{n}") for n, s in enumerate(sets)])
    for (_, _, v), r in zip([(0, i, v) for i, v in enumerate(values)], out.orderBy("_row").collect(), strict=True):
        for n, s in enumerate(sets):
            want = next((k.kind for k in sorted(s, key=lambda k: order.index(k.kind)) if scalar(v, k)), None)
            assert r[f"k{n}"] == want, (v, s)


def test_repairs(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(["", "abcdef", "a", "id 77 x", "200", "7.5", "-3", "oops"])], SCHEMA)

    def fixed(constraint, **fallback):
        return [v for (v,) in rows_of(quality.enforce(df, FieldSpec("v", constraints=(constraint,), fallback=Fallback("truncate", **fallback))), "v")]

    assert fixed(Constraint("non_null"), default="d")[0] == "d"
    assert fixed(Constraint("length", min_length=2, max_length=4, pad_char="*")) == ["**", "abcd", "a*", "id 7", "200", "7.5", "-3", "oops"]
    assert fixed(Constraint("range", min_value=0, max_value=100)) == ["", "abcdef", "a", "id 77 x", "100", "7.5", "0", "oops"]
    assert fixed(Constraint("regex", pattern="id 77", mode="search"))[3] == "id 77 x"


def test_generated_columns_do_not_depend_on_partitions(spark):
    specs = [FieldSpec("n", generate=Generate("sequence", start=1, width=3)), FieldSpec("r", generate=Generate("random", generator="random_int", params={"min": 0, "max": 9})), FieldSpec("t", generate=Generate("expression", expression="${n}-${r}"))]
    df = spark.createDataFrame([(0, i, str(i)) for i in range(50)], SCHEMA)
    seen = {str(rows_of(generate.generate_columns(df.repartition(p), specs, seed=3), "n", "r", "t")) for p in (1, 4, 13)}
    assert len(seen) == 1 and "('001', " in seen.pop()


def test_retry_gives_other_values(spark):
    spec = FieldSpec("r", constraints=(Constraint("range", min_value=5),), generate=Generate("random", generator="random_int", params={"min": 0, "max": 9}), fallback=Fallback("retry", max_retries=30))
    df = spark.createDataFrame([(0, i, "") for i in range(30)], SCHEMA)
    assert all(int(v) >= 5 for (v,) in rows_of(generate.generate_columns(df, [spec], seed=1), "r"))


def test_percentiles_nearest_rank(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 1000):
        values = [rng.choice([rng.random() * 100, float(rng.randint(0, 5))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = {r.q: r.value for r in profile.percentiles(df, "v", qs=(0.0, 0.5, 0.95, 1.0), parts=16).collect()}
        assert got == {q: sorted(values)[round(q * (n - 1))] for q in got}


def test_json_documents(spark):
    docs = [(1, '{"a": {"b": [1, "x~/"]}, "c": null}'), (2, '{"a": 1, "a": 2}'), (3, "[NaN]"), (4, "9007199254740993"), (5, "[" * 120 + "]" * 120), (6, None)]
    got = records.flattened(spark.createDataFrame(docs, "k long, d string"), "k", "d").collect()
    assert [(r.pointer, r.type) for r in got if r.k == 1] == [("", "object"), ("/a", "object"), ("/a/b", "array"), ("/a/b/0", "number"), ("/a/b/1", "string"), ("/c", "null")]
    assert {r.k for r in got if r.type == "invalid"} == {2, 3, 4, 5, 6}


def test_json_diff_keeps_the_shallowest(spark):
    a, b = {"x": 1, "y": {"z": 1, "w": 2}, "l": [1, 2]}, {"y": {"z": 3}, "l": [1, 2, 3], "n": {"deep": {"er": 1}}}
    f = lambda v: records.flattened(spark.createDataFrame([(1, json.dumps(v))], "k long, d string"), "k", "d")
    got = {(r.pointer, r.change) for r in records.json_diff(f(a), f(b), "k").collect()}
    assert got == {("/x", "removed"), ("/y/z", "changed"), ("/y/w", "removed"), ("/l/2", "added"), ("/n", "added")}


def test_pages(spark):
    page = "<html><head><title> A  b </title><style>x{}</style></head><body><h1>Head</h1><p>One<br>two &amp; three</p><ul><li>i</li></ul><table><tr><td>c1</td><td>c2</td></tr></table><a href='/rel#f'>Link  text</a><script>bad()</script></body></html>"
    df = spark.createDataFrame([(1, "http://h.org/dir/", page), (2, "u", "")], "page_id long, url string, html string")
    got = records.page_records(df).orderBy("page_id").collect()
    assert (got[0].title, got[0].content) == ("A b", "Head\nOne\ntwo & three\n• i\nc1 c2\nLink text") and got[1].content == ""
    assert [tuple(r) for r in records.page_links(df).collect()] == [(1, 0, "http://h.org/rel", "Link text")]


def test_quota(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "stratum string, n long")
    got = {r.stratum: r.quota for r in records.stratified_quota(sizes, 50).collect()}
    assert sum(got.values()) == 50 and got["a"] >= 45 and got["c"] == 1
    assert {r.quota for r in records.stratified_quota(sizes, 5000).collect()} == {900, 90, 10}


def test_upserts(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "k string, v int")
    new, counts = incremental.insert_or_ignore(store, rows, "k", ["v"])
    assert [tuple(r) for r in new.collect()] == [("c", 3)] and tuple(counts.first()) == (1, 2)
    whole = incremental.with_fallback(store, store.limit(0), "k", rows.limit(1))
    assert whole.count() == 1 and incremental.with_fallback(store, store.limit(1), "k", rows).count() == 1


CODE = "def transform(row):\n    if row['v'] == 'bad':\n        raise ValueError('no')\n    return {'w': row['v'].upper()} if row['v'] else None\n"


def test_user_functions(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "bad"), (0, 2, "")], SCHEMA)
    got = rows_of(userfn.apply_function(df, CODE, ["v"], ["w"], on_error="empty"), "w", "_error")
    assert got == [("A", None), ("", "ValueError: no"), (None, None)]
    column = "def transform(cols):\n    return {'w': [len(v) for v in cols['v']]}\n"
    assert [w for (w,) in rows_of(userfn.apply_function(df, column, ["v"], ["w"], mode="column"), "w")] == ["1", "3", "0"]
    for bad in ("import os\ndef transform(r): pass", "def transform(r): return eval('1')", "def transform(r): return r.__class__", "while True: pass\ndef transform(r): pass", "x = 1"):
        assert userfn.problems(bad)
        with pytest.raises(ValueError):
            userfn.apply_function(df, bad, ["v"], ["w"])


def test_config_is_strict():
    for bad in ({"name": "t", "fields": [{"dest": "a"}], "colour": 1}, {"name": "t", "fields": [{"dest": "a"}, {"dest": "a"}]}, {"name": "t", "fields": [{"dest": "a"}], "ops": [{"op": "explode"}]}, {"name": "t", "fields": [{"dest": "a", "fallback": {"on_violation": "retry"}}]}, {"name": "t", "fields": [{"dest": "a", "constraints": [{"kind": "unique", "severity": "warn"}]}]}):
        with pytest.raises((ConfigError, ValueError)):
            from sievewright.plans.config import strict

            strict(Task, bad)
    one, two = Task("a", (FieldSpec("x", "x"),)), Task("b", (FieldSpec("x", "x"),))
    assert one.fingerprint == two.fingerprint != Task("a", (FieldSpec("y", "x"),)).fingerprint


def test_profile_counts(spark):
    df = spark.createDataFrame([("a", 1.5), ("", None), ("ccc", 2.0)], "s string, n double")
    got = {r.field: r for r in profile.counts(df, ["s", "n"]).collect()}
    assert (got["s"].n_empty, got["s"].min_length, got["s"].max_length, got["n"].n_empty) == (1, 1, 3, 1)
    assert Counter(r.text for r in profile.top_values(df, ["n"], 2).collect()) == Counter(["", "1.5"])
    assert df.filter(F.col("s") == "a").count() == 1


@pytest.mark.parametrize("extra", [[], ["x_3"]])
def test_unique_suffixes_have_no_limit(spark, extra):
    data = [(0, i, v) for i, v in enumerate(extra + ["x"] * 10_010)]
    got = rows_of(quality.resolve_unique(spark.createDataFrame(data, SCHEMA), "v", "_"), "v")
    assert len(set(got)) == len(data) and ("x_10009",) in got
