"""Sources with their own parser and the smaller table operators."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import records, tables
from sievewright.sources import graphs

RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e.org/#" xml:base="http://e.org/">
<owl:Class rdf:about="#A"><rdfs:label xml:lang="en">The A</rdfs:label><rdfs:subClassOf rdf:resource="http://e.org/#B"/></owl:Class>
<owl:Class rdf:about="#A"><rdfs:label xml:lang="en">The A</rdfs:label></owl:Class>
<rdf:Description rdf:ID="i"><e:has><e:Thing><e:n rdf:datatype="int">5</e:n></e:Thing></e:has><e:list rdf:parseType="Collection"><rdf:Description rdf:about="#x"/><rdf:Description rdf:about="#y"/></e:list></rdf:Description>
</rdf:RDF>"""


def test_rdf(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(RDF)
    t = graphs.read_rdf(spark, str(tmp_path / "a.rdf"))
    got = {(r.s, r.p.rpartition("#")[2], r.o) for r in t.collect()}
    assert {("http://e.org/#A", "type", "http://www.w3.org/2002/07/owl#Class"), ("http://e.org/#A", "label", "The A"), ("http://e.org/#A", "subClassOf", "http://e.org/#B")} <= got
    assert sum(p == "label" for _, p, _ in got) == 1 and sum(p == "first" for _, p, _ in got) == 2 and ("_:b0", "n", "5") in got or any(p == "n" and o == "5" for _, p, o in got)
    kinds = {r.node: r.kind for r in records.node_kinds(t).collect()}
    assert kinds["http://e.org/#A"] == "class" and kinds["http://e.org/#B"] == "class" and kinds["http://e.org/#i"] == "individual" and kinds["http://e.org/#x"] == "resource"
    assert {r.node: r.label for r in records.node_labels(t).collect()}["http://e.org/#A"] == "The A"


def test_geojson(spark, tmp_path):
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "a", "k": 2}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3.5, 2], [3.5, -4e0], [1, 2]]]}}]}
    (tmp_path / "f.json").write_text(json.dumps(body))
    r = graphs.read_geojson(spark, str(tmp_path / "f.json")).first()
    assert (r.type, r.properties["k"], r.west, r.east, r.south, r.north) == ("Polygon", "2", 1.0, 3.5, -4.0, 2.0)


def test_formulas(spark):
    df = spark.createDataFrame([("3", "4"), ("x", "1"), ("0", "0")], "a string, b string")
    cell = {c: F.col(c) for c in df.columns}
    run = lambda f: [r[0] for r in df.select(tables.formula(f, cell)).collect()]
    assert run("hypot(${a}, ${b}) * 2 - 1") == [9.0, None, -1.0]
    assert run("${a} / ${b}") == [0.75, None, None] and run("round(-2.5 + ${a} * 0)")[0] == -2.0
    assert run("max(${a}, PI)")[0] == pytest.approx(math.pi)
    for bad in ("__import__('os')", "${a}.x", "open(${a})", "${zz} + 1", "'a'"):
        with pytest.raises((ValueError, SyntaxError)):
            tables.formula(bad, cell)


def test_small_tables(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None)], "s string, n double")
    assert [r.document for r in tables.merged(df, "<${s}:${n}>").collect()] == ["<a:1>"]
    row = spark.range(1)
    assert row.select(tables.shown_number(F.lit(0.1234), "0.0%")).first()[0] == "12.3%"
    assert row.select(tables.shown_number(F.lit(7.0), "000")).first()[0] == "007"
    assert row.select(tables.shown_number(F.lit(1234567.5), "#,##0.00")).first()[0] == "1,234,567.50"
    assert row.select(tables.nearly(F.lit("1.00000001"), F.lit("1"))).first()[0]
    pitch, roll = tables.attitude(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert tuple(row.select(pitch, roll).first()) == (0.0, 0.0)
    lay = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "i int, n string")
    assert {r.i: r.n for r in tables.distinct_names(lay, "n", "i").collect()} == {1: "A", 2: "a_2", 3: "b"}
    ew = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 20.0)], "k string, o int, v double")
    assert tables.smoothed(ew, "k", "o", "v").first().smoothed == pytest.approx(13.0)
    days = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(1, 21)], "day string")
    assert tables.latest_days(days, "day").count() == 15
    assert tables.search(lay, "B", ["n"]).count() == 1
    lists = spark.createDataFrame([("l", ["x", "y"])], "k string, items array<string>")
    assert [(r["items"], r["rank"]) for r in tables.ranked(lists, "k", "items").collect()] == [("x", 1), ("y", 2)]


def test_outside_clients(spark):
    got = graphs.scanned(spark, ["a", "b"], lambda part: ({"part": part, "n": i} for i in range(1500)), "part string, n long")
    assert got.count() == 3000
    assert graphs.sent(got.limit(10), lambda rows: (len(rows), 0), 3).agg(F.sum("sent")).first()[0] == 10


def test_model_columns(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("bad",)], "t string")
    cache = spark.createDataFrame([("b",)], "t string").select(F.sha2(F.concat(F.lit("ask "), F.col("t")), 256).alias("key"), F.lit("cached").alias("o"))

    def client(prompts):
        if any("bad" in p for p in prompts):
            return "nonsense"
        assert not any(p == "ask b" for p in prompts)
        return json.dumps([{"o": p.upper()} for p in prompts])

    got = sorted((r.t, r.o) for r in tables.model_columns(rows, "ask ${t}", ["o"], client, cache).collect())
    assert got == [("a", "ASK A"), ("a", "ASK A"), ("b", "cached"), ("bad", None)]


def test_smoothed_blocks_equal_the_recurrence(spark):
    rng = random.Random(5)
    data = [(k, o, None if rng.random() < p else rng.uniform(0, 50)) for k, p in (("a", 0), ("b", 0.1), ("c", 0.5), (None, 0)) for o in range(60)] + [("d", 1, 2.0), ("e", 1, None)]
    want = {}
    for k, _, v in data:
        a = want.get(k)
        want[k] = v if a is None else None if v is None else a * 0.7 + v * 0.3
    df = spark.createDataFrame(data, "k string, o int, v double").repartition(5)
    for order in (F.col("o"), F.format_string("%03d", "o")):
        out = tables.smoothed(df.withColumn("o", order), "k", "o", "v", block=7)
        got = {r.k: r.smoothed for r in out.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan
