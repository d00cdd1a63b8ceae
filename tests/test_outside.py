"""Databases behind JDBC (an embedded one), typed values of graph clients, run files, list pages, and streams of first arrivals."""

import datetime
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from sievewright.operators import pages
from sievewright.sources import databases, files, graphs, sinks, writers
from sievewright.streaming import clean

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def url(spark):
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


def test_upsert_adds_columns_and_counts(spark, url):
    first = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, n int, t string")
    first.limit(0).select("k", "n").write.option("createTableColumnTypes", "k VARCHAR(20), n INTEGER").jdbc(url, "rows_", properties=DERBY)
    assert sinks.jdbc_append_new(first, url, "rows_", "k", ["n"], DERBY, "VARCHAR(100)") == {"inserted": 2, "duplicates": 1}
    more = spark.createDataFrame([("b", 9, 1.5), ("c", 4, 2.5)], 'k string, n int, `new "one"` double')
    assert sinks.jdbc_append_new(more, url, "rows_", "k", ["n"], DERBY, "VARCHAR(100)") == {"inserted": 1, "duplicates": 1}
    assert sinks.jdbc_append_new(more, url, "rows_", "k", ["n"], DERBY, "VARCHAR(100)") == {"inserted": 0, "duplicates": 2}
    back = databases.jdbc_scan(spark, url, "rows_", DERBY)
    assert [c.lower() for c in back.columns] == ["k", "n", "t", 'new "one"']
    assert sorted(map(tuple, back.collect())) == [("a", 1, "x", None), ("b", 2, "y", None), ("c", 4, None, "2.5")]


def test_jdbc_scan_in_ranges(spark, url):
    spark.range(100).withColumn("v", F.col("id") * 2).write.jdbc(url, "numbers", properties=DERBY)
    back = databases.jdbc_scan(spark, url, "numbers", DERBY, "id", 5)
    assert back.rdd.getNumPartitions() == 5 and back.agg(F.sum("v")).first()[0] == 9900


class Value:
    """What a graph client hands out: answers for its own kind only."""

    def __init__(self, kind, value=None):
        self.kind, self.value = kind, value

    def __getattr__(self, name):
        if name.startswith("is_"):
            return lambda: name == f"is_{self.kind}"
        if name.startswith("as_"):
            return lambda: self.value
        raise AttributeError(name)


class Node:
    get_id = lambda self: Value("string", "n1")
    tags = lambda self: ["person"]
    properties = lambda self, tag: {"age": Value("int", 7)}


class Edge:
    start_vertex_id, end_vertex_id = lambda self: Value("string", "n1"), lambda self: Value("int", 2)
    edge_name, ranking = lambda self: "knows", lambda self: 3
    properties = lambda self: {"since": Value("date", datetime.date(2024, 1, 2))}


class Path:
    nodes, relationships = lambda self: [Node()], lambda self: [Edge()]


NODE = {"id": "n1", "tags": {"person": {"age": 7}}}
EDGE = {"s": "n1", "d": 2, "type": "knows", "rank": 3, "properties": {"since": "2024-01-02"}}


@pytest.mark.parametrize(
    ("value", "want"),
    [(Value("empty"), None), (Value("null"), None), (Value("bool", False), False), (Value("int", 5), 5), (Value("double", 1.5), 1.5), (Value("string", "é"), "é"), (Value("time", datetime.time(1, 2, 3)), "01:02:03"),
     (Value("date", datetime.date(2024, 1, 2)), "2024-01-02"), (Value("datetime", datetime.datetime(2024, 1, 2, 3, 4)), "2024-01-02T03:04:00"), (Value("list", [Value("int", 1), Value("null")]), [1, None]),
     (Value("set", {Value("int", 2)}), [2]), (Value("map", {"a": Value("list", [Value("bool", True)])}), {"a": [True]}), (Value("vertex", Node()), NODE), (Value("edge", Edge()), EDGE),
     (Value("path", Path()), {"nodes": [NODE], "edges": [EDGE]}), (Value("geography", 1), ""), (None, None), ("plain", "plain")],
)
def test_typed_values(value, want):
    assert graphs.decoded(value) == want and json.dumps(graphs.decoded(value)) is not None


def test_typed_rows_are_scanned(spark):
    class Plain:  # what a task can build by itself
        def __init__(self, kind, value):
            self.kind, self.value = kind, value
            for k in ("int", "string", "list"):
                setattr(self, f"is_{k}", lambda k=k: k == kind)
                setattr(self, f"as_{k}", lambda: value)

    def client(part):
        yield {"a": Plain("int", 1), "b": Plain("string", part)}
        yield {"a": Plain("list", [Plain("int", 2)])}

    got = graphs.scanned(spark, ["p", "q"], graphs.decoded_rows(client, ["a", "b"]), "a string, b string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("1", "p"), ("[2]", None), ("1", "q"), ("[2]", None)]))


def test_vertices_edges_and_documents(spark):
    v = graphs.vertices(spark.createDataFrame([(1, "a,b", '{"x": 1}')], "v_id int, tags string, tags_info string")).first()
    assert (v.id, v.tags, v.properties) == ("1", ["a", "b"], {"x": "1"})
    e = graphs.edges(spark.createDataFrame([("s", 2, None, "t", "{}")], "s_vid string, d_vid int, rank string, type string, type_info string")).first()
    assert (e.s, e.d, e["rank"], e.type, e.properties) == ("s", "2", 0, "t", {})
    d = graphs.search_documents(spark.createDataFrame([('{"_id": "7", "_source": {"a": [1]}}',), ("bad",)], "value string")).collect()
    assert [tuple(r) for r in d] == [("7", '{"a":[1]}'), (None, None)]


def test_run_files(spark, tmp_path):
    rows = [{"title": "a", "n": 1, "deep": {"x": [1]}}, {"n": None, "more": "é"}]
    texts = {"data.json": json.dumps([*rows, "no object"], ensure_ascii=False), "data.jsonl": "\n".join(map(json.dumps, rows)), "data.csv": "title,n\na,1\n,\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, "utf-8")
    shown = [("a", "1", '{"x":[1]}', None), (None, None, None, "é")]
    read = lambda name: files.read_run(spark, f"file://{tmp_path}/{name}").orderBy("_row")
    assert [(r.title, r.n, r.deep, r.more) for r in read("data.json").collect()] == shown == [(r.title, r.n, r.deep, r.more) for r in read("data.jsonl").collect()]
    assert [(r.title, r.n) for r in read("data.csv").collect()] == [("a", "1"), ("", "")]
    writers.write_xlsx(spark.createDataFrame([("w", "2")], "title string, n string"), f"{tmp_path}/data.xlsx")
    assert [(r.title, r.n) for r in read("data.xlsx").collect()] == [("w", "2")]
    for name, want in (("data.json", 2), ("data.csv", 2), ("data.xlsx", 1)):
        with zipfile.ZipFile(tmp_path / "run.zip", "w") as z:
            z.write(tmp_path / name, f"out/{name}")
            z.writestr("out/log.csv", "x\n1\n")
        assert files.read_run(spark, f"file://{tmp_path}/run.zip").count() == want
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.csv", "x")
    assert files.read_run(spark, f"file://{tmp_path}/none.zip").count() == 0
    (tmp_path / "object.json").write_text('{"a": 1}')
    assert files.read_run(spark, f"file://{tmp_path}/object.json").count() == 0


def test_list_pages(spark):
    stories = "<div class='story'><a href='/1'>one</a></div><div class='story'><a href='/2'>two</a></div>"
    given = [
        (1, "http://a/", f"<main><article><a href=x>1</a><a href=y>2</a></article></main>{stories}<a rel='next' href='?2'>more</a>"),
        (2, "http://a/", f"{stories}<a href='?2' class='btn go b@d'> Next  page »</a>"), (3, "http://a/", "<article><h2><a href=x>only one</a></h2></article><a href='?'>下一页</a>"),
        (4, "https://www.cn.nytimes.com/x", f"<div class=sectionWrapper></div>{stories}"), (5, None, None), (6, "http://a/", "<link rel='next' href=y><a class=n href=z>next to nothing</a>"),
    ]
    got = {r.page_id: (r.list_links, r.next_page) for r in pages.suggested_links(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    both = "a[rel='next'], link[rel='next']"
    assert got == {1: ("main article a[href]", both), 2: (".story a[href]", "a.btn.go"), 3: ("", ""), 4: ("h2 a[href], h3 a[href]", ""), 5: ("", ""), 6: ("", both)}


def test_first_arrivals_of_a_stream(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "k string, n int, at timestamp"

    def run(rows):
        spark.createDataFrame(rows, "k string, n int, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = clean.first_stream(spark.readStream.schema(schema).parquet(source), ["k"], "at", "1 hour")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.k, r.n) for r in spark.read.schema(schema).parquet(out).collect())

    assert run([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:05:00"), ("b", 3, "2024-01-01 00:01:00")]) in ([("a", 1), ("b", 3)], [("a", 2), ("b", 3)])
    assert [k for k, _ in run([("a", 4, "2024-01-01 00:30:00"), ("c", 5, "2024-01-01 00:31:00")])] == ["a", "b", "c"]
    plain = clean.first_stream(spark.readStream.schema(schema).parquet(source), ["k"])
    assert plain.isStreaming
