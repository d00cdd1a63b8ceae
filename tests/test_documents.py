"""JSON paths and conversions, selectors, byte decoding, databases and archives."""

import json
import sqlite3
import zipfile

import pytest

from pyspark.sql import functions as F

from sievewright import catalog
from sievewright.functions import cells, encodings, patterns
from sievewright.operators import documents, pages
from sievewright.sources import databases, packages, sinks

DOC = {"items": [{"price": 8, "title": "a"}, {"price": 30, "title": "b", "tags": ["x", "y"]}, {"price": 12, "title": "c", "sold": True}], "a.b": None, "deep": {"price": 1}}


@pytest.mark.parametrize("path, want", [
    ("$", [DOC]), ("$.items[*].price", [8, 30, 12]), ("$['a.b']", [None]), ("$..price", [8, 30, 12, 1]), ("$.items[0,2].title", ["a", "c"]), ("$.items[-1].title", ["c"]),
    ("$.items[1:].title", ["b", "c"]), ("$.items[::2].title", ["a", "c"]), ("$.items[?(@.price<25)].title", ["a", "c"]), ("$.items[?(@.sold)].title", ["c"]), ("$.items[?(!@.sold && @.price >= 30)].title", ["b"]),
    ("$.items[?(@.title=='a' || @.tags[0]=='x')].price", [8, 30]), ("$..tags[*]", ["x", "y"]), ("$.none", []), ("$.deep.*", [1]), ("$..[?(@.title=='c')].price", [12]), ("$.items[?(@.price > 'a')]", []),
])
def test_json_path(spark, path, want):
    rows = spark.createDataFrame([(1, json.dumps(DOC)), (2, "not json"), (3, None), (4, '{"a":1,"a":2}')], "k long, d string")
    got = sorted(documents.json_query(rows, "k", "d", path).collect(), key=lambda r: r.nth)
    assert [json.loads(r.value) for r in got] == want and all(r.k == 1 and r.n_matches == len(want) for r in got)
    for r in got:
        at = DOC
        for part in r.pointer.split("/")[1:]:
            at = at[int(part)] if isinstance(at, list) else at[part.replace("~1", "/").replace("~0", "~")]
        assert at == json.loads(r.value)


@pytest.mark.parametrize("path", ["items", "$.a[", "$[?(@.a ! 3)]", "$[?(__import__('os'))]", "$[1:5:-1]", "$.a b c["])
def test_wrong_paths_are_refused(spark, path):
    with pytest.raises(ValueError):
        documents.json_query(spark.createDataFrame([(1, "{}")], "k long, d string"), "k", "d", path)


def test_a_report_is_cut_but_counted(spark):
    got = documents.json_query(spark.createDataFrame([(1, json.dumps(list(range(20))))], "k long, d string"), "k", "d", "$[*]", most=5).collect()
    assert len(got) == 5 and {r.n_matches for r in got} == {20}


def test_conversions(spark):
    rows = spark.createDataFrame([('[{"b": "=1+1", "a": {"x": [1, null]}}, {"a": "q\\"\\n"}]',), ('{"b": "x  y", "a": 1}',), ("no",), (None,)], "d string")
    csv, yaml, text = ([r[0] for r in rows.select(documents.converted(F.col("d"), f)).collect()] for f in ("csv", "yaml", "json"))
    assert csv == ['"b","a"\r\n"\'=1+1","{""x"":[1,null]}"\r\n"","q""\n"', None, None, None]
    assert yaml[1] == "b: x  y\na: 1\n" and yaml[2:] == [None, None] and json.loads(text[1]) == {"b": "x  y", "a": 1} and "\n" in text[1]
    assert [r[0] for r in rows.select(documents.minified(F.col("d"))).collect()][1:] == ['{"b":"x  y","a":1}', None, None]
    assert [r[0] for r in rows.select(documents.sorted_keys(F.col("d"))).collect()][1:] == ['{"a":1,"b":"x  y"}', None, None]
    with pytest.raises(ValueError):
        documents.converted(F.col("d"), "xml")


PAGE = """<html><head><title> The title </title><meta property="og:title" content="OG"><meta name='author' content="Ann"></head><body><nav><a href="/x">x</a></nav>
<article class="main big" id=one data-n="12"><h2>Head</h2><p>First <b>bold</b><p>Second<script>no()</script><br><img data-src="i/1.png"><img src="i/1.png"><img src="/2.png"></article><time datetime="2024-01-02">today</time></body></html>"""


@pytest.mark.parametrize("css, want", [
    ("article p", ["First bold", "Second"]), ("article > p b", ["bold"]), (".main.big h2", ["Head"]), ("#one > h2", ["Head"]), ("[data-n='12'] h2", ["Head"]), ("article[data-n^=1] h2, title", ["The title", "Head"]),
    ("meta[name=author]", [""]), ("body > b", []), ("h5", []), ("article[class~='big'] > h2", ["Head"]), ("p", ["First bold", "Second"]),
])
def test_selectors(css, want):
    assert [n.text() for n in pages.select(pages._Tree(PAGE).root, pages.selector(css))] == want


def test_page_fields(spark):
    rows = spark.createDataFrame([(1, "https://h.org/a/b", PAGE), (2, "https://h.org/", ""), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.page_fields(rows, ["title", "author", "published_at", "image", "url", "source", {"name": "n", "selector": "article", "attribute": "data-n"}]).collect()}
    assert tuple(got[1])[1:] == ("OG", "Ann", "2024-01-02", "https://h.org/a/i/1.png\nhttps://h.org/2.png", "https://h.org/a/b", "h.org", "12")
    assert tuple(got[2])[1:] == ("", "", "", "", "https://h.org/", "h.org", "") and tuple(got[3])[1:] == ("",) * 7
    said = {(r.name, r.selector, r.attribute) for r in pages.suggested_fields(rows).filter("page_id = 1").collect()}
    assert said == {("title", "meta[property='og:title']", "content"), ("description", "article p", "text"), ("author", "meta[name='author']", "content"), ("published_at", "time", "datetime"), ("content", "article", "text"), ("image", "article img", "text")}
    with pytest.raises(ValueError):
        pages.page_fields(rows, [{"name": "x", "selector": "a::before"}])


def test_page_fields_named_references(spark):
    page = '<article><h1>a &lt;b&gt; &amp;lt; &amp;&amp &quot;c&quot; &#65;\n &eacute <i>d</i></h1><p title="&quot;&amp;"></p></article>'
    rows = spark.createDataFrame([(1, "http://a", page)], "page_id long, url string, html string")
    fields = [{"name": "h", "selector": "h1"}, {"name": "p", "selector": "p", "attribute": "title"}]
    assert [tuple(r) for r in pages.page_fields(rows, fields).collect()] == [(1, 'a <b> &lt; && "c" A é d', '"&')]
    assert [tuple(r) for r in pages.page_fields(rows, fields, ("lt", "gt", "amp")).collect()] == [(1, "a <b> &lt; &&amp &quot;c&quot; &#65; &eacute d", "&quot;&")]
    assert [tuple(r) for r in pages.page_fields(rows, fields, ()).collect()] == [(1, "a &lt;b&gt; &amp;lt; &amp;&amp &quot;c&quot; &#65; &eacute d", "&quot;&amp;")]


def test_page_headings_cut_references(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    heads = ["all&amp;&amp;&amp", "token = &quot;73ab99", "a &lt; b &gt; c &amp;lt;", "x  &#39;y\n z&nbsp;", ""]
    rows = [(i, "http://a", f"<nav><h2>n</h2></nav><article><h1>{h}</h1><p>t &amp; u</p></article>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.connect().execute(catalog.ORACLE_SQL["page_headings"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["page_headings"](spark, str(tmp_path)).collect())) == sorted(want)


def test_bytes_are_decoded(spark):
    text = "汉字新闻 and more"
    forms = [(text.encode("gb18030"), ""), (b"<meta charset=gbk>" + text.encode("gbk"), ""), (text.encode("utf-8-sig"), ""), (text.encode("utf-16"), ""), (text.encode("utf-8"), "text/html; charset=iso-8859-1"), (text.encode("big5", "ignore"), "text/html; charset=big5")]
    got = [r[0] for r in spark.createDataFrame(forms, "b binary, h string").select(encodings.decoded(F.col("b"), F.col("h"))).collect()]
    assert all(g.endswith(" and more") for g in got) and [g.endswith(text) for g in got[:5]] == [True] * 5


def test_modes_of_presentation(spark):
    rows = spark.createDataFrame([("long", "t", "x" * 300, ""), ("cards", "t", "short", "i.png"), ("table", None, "short", "i.png")], "k string, title string, content string, image string")
    assert {r.k: r.mode for r in pages.presentation(rows, "k").collect()} == {"long": "article", "cards": "cards", "table": "table"}
    assert {r.mode for r in pages.presentation(rows, "k", "twitter").collect()} == {"social"} and {r.mode for r in pages.presentation(rows, "k", "youtube").collect()} == {"video"}


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/a b.db"
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "odd ""name" (id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL, raw BLOB, n INT)')
    con.execute("CREATE TABLE empty (x TEXT)")
    con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    con.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?, ?)', [(i, f"n{i}", i / 2, bytes([i % 250]), "x" if i == 7 else i) for i in range(0, 1000, 3)])
    con.execute("INSERT INTO keyed VALUES ('a', 1)")
    con.commit(), con.close()
    assert databases.tables(path) == ["empty", "keyed", 'odd "name']
    assert databases.schema(path, 'odd "name')[:2] == [{"name": "id", "type": "INTEGER", "primary_key": True, "nullable": False}, {"name": "name", "type": "TEXT", "primary_key": False, "nullable": False}]
    with pytest.raises(LookupError):
        databases.schema(path, "none")
    df = databases.scan(spark, path, 'odd "name', range_rows=100)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("raw", "binary"), ("n", "bigint")] and df.rdd.getNumPartitions() == 10
    rows = df.orderBy("id").collect()
    assert len(rows) == 334 and tuple(rows[1]) == (3, "n3", 1.5, b"\x03", 3) and databases.scan(spark, path, "empty").count() == 0
    assert databases.scan(spark, path, "keyed").collect()[0].k == "a"
    assert [r.id for r in databases.page(df, ["id"], limit=2, offset=3).collect()] == [9, 12]
    assert databases.export_document(spark, path, f"{tmp_path}/out.zip") == {"tables": 3, "rows": 335}
    packages.unpacked(f"{tmp_path}/out.zip", f"{tmp_path}/in")
    back = databases.backup_tables(spark, f"{tmp_path}/in/database.json")
    assert sorted(back) == ["empty", "keyed", 'odd "name'] and back['odd "name'].count() == 334 and back["empty"].count() == 0
    assert back['odd "name'].filter("id = '3'").select("name", "price", "raw").first() == ("n3", "1.5", "03")


def test_archives(tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/in.zip", "w") as z:
        z.writestr("a/x.csv", "n\n1\n"), z.writestr("b\\y.JSONL", "{}"), z.writestr("virus.exe", "no")
    assert packages.unpacked(f"{tmp_path}/in.zip", f"{tmp_path}/in") == [{"path": "a/x.csv", "size": 4}, {"path": "b/y.JSONL", "size": 2}]
    for name in ("../x.csv", "/x.csv", "C:/x.csv"):
        with zipfile.ZipFile(f"{tmp_path}/bad.zip", "w") as z:
            z.writestr(name, "n")
        with pytest.raises(ValueError):
            packages.unpacked(f"{tmp_path}/bad.zip", f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        packages.unpacked(f"{tmp_path}/in.zip", f"{tmp_path}/in", entries=2)
    (tmp_path / "in" / "_SUCCESS").write_text("")
    assert packages.packed(f"{tmp_path}/out.zip", f"{tmp_path}/in", report__txt="fine") == ["a/x.csv", "b/y.JSONL", "report.txt"]
    with zipfile.ZipFile(f"{tmp_path}/out.zip") as z:
        assert sorted(z.namelist()) == ["a/x.csv", "b/y.JSONL", "report.txt"] and z.read("report.txt") == b"fine"


def test_edge_statements(spark):
    rows = spark.createDataFrame([("a", 'b"x', 0, "1"), ("b", "c", None, None)], "s string, d string, rank long, w string")
    text = " ".join(r.statement for r in sinks.edge_statements(rows, "knows").collect())
    assert text.startswith("INSERT EDGE `knows`(`w`) VALUES ") and '"a"->"b\\"x"@0:("1")' in text and '"b"->"c"@0:("")' in text


def test_patterns_in_javas_words():
    assert patterns.java(r"(?P<a_b>x)(?P=a_b)\\Z\Z") == r"(?<g1>x)\k<g1>\\Z\z"
    with pytest.raises(ValueError):
        patterns.java(r"(a)?(?(1)b|c)")
    assert patterns.ambiguous("(a|b)*c") and not patterns.ambiguous("(a|b)c*")


def test_large_numbers(spark):
    rows = [("1e25", "10000000000000000000000000.00"), ("123456789012345678901234", "123456789012345678901234.00"), ("-5", "-5.00"), ("1e400", None), ("x", None), ("0.005", "0.01"), ("99999999999999999999999999999999999999", "99999999999999999999999999999999999999.00")]
    got = spark.createDataFrame(rows, "v string, w string").select("w", cells.number_text(F.col("v"), 2).alias("t"), cells.number_text(F.col("v"), 0, thousands=True).alias("g")).collect()
    assert [r.t for r in got] == [r.w for r in got] and got[1].g == "123,456,789,012,345,678,901,234"
