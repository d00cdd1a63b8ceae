"""Files to cleaned rows and back, dry runs, reports and streams."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sievewright.plans import task as plans
from sievewright.plans.config import ConfigError, Constraint, Fallback, FieldSpec, Generate, Op, Task
from sievewright.sources import files, sinks, writers
from sievewright.streaming import clean as streams


def write(folder, name, body, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as f:
        f.write(body.encode(encoding))
    return path


PEOPLE = Task("people", (
    FieldSpec("id", generate=Generate("sequence", start=1, width=3)),
    FieldSpec("name", "name"),
    FieldSpec("age", "age", constraints=(Constraint("type", type="int"), Constraint("range", min_value=0, max_value=100)), fallback=Fallback("truncate")),
    FieldSpec("city", "City", default="none"),
    FieldSpec("label", generate=Generate("expression", expression="${name} of ${city:-nowhere}")),
), (Op(op="trim", field="name"), Op(op="fill_null", field="city", value="Rome")))


def test_csv_end_to_end(spark, tmp_path):
    write(tmp_path, "a.csv", 'name ,age,city\n "  Ann"" ",200,Paris\nBob,x,\n')
    write(tmp_path, "b.CSV", "age,name\n7,Cid\n")
    write(tmp_path, ".hidden.csv", "name\nno\n")
    inputs = files.discover(spark, [str(tmp_path)], ("*.csv",))
    assert [i.key for i in inputs] == ["a.csv", "b.CSV"]
    p = plans.plan(spark, PEOPLE, inputs)
    p.output.write.format("noop").mode("overwrite").save()
    got = [tuple(r[f.dest] for f in PEOPLE.fields) for r in p.result.orderBy("_file_ord", "_row").collect()]
    assert got[1:] == [("002", "Bob", "x", "Rome", "Bob of Rome"), ("001", "Cid", "7", "none", "Cid of none")]
    assert got[0][2:4] == ("100", "Paris")
    assert p.counts()["1:fill_null"]["changed"] == 1
    text = plans.report(p)
    assert "| a.csv | 2 | 2 | 0 |" in text and "regression" in text
    frames = plans.report_frames(p)
    bound = {(r.first_file, r.field): (r.n_files, r.header, r.default) for r in frames["mapping"].collect()}
    assert (bound["a.csv", "city"], bound["b.CSV", "city"], bound["b.CSV", "age"]) == ((1, "city", None), (1, None, "none"), (1, "age", None))
    assert {(r.field, r.kind, r.settings) for r in frames["constraints"].collect()} == {("age", "type", '{"type": "int"}'), ("age", "range", '{"max_value": 100, "min_value": 0}')}
    assert {(r.field, r.kind, r.nth, r._row, r.value) for r in frames["repair samples"].collect()} == {("age", "range", 1, 0, "100"), ("age", "type", 1, 1, "x")}
    assert {(r.field, r.kind, r.n, r.n_empty) for r in frames["generated fields"].collect()} == {("id", "sequence", 3, 0), ("label", "expression", 3, 0)}
    assert plans.dry_run(spark, PEOPLE, inputs, 1) == [dict(zip([f.dest for f in PEOPLE.fields], got[0], strict=True))]
    with pytest.raises(ConfigError):
        plans.plan(spark, Task("t", PEOPLE.fields, layout="union", on_missing="error"), inputs)


def test_mapping_reads_all_sources_first(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string").withColumns({"_file": F.lit("f"), "_file_ord": F.lit(0), "_row": F.lit(0)})
    swapped = plans.mapped(df, Task("t", (FieldSpec("a", "b"), FieldSpec("b", "a"))))
    assert tuple(swapped.select("a", "b").first()) == ("2", "1")
    m = plans.bind(["​Name ", "NAME", "x"], (FieldSpec("n", "name"), FieldSpec("y", "yy")))
    assert (m.sources, m.missing, m.unmapped) == ({"n": "​Name ", "y": None}, ["y"], ["NAME", "x"])


def test_csv_shapes(spark, tmp_path):
    write(tmp_path, "a.csv", "a;b;c\n1;2\n3;4;5;6\n\n007;\"x;y\";z\n")
    item = files.discover(spark, [str(tmp_path)])
    got = files.read_csv(spark, item).orderBy("_row").collect()
    assert [(r.a, r.b, r.c, r._bad) for r in got] == [("1", "2", "", True), ("3", "4", "5", True), ("007", "x;y", "z", False)]
    assert [r._row for r in got] == [0, 1, 2]
    said = files.inspect(spark, item[0])
    assert said["headers"] == ["a", "b", "c"] and len(said["sample"]) == 3


def test_row_numbers_hold_over_splits(spark, tmp_path):
    body = "n\n" + "".join(f"{i}\n" for i in range(20000))
    for name in ("a.csv", "b.csv"):
        write(tmp_path, name, body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = files.read_csv(spark, files.discover(spark, [str(tmp_path)]))
        assert df.rdd.getNumPartitions() > 3
        assert df.filter("n <> _row").count() == 0 and df.count() == 40000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_encodings(spark, tmp_path):
    for name, enc in (("u.csv", "utf-8-sig"), ("g.csv", "gb18030"), ("w.csv", "utf-16")):
        path = write(tmp_path, name, "名,城\n张三,北京\n", enc)
        got = files.read_csv(spark, [files.Input(name, path, 0)]).first()
        assert (got["名"], got["城"]) == ("张三", "北京"), enc
    assert files.sniff_delimiter("a|b|c\n1|2|3\n") == "|" and files.sniff_delimiter('"a,b"\tc\nd\te\n') == "\t"
    assert files.normal_headers(["﻿a ", "", "a"]) == ["a", "column_2", "a#2"]


def test_jsonl(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"a": 1, "b": {"c": [2]}}\n\nnot json\n[1]\n{"b": "x", "zz": 0}\n')
    got = files.read_jsonl(spark, [files.Input("a", path, 0)], ["a", "b"]).orderBy("_row").collect()
    assert [(r.a, r.b, r._bad, r._unknown) for r in got] == [("1", '{"c":[2]}', False, 0), (None, None, True, 0), (None, None, True, 0), (None, "x", False, 1)]


def test_workbooks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<&>", 1.0), (None, 2.5), ("x" * 40000, None)], "s string, n double").coalesce(1)
    path = str(tmp_path / "t.xlsx")
    assert writers.write_xlsx(df, path) == {"rows": 3, "cut": 1}
    assert zipfile.ZipFile(path).testzip() is None
    got = files.read_xlsx(spark, [files.Input("t", path, 0)]).orderBy("_row").collect()
    assert [(r.s[:10], r.n) for r in got] == [("a<&>", "1"), ("", "2.5"), ("x" * 10, "")]


def test_workbook_sheets_by_name_and_shown_dates(spark, tmp_path):
    path, main = str(tmp_path / "t.xlsx"), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="second" sheetId="2" r:id="b"/><sheet name="first" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>x</t></is></c></row><row><c s="1"><v>45352</v></c></row><row><c s="2"><v>45352.5</v></c></row><row><c s="3"><v>45352</v></c></row><row><c s="4"><v>0.25</v></c></row><row><c s="1"><v>1e300</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>y</t></is></c></row><row><c><v>7.0</v></c></row></sheetData></worksheet>')
    item = files.Input("t", path, 0)
    assert [r.x for r in files.read_xlsx(spark, [item], "first").orderBy("_row").collect()] == ["2024-03-01", "2024-03-01 12:00:00", "45352", "06:00:00", "1e300"]
    assert [r.y for r in files.read_xlsx(spark, [item]).collect()] == ["7"]
    with pytest.raises(ValueError):
        files.read_xlsx(spark, [item], "third")


def test_parquet_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 3.0, None), ('q"uote\nline', 0.5, "z")], "a string, n double, m string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "c"), neutral=True)
    body = "".join(open(tmp_path / "c" / f, newline="").read() for f in os.listdir(tmp_path / "c") if f.startswith("part"))
    assert body == 'a,n,m\n\'=1+1,3,\n"q""uote\nline",0.5,z\n'
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert '"m":null' in "".join(open(tmp_path / "j" / f).read() for f in os.listdir(tmp_path / "j") if f.startswith("part"))
    sinks.write_parquet(df, str(tmp_path / "p"))
    inputs = files.discover(spark, [str(tmp_path / "p")], ("*.parquet",))
    back = files.read_parquet(spark, inputs).orderBy("_row").collect()
    assert [(r.a, r.n, r._row, r._file_ord) for r in back] == [("=1+1", "3", 0, 0), ('q"uote\nline', "0.5", 1, 0)]
    assert sinks.append_new(df.select("a", "n"), str(tmp_path / "store"), "a", ["n"]) == {"inserted": 2, "duplicates": 0}
    assert sinks.append_new(df.select("a", "n"), str(tmp_path / "store"), "a", ["n"]) == {"inserted": 0, "duplicates": 2}
    assert sinks.column_names(["A b", "a-b", "名"])["a-b"] == "a_b_2"
    assert sinks.bulk_lines(df, "i", "a").count() == 4
    assert sinks.insert_statements(df.select("a", "m"), "t", "a", 1).count() <= 2


def test_redaction():
    assert plans.redacted("password = abc token:xyz http://u:pw@h/") == "password = *** token:*** http://u:***@h/"


def test_streams(spark, tmp_path):
    src, ckpt = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    schema = "_file_ord int, _row long, k string, v string"
    spark.createDataFrame([(0, 0, "a", "x"), (0, 1, "a", ""), (0, 2, "b", "")], schema).coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    out = str(tmp_path / "out")
    streams.append_first(read(), out, "k", ["_row"], ckpt).awaitTermination(120)
    spark.createDataFrame([(1, 0, "b", "y"), (1, 1, "c", "z")], schema).coalesce(1).write.mode("append").parquet(str(src))
    streams.append_first(read(), out, "k", ["_row"], ckpt).awaitTermination(120)  # a restart goes on from the checkpoint
    got = sorted((r.k, r._file_ord, r._row) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, 0), ("b", 0, 2), ("c", 1, 1)]

    task = Task("t", (FieldSpec("v", "v", constraints=(Constraint("length", max_length=1),)),), (Op(op="upper", field="v"),))
    seen = {}
    streams.batches(read(), task, lambda df, n: seen.setdefault(n, sorted(r.v for r in df.collect())), str(tmp_path / "ck2")).awaitTermination(120)
    assert sorted(v for vs in seen.values() for v in vs) == ["", "", "X", "Y", "Z"]
    with pytest.raises(ConfigError):
        streams.row_stream(read(), Task("t", (FieldSpec("v"),), (Op(op="ffill", field="v"),)))

    q = streams.filled_stream(read().select("k", "_row", "v"), "k", "_row", "v").writeStream.format("memory").queryName("filled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ("a", 1, "x") in {tuple(r) for r in spark.table("filled").collect()}


def test_resumed_runs(spark, tmp_path):
    from sievewright.plans import resume

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    task = Task("t", (FieldSpec("a", "a"),), (Op(op="upper", field="a"),))
    write(src, "1.csv", "a\nx\n")
    assert resume.run(spark, task, files.discover(spark, [str(src)]), out).pending[0].key == "1.csv"
    write(src, "2.csv", "a\ny\n")
    second = resume.run(spark, task, files.discover(spark, [str(src)]), out)
    assert ([i.key for i in second.pending], second.done, second.run) == (["2.csv"], ["1.csv"], 1)
    assert resume.run(spark, task, files.discover(spark, [str(src)]), out).pending == []
    spark.createDataFrame([("dead",)], "a string").write.parquet(f"{out}/run=2")  # a run that died before its commit
    assert sorted(r.a for r in resume.finished(spark, task, out).collect()) == ["X", "Y"]
    with pytest.raises(ConfigError):
        resume.decide(spark, Task("t", (FieldSpec("a", "a"),)), files.discover(spark, [str(src)]), out)
    write(src, "1.csv", "a\nlonger\n")
    with pytest.raises(ConfigError):
        resume.decide(spark, task, files.discover(spark, [str(src)]), out)


def test_tilesets(spark, tmp_path):
    from sievewright.sources import tilesets

    for z, x, y in ((1, 0, 1), (1, 1, 0), (2, 3, 3), (1, 5, 0)):
        folder = tmp_path / "t" / str(z) / str(x)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{y}.png").write_bytes(b"\x89PNG" + bytes([z, x, y]))
    tiles = tilesets.read_folder(spark, str(tmp_path / "t"))
    assert sorted((r.z, r.x, r.y) for r in tiles.collect()) == [(1, 0, 1), (1, 1, 0), (2, 3, 3)]
    meta = writers.write_mbtiles(tiles, str(tmp_path / "t.mbtiles"))
    assert (meta["minzoom"], meta["maxzoom"], meta["format"]) == (1, 2, "png")
    back = tilesets.read_mbtiles(spark, str(tmp_path / "t.mbtiles"))
    assert sorted((r.z, r.x, r.y, r.format, bytes(r.content)[-3:]) for r in back.collect()) == [(z, x, y, "png", bytes([z, x, y])) for z, x, y in ((1, 0, 1), (1, 1, 0), (2, 3, 3))]
