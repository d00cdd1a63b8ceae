"""Shapefiles: round trips of all kinds, bytes by the published format, ranges by offset, and failures."""

import datetime
import os
import struct

import pytest
from pyspark.sql import functions as F

from sievewright.sources import shapefiles

RINGS = shapefiles.RINGS


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] if rings is not None else None, f"ä{i}" if i % 3 else None, i / 4, i % 2 == 0, datetime.date(2024, 1, 1 + i % 28)) for i, rings in enumerate(rows)], f"id int, rings {RINGS}, `a long name of a column` string, real double, flag boolean, day date").repartitionByRange(parts, "id").sortWithinPartitions("id")


def back(spark, path, **options):
    return [(r.nth, r["shape"], [[(p.x, p.y) for p in ring] for ring in r.rings] if r.rings is not None else None, r.id, r["a long nam"], r.real, r.flag, r.day) for r in shapefiles.read(spark, path, **options).orderBy("nth").collect()]


SQUARE, HOLE = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]


@pytest.mark.parametrize(("shape", "rows"), [
    ("point", [[[(i, -i / 2)]] for i in range(25)] + [None]), ("line", [[[(i, 0), (i + 1, 1), (i, 2)]] for i in range(12)] + [[[(0, 0), (1, 1)], [(5, 5), (6, 6)]], None]),
    ("polygon", [[SQUARE], [SQUARE, HOLE], None] * 5), ("points", [[[(1, 2), (3, 4)]], [[(5, 6)]]]),
])
def test_round_trip(spark, tmp_path, shape, rows):
    path = f"{tmp_path}/a.shp"
    assert shapefiles.write(frame(spark, rows), path, shape, "LOCAL_CS") == {"rows": len(rows), "cut": 0}
    want = [(i, shape if r is not None else "null", [[(float(x), float(y)) for x, y in ring] for ring in r] if r is not None else None, i, f"ä{i}" if i % 3 else None, i / 4, i % 2 == 0, datetime.date(2024, 1, 1 + i % 28)) for i, r in enumerate(rows)]
    assert back(spark, path) == want == back(spark, path, range_rows=4)
    assert shapefiles.read(spark, path, 4).rdd.getNumPartitions() == -(-len(rows) // 4)
    assert sorted(os.listdir(tmp_path)) == ["a.cpg", "a.dbf", "a.prj", "a.shp", "a.shx"] and open(f"{tmp_path}/a.prj").read() == "LOCAL_CS"


def test_bytes_of_the_published_format(spark, tmp_path):
    path = f"{tmp_path}/a.shp"
    shapefiles.write(frame(spark, [[SQUARE], [HOLE]]), path, "polygon")
    raw, index = open(path, "rb").read(), open(f"{tmp_path}/a.shx", "rb").read()
    assert struct.unpack(">i20xi", raw[:28]) == (9994, len(raw) // 2) and struct.unpack("<2i4d", raw[28:68]) == (1000, 5, 0, 0, 9, 9)
    entries = [struct.unpack(">2i", index[at : at + 8]) for at in range(100, len(index), 8)]
    assert [struct.unpack(">2i", raw[2 * o : 2 * o + 8]) for o, _ in entries] == [(1, entries[0][1]), (2, entries[1][1])] and 2 * sum(entries[1]) + 8 == len(raw)
    table = open(f"{tmp_path}/a.dbf", "rb").read()
    rows, head, width = struct.unpack("<IHH", table[4:12])
    assert (rows, len(table)) == (2, head + 2 * width + 1) and table[head - 1] == 0x0D


def test_ranges_read_their_bytes_only(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a.shp"
    shapefiles.write(frame(spark, [[[(i, i)]] for i in range(100)]), path, "point")
    asked, plain = [], shapefiles._bytes
    monkeypatch.setattr(shapefiles, "_bytes", lambda p, a, n: asked.append((p[-3:], a, n)) or plain(p, a, n))
    reader = shapefiles._Reader({"path": path, "rangerows": "10"})
    got = list(reader.read(reader.partitions()[7]))
    assert [r[0] for r in got] == list(range(70, 80)) and got[3][2] == [[{"x": 73.0, "y": 73.0}]]
    assert ("shp", 100 + 70 * 28, 280) in asked and ("shx", 100 + 8 * 70, 80) in asked and max(n for _, _, n in asked) < 4000


def test_foreign_files(spark, tmp_path):
    """Heights after the points, another encoding, a deleted row, and no table at all."""
    point_z = struct.pack("<i4d", 11, 1.5, 2.5, 9, 0)
    line_m = struct.pack("<i4d2ii4d", 23, 0, 0, 1, 1, 1, 2, 0, 0, 0, 1, 1) + b"\0" * 32
    records = [point_z, line_m, struct.pack("<i", 0)]
    body, index, at = b"", b"", 50
    for n, r in enumerate(records, 1):
        body += struct.pack(">2i", n, len(r) // 2) + r
        index += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    (tmp_path / "z.shp").write_bytes(b"\0" * 100 + body), (tmp_path / "z.shx").write_bytes(b"\0" * 100 + index)
    got = shapefiles.read(spark, f"{tmp_path}/z.shp").orderBy("nth").collect()
    assert [(r["shape"], r.rings and [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in got] == [("point", [[(1.5, 2.5)]]), ("line", [[(0, 0), (1, 1)]]), ("null", None)] and got[0].asDict().keys() == {"nth", "shape", "rings"}
    fields = struct.pack("<11sc4xBB14x", b"NAME", b"C", 6, 0) + struct.pack("<11sc4xBB14x", b"N", b"N", 5, 2)
    rows = b" " + "汉字".encode("gbk") + b"  " + b" 1.25" + b"*" + b"gone  " + b" 2.00" + b" " + b"      " + b"  ***"
    (tmp_path / "z.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 124, 1, 1, 3, 97, 12) + fields + b"\r" + rows), (tmp_path / "z.cpg").write_text("GBK")
    assert [(r.NAME, r.N) for r in shapefiles.read(spark, f"{tmp_path}/z.shp").orderBy("nth").collect()] == [("汉字", 1.25), (None, None), (None, None)]


def test_cut_cells_empty_frames_and_failures(spark, tmp_path):
    path = f"{tmp_path}/a.shp"
    long = spark.createDataFrame([([[{"x": 1.0, "y": 2.0}]], "é" * 200)], f"rings {RINGS}, t string")
    assert shapefiles.write(long, path, "point") == {"rows": 1, "cut": 1} and shapefiles.read(spark, path).first().t == "é" * 127
    before = open(path, "rb").read()
    bad = long.withColumn("t", F.udf(lambda v: 1 / 0)("t"))
    with pytest.raises(Exception):
        shapefiles.write(bad, path, "point", replace=True)
    with pytest.raises(FileExistsError):
        shapefiles.write(long, path, "point")
    assert open(path, "rb").read() == before and len(os.listdir(tmp_path)) == 5
    assert shapefiles.write(long.limit(0), path, "line", replace=True) == {"rows": 0, "cut": 0} and shapefiles.read(spark, path).count() == 0
    for shape, name in (("circle", path), ("point", f"{tmp_path}/a.txt")):
        with pytest.raises(ValueError):
            shapefiles.write(long, name, shape)
