"""Section files of map sheets: four kinds of layers from files, origins, pointers, and what is missing."""

import pytest

from sievewright.sources import sections

HEAD = "sheet\n2\n3\n4\nGJB5068-2004\n6\n"


def write(folder, name, text, encoding="gb18030"):
    (folder / name).write_bytes(text.encode(encoding))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "M1.SMS", "  1   图名      北京 东\r\n  2   相对原点横坐标   1000.5\r\n  3   相对原点纵坐标  -32767\r\n  4   坐标放大系数  2\r\n  5 高斯投影带号 21\r\nno number\r\n")
    write(tmp_path, "M1.ASX", HEAD + "P 2\n1 100 水井 备注 e1 123456789012 e2 P 7 0\n\n2 101 塔 P 8 0\nL 1\n1 200 road - L 9 0\nA 2\n1 300 lake n A 1 0\n2 301 pond n A 2 0\nN 1\n1 400 长江 宋体 左斜 4.5 0 红\n")
    write(tmp_path, "M1.ATP", HEAD + "P 2\n1 70\n2\nL 1\n1 90 x\n")
    write(tmp_path, "M1.AZB", HEAD + "P 2\n1 10 20 0 0\n2 0 0 3 4 5 6\nL 1\n1 3\n1 1 2 2\n3 3\nA 2\n1 7 8 0 4\n0 0 9 0\n9 9 0 9\n2 5 6 0 0\nN 1\n1 1 2 3 4 1 5 6\n".replace("\n", "\r\n"))
    write(tmp_path, "M2.BSX", HEAD + "P 2\n1 100 a b P 7 0\n2 100 a b P 7 0\n")
    write(tmp_path, "M2.BZB", HEAD + "P 1\n1 1.5 2.5\n")
    write(tmp_path, "notes.txt", "not a layer")
    return f"file://{tmp_path}"


def by_place(spark, folder):
    return {(r.sheet, r.layer, r.kind, r.nth): r for r in sections.read_sheets(spark, folder).collect()}


def pairs(points):
    return [(p.x, p.y) for p in points or []]


def test_four_kinds(spark, folder):
    got = by_place(spark, folder)
    assert len(got) == 8
    well, tower, road, lake, pond, note = (got["M1", "A", k, n] for k, n in (("P", 0), ("P", 1), ("L", 0), ("A", 0), ("A", 1), ("N", 0)))
    assert (well.seq, well.code, well.name, well.note, well.gid, well.extra, well.gtype, well.ptr, well.tail, well.pointer) == (1, "100", "水井", "备注", "123456789012", "e1 e2", "P", 7, "0", 70)
    assert (tower.name, tower.note, tower.gid, tower.ptr, tower.pointer) == ("塔", None, None, 8, 0)
    assert pairs([well.anchor]) == [(1020.5, 40)] and pairs(well.points) == [] and pairs([tower.anchor]) == [(1006.5, 8)] and pairs(tower.points) == [(1010.5, 12)]
    assert pairs(road.points) == [(1002.5, 2), (1004.5, 4), (1006.5, 6)] and road.anchor is None and road.pointer == 90
    assert pairs([lake.anchor]) == [(1014.5, 16)] and pairs(lake.points) == [(1000.5, 0), (1018.5, 0), (1018.5, 18), (1000.5, 18)]
    assert pairs([pond.anchor]) == [(1010.5, 12)] and pairs(pond.points) == [] and pond.pointer is None
    assert (note.text, note.font, note.style, note.size, note.color, note.name) == ("长江", "宋体", "左斜", 4.5, "红", None)
    assert pairs([note.anchor]) == [(1002.5, 4)] and pairs(note.points) == [(1006.5, 8), (1010.5, 12)]
    assert {r.crs for k, r in got.items() if k[0] == "M1"} == {"CGCS2000 / Gauss-Kruger zone 21"}


def test_without_metadata_or_partner(spark, folder):
    got = by_place(spark, folder)
    assert pairs([got["M2", "B", "P", 0].anchor]) == [(1.5, 2.5)] and got["M2", "B", "P", 0].crs == "EPSG:4498"
    assert got["M2", "B", "P", 1].anchor is None and got["M2", "B", "P", 1].name == "a"


def test_reference_systems(spark, tmp_path):
    for name, lines in {"A": "1 坐标单位 度\n2 大地基准 CGCS2000", "B": "1 地图投影 经纬度\n2 大地基准 WGS84", "C": "1 高斯投影带号 77", "D": "1 坐标放大系数 -1"}.items():
        write(tmp_path, f"{name}.SMS", lines)
    rows = {r.sheet: r for r in sections.sheets(sections.text_lines(spark, f"file://{tmp_path}")).collect()}
    assert {k: r.crs for k, r in rows.items()} == {"A": "EPSG:4490", "B": "EPSG:4326", "C": "EPSG:4498", "D": "EPSG:4498"} and rows["D"].scale == 1.0


def test_another_format_is_an_error(spark, tmp_path):
    write(tmp_path, "X.ASX", HEAD.replace("5068", "9999") + "P 1\n1 1 a b P 1 0\n")
    with pytest.raises(Exception, match="GJB5068-2004"):
        sections.read_sheets(spark, f"file://{tmp_path}").collect()
