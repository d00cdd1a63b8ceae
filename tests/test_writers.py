"""Writers of single files in parts: whole files or none, order, appends, and flat memory of the driver."""

import os
import resource
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from sievewright.sources import databases, files, work, writers


def staged(spark):
    root = work.shared_dir(spark).removeprefix("file://") + "/sievewright"
    return [n for n in os.listdir(root) if n.startswith("staging")] if os.path.isdir(root) else []


def rows(path, table="t"):
    with sqlite3.connect(path) as db:
        return db.execute(f'SELECT * FROM "{table}"').fetchall()


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    df = spark.range(0, 100, 1, 5).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("ü"), "id")).alias('na"me'), (F.col("id") / 2).alias("d"), F.to_date(F.lit("2024-02-03")).alias("day"), F.lit(b"\0x").alias("raw"))
    assert writers.write_sqlite(df, path, 't "q"') == {"rows": 100}
    got = rows(path, 't ""q""')
    assert got == [(i, f"ü{i}" if i % 3 == 0 else None, i / 2, "2024-02-03", b"\0x") for i in range(100)]  # partition order is row order
    with pytest.raises(FileExistsError):
        writers.write_sqlite(df, path, "t")
    assert writers.write_sqlite(df.limit(3), path, 't "q"', "append") == {"rows": 3} and len(rows(path, 't ""q""')) == 103
    assert writers.write_sqlite(df.limit(0), path, "other", "append") == {"rows": 0} and rows(path, "other") == []
    assert databases.tables(path) == sorted(['t "q"', "other"]) and databases.scan(spark, path, 't "q"').count() == 103
    assert writers.write_sqlite(df.limit(2), path, "t", "overwrite") == {"rows": 2} and databases.tables(path) == ["t"]
    assert os.listdir(tmp_path) == ["a.db"] and not staged(spark)


@pytest.mark.parametrize("write", [lambda df, p: writers.write_sqlite(df, p, "t", "overwrite"), lambda df, p: writers.write_xlsx(df, p, replace=True)])
def test_killed_task_leaves_nothing(spark, tmp_path, write):
    path = str(tmp_path / "a.out")
    good = spark.range(0, 20, 1, 4).select(F.col("id").cast("string").alias("v"))
    write(good, path)
    before = open(path, "rb").read()
    killed = F.udf(lambda v: os._exit(9) if v == "13" else v)
    with pytest.raises(Exception):
        write(good.select(killed("v").alias("v")), path)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["a.out"] and not staged(spark)
    write(good, path)


def test_sheets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.xlsx")
    df = spark.range(0, 50, 1, 4).select("id", F.when(F.col("id") != 7, F.concat(F.lit("<&\x02"), "id")).alias("t"))
    assert writers.write_xlsx(df, path) == {"rows": 50, "cut": 0}
    got = files.read_xlsx(spark, [files.Input("a", path, 0)]).orderBy("_row").collect()
    assert [(r.id, r.t) for r in got] == [(str(i), "" if i == 7 else f"<&{i}") for i in range(50)]
    assert writers.write_xlsx(df.limit(0), path, replace=True) == {"rows": 0, "cut": 0} and zipfile.ZipFile(path).testzip() is None
    with pytest.raises(ValueError):
        writers.write_xlsx(df.select(*[F.lit("x").alias(f"c{i}") for i in range(3)]).select("*", *[F.lit("").alias(f"d{i}") for i in range(writers.SHEET_COLUMNS)]), path)


def test_tiles(spark, tmp_path):
    path = str(tmp_path / "a.mbtiles")
    tiles = spark.createDataFrame([(1, 0, 1, "png", b"a"), (1, 0, 1, "jpg", b"b"), (2, 3, 3, None, b"c")], "z int, x long, y long, format string, content binary").coalesce(1)
    meta = writers.write_mbtiles(tiles, path)
    assert (meta["format"], meta["minzoom"], meta["maxzoom"]) == ("bin", 1, 2) and meta["bounds"].startswith("90.000000,-85.05")
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT * FROM tiles ORDER BY 1").fetchall() == [(1, 0, 0, b"a"), (2, 3, 0, b"c")]
        assert dict(db.execute("SELECT * FROM metadata").fetchall())["maxzoom"] == "2"
    assert writers.write_mbtiles(tiles.limit(0), path, "none", replace=True) == {"name": "none"}


def test_a_million_rows_in_flat_memory(spark, tmp_path):
    path = str(tmp_path / "big.db")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert writers.write_sqlite(spark.range(0, 1_000_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")), path, "t") == {"rows": 1_000_000}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*), sum(id) FROM t").fetchone() == (1_000_000, 499_999_500_000)
