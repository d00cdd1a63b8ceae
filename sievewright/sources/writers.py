"""Single-file formats written in parts: SQLite tables, XLSX workbooks and MBTiles.

Each task writes its rows, batch by batch, into a part of the same kind in a staging folder that driver and executors share (below ``spark.checkpoint.dir``); what it
reports is the part's name and its counts. Only when all tasks are done the driver joins the parts in the order of partitions, one at a time and by bulk copy, never as rows,
and puts the file in place by a rename. A failed job drops the staging folder and leaves the target as it was; parts of lost or repeated attempts are not named by any report.

Cases: null cells stay null in SQLite and are empty in a sheet; an empty table makes a file without rows; of repeated tiles the first in order of partition and row stays; a target that is there is an error
unless replaced or, for SQLite, appended to; more rows or columns than a sheet holds are refused, longer texts are cut and counted.
"""

from __future__ import annotations

import contextlib
import dataclasses
import json
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sievewright.functions import mercator
from sievewright.operators.clean import text_of
from sievewright.sources.work import new_path

SHEET_ROWS, SHEET_COLUMNS, CELL_CHARS = 1_048_576, 16_384, 32_767  # fixed values: what a sheet holds
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


def _copy(source: str, target: str) -> None:
    (a, b), (c, d) = _at(source), _at(target)
    pafs.copy_files(b, d, source_filesystem=a, destination_filesystem=c)


@dataclasses.dataclass
class Part(WriterCommitMessage):
    nth: int
    name: str
    info: dict


class PartWriter(DataSourceArrowWriter):
    """Parts per task, joined on commit. Kinds say how a part is filled and how parts become one file."""

    def __init__(self, options: dict[str, str], columns: list[tuple[str, str]]) -> None:
        self.options, self.columns, self.path, self.staging = options, columns, options["path"], options["staging"]

    def fill(self, local: str, batches: Iterator[pa.RecordBatch]) -> dict:
        raise NotImplementedError

    def join(self, parts: Iterable[tuple[str, dict]], infos: list[dict], local: str) -> dict:
        raise NotImplementedError

    def files(self, local: str) -> list[tuple[str, str]]:
        """What ``join`` has made and where it goes; the last one makes the others count."""
        return [(local, self.path)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId()
        name = f"part-{nth:06d}-{uuid.uuid4().hex}"
        with tempfile.TemporaryDirectory() as own:
            info = self.fill(f"{own}/part", iterator)
            _copy(f"{own}/part", f"{self.staging}/{name}")
        return Part(nth, name, info)

    def commit(self, messages: list[Part]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.nth)
        with tempfile.TemporaryDirectory() as own:

            def parts() -> Iterator[tuple[str, dict]]:
                for m in done:
                    _copy(f"{self.staging}/{m.name}", f"{own}/part")
                    yield f"{own}/part", m.info
                    os.remove(f"{own}/part")

            told = self.join(parts(), [m.info for m in done], f"{own}/whole")
            drafts = [(f"{target}.{uuid.uuid4().hex}", target) for _, target in self.files(f"{own}/whole")]
            for (local, _), (draft, _) in zip(self.files(f"{own}/whole"), drafts, strict=True):
                _copy(local, draft)
        for draft, target in drafts:
            fs, place = _at(target)
            fs.move(_at(draft)[1], place)
        fs, staging = _at(self.staging)
        with fs.open_output_stream(f"{staging}/told.json") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, staging = _at(self.staging)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(staging)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


class SqliteParts(PartWriter):
    """Rows of one table; with ``append`` they are added to the tables of the file that is there."""

    def _create(self, db: sqlite3.Connection, table: str, schema: str = "") -> None:
        kinds = {"long": "INTEGER", "int": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        columns = ", ".join(f"{_name(n)} {kinds.get(t, 'TEXT')}" for n, t in self.columns)
        db.execute(f"CREATE TABLE IF NOT EXISTS {schema}{_name(table)} ({columns})")

    def fill(self, local: str, batches: Iterator[pa.RecordBatch]) -> dict:
        rows = 0
        with contextlib.closing(sqlite3.connect(local)) as db, db:
            self._create(db, "part")
            marks = ", ".join("?" * len(self.columns))
            for b in batches:
                cells = [[_plain(v) for v in c.to_pylist()] for c in b.columns]
                db.executemany(f"INSERT INTO part VALUES ({marks})", zip(*cells, strict=True))
                rows += b.num_rows
        return {"rows": rows}

    def join(self, parts: Iterable[tuple[str, dict]], infos: list[dict], local: str) -> dict:
        table = self.options["table"]
        if self.options.get("append") == "true" and _at(self.path)[0].get_file_info(_at(self.path)[1]).type == pafs.FileType.File:
            _copy(self.path, local)
        with contextlib.closing(sqlite3.connect(local, isolation_level=None)) as db:
            self._create(db, table)
            names = ", ".join(_name(n) for n, _ in self.columns)
            for path, _ in parts:
                db.execute("ATTACH ? AS p", (path,))
                db.execute(f"INSERT INTO {_name(table)} ({names}) SELECT {names} FROM p.part ORDER BY rowid")
                db.execute("DETACH p")
        return {"rows": sum(i["rows"] for i in infos)}


def _plain(v):
    return v if v is None or isinstance(v, int | float | str | bytes) else v.isoformat(" ") if hasattr(v, "hour") else v.isoformat() if hasattr(v, "isoformat") else str(v)


class XlsxParts(PartWriter):
    """Rows of texts as sheet rows; the joined file has one sheet with a header."""

    NAMES = "http://schemas.openxmlformats.org"
    PIECES = {
        "[Content_Types].xml": '<Types xmlns="{0}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="{0}/package/2006/relationships"><Relationship Id="r1" Type="{0}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="{0}/spreadsheetml/2006/main" xmlns:r="{0}/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="{0}/package/2006/relationships"><Relationship Id="r1" Type="{0}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }

    @staticmethod
    def _row(cells: Iterable[str]) -> bytes:
        return ("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", c[:CELL_CHARS]))}</t></is></c>' for c in cells) + "</row>").encode()

    def fill(self, local: str, batches: Iterator[pa.RecordBatch]) -> dict:
        rows = cut = 0
        with open(local, "wb") as out:
            for b in batches:
                for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    cells = ["" if v is None else v for v in line]
                    cut += sum(len(c) > CELL_CHARS for c in cells)
                    rows += 1
                    out.write(self._row(cells))
                if rows >= SHEET_ROWS:
                    raise ValueError("a sheet has at most 1,048,576 rows")
        return {"rows": rows, "cut": cut}

    def join(self, parts: Iterable[tuple[str, dict]], infos: list[dict], local: str) -> dict:
        rows, header = sum(i["rows"] for i in infos), [n for n, _ in self.columns]
        if rows >= SHEET_ROWS:
            raise ValueError("a sheet has at most 1,048,576 rows")
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in self.PIECES.items():
                z.writestr(name, text.format(self.NAMES))
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<worksheet xmlns="{self.NAMES}/spreadsheetml/2006/main"><sheetData>'.encode() + self._row(header))
                for path, _ in parts:
                    with open(path, "rb") as part:
                        shutil.copyfileobj(part, sheet, 1 << 20)
                sheet.write(b"</sheetData></worksheet>")
        return {"rows": rows, "cut": sum(i["cut"] for i in infos) + sum(len(n) > CELL_CHARS for n in header)}


def _around(a: list[float], b: list[float]) -> list[float]:
    """The box (west, south, east, north) around two."""
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


class MbtilesParts(PartWriter):
    """Tiles (z, x, y counted from the south, content, format, and each one's box); metadata comes from the parts' reports."""

    def fill(self, local: str, batches: Iterator[pa.RecordBatch]) -> dict:
        zooms, formats = {}, {}  # the box of each zoom, and the formats in use
        with contextlib.closing(sqlite3.connect(local)) as db, db:
            db.execute("CREATE TABLE part (z integer, x integer, y integer, content blob)")
            for b in batches:
                c = {n: b.column(n).to_pylist() for n in b.schema.names}
                db.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", zip(c["z"], c["x"], c["y"], c["content"], strict=True))
                formats |= dict.fromkeys(c["format"])
                for z, *box in zip(c["z"], c["west"], c["south"], c["east"], c["north"], strict=True):
                    zooms[z] = _around(zooms.get(z, box), box)
        return {"zooms": zooms, "formats": formats}

    def join(self, parts: Iterable[tuple[str, dict]], infos: list[dict], local: str) -> dict:
        zooms, meta = {}, {"name": self.options["title"]}
        for z, box in (x for i in infos for x in i["zooms"].items()):
            zooms[z] = _around(zooms.get(z, box), box)
        if zooms:  # bounds are those of the highest zoom
            meta |= {"format": min(f for i in infos for f in i["formats"]), "minzoom": min(zooms), "maxzoom": max(zooms), "bounds": ",".join(f"{v:.6f}" for v in zooms[max(zooms)])}
        with contextlib.closing(sqlite3.connect(local, isolation_level=None)) as db:
            db.execute("CREATE TABLE metadata (name text, value text)")
            db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
            db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
            db.executemany("INSERT INTO metadata VALUES (?, ?)", [(k, str(v)) for k, v in meta.items()])
            for path, _ in parts:
                db.execute("ATTACH ? AS p", (path,))
                db.execute("INSERT OR IGNORE INTO tiles SELECT z, x, y, content FROM p.part ORDER BY rowid")
                db.execute("DETACH p")
        return meta


class _Files(DataSource):
    kind: type[PartWriter]

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return self.kind(dict(self.options), [(f.name, f.dataType.typeName()) for f in schema.fields])


class SqliteFile(_Files):
    kind = SqliteParts

    @classmethod
    def name(cls):
        return "sqlite_file"


class XlsxFile(_Files):
    kind = XlsxParts

    @classmethod
    def name(cls):
        return "xlsx_file"


class MbtilesFile(_Files):
    kind = MbtilesParts

    @classmethod
    def name(cls):
        return "mbtiles_file"


def _write(df: DataFrame, source: type[_Files], path: str, replace: bool, **options: str) -> dict:
    spark: SparkSession = df.sparkSession
    fs, target = _at(path)
    if not replace and fs.get_file_info(target).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    staging = new_path(spark, "staging")
    at, folder = _at(staging)
    at.create_dir(folder)
    spark.dataSource.register(source)
    try:
        df.write.format(source.name()).options(staging=staging, **options).mode("append").save(path)
        with at.open_input_stream(f"{folder}/told.json") as f:
            return json.loads(f.read())
    finally:
        with contextlib.suppress(FileNotFoundError):
            at.delete_dir(folder)


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "errorifexists") -> dict[str, int]:
    """One table of a SQLite file; ``append`` adds rows to the file's tables, ``overwrite`` replaces the file."""
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    return _write(df, SqliteFile, path, mode != "errorifexists", table=table, append=str(mode == "append").lower())


def write_xlsx(df: DataFrame, path: str, replace: bool = False) -> dict[str, int]:
    """One workbook with one sheet of canonical texts: its rows and the number of cut cells."""
    if len(df.columns) > SHEET_COLUMNS:
        raise ValueError("a sheet has at most 16,384 columns")
    return _write(df.select(*[text_of(df, c).alias(c) for c in df.columns]), XlsxFile, path, replace)


def write_mbtiles(tiles: DataFrame, path: str, name: str = "tiles", replace: bool = False) -> dict:
    """One MBTiles file of (z, x, y, format, content), y counted from the north; gives its metadata."""
    box = mercator.bounds(F.col("x"), F.col("y"), F.col("z"))
    shaped = tiles.select(F.col("z").cast("long").alias("z"), F.col("x").cast("long").alias("x"), mercator.flip_row(F.col("y"), F.col("z")).cast("long").alias("y"), "content", F.coalesce("format", F.lit("bin")).alias("format"), *[v.alias(n) for n, v in box.items()])
    return _write(shaped, MbtilesFile, path, replace, title=name)
