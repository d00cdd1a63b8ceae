"""Shapefiles (ESRI's published format) as a data source and as a target: partitions are ranges of records found through the index file.

``read`` cuts the records into ranges; a task reads its entries of the index (.shx), then only its bytes of geometry (.shp) and attributes (.dbf). A row has ``nth`` (from 0), ``shape``
(point, line, polygon, points or null), ``rings`` (parts of points; a point is one part of one), and the table's columns. Heights and measures are passed over. ``write`` joins the parts of tasks,
as all writers of ``sources.writers`` do: bytes of records are copied, only their numbers and offsets are set anew.

Cases: a missing table gives no columns, a missing index is an error; deleted table rows keep their geometry and have null attributes; texts longer than their field are cut at a character and counted; null
geometry is a null shape; numbers that do not fit are null; an empty frame makes an empty file.
"""

from __future__ import annotations

import datetime
import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievewright.sources.writers import PartWriter, _at, _Files, _write

RANGE_ROWS = 50_000
SHAPES = {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "points"}  # fixed values: codes; 10 and 20 more with heights or measures
CODES = {v: k for k, v in SHAPES.items()}
RINGS = "array<array<struct<x:double,y:double>>>"
TEXT, WHOLE, REAL = 254, 19, 24  # widths of table fields


def _bytes(path: str, start: int, n: int) -> bytes:
    fs, place = _at(path)
    with fs.open_input_file(place) as f:
        f.seek(start)
        return f.read(n)


def _there(path: str) -> bool:
    fs, place = _at(path)
    return fs.get_file_info(place).is_file


def _size(path: str) -> int:
    fs, place = _at(path)
    return fs.get_file_info(place).size


@dataclass
class Table:
    """A table file's header: rows, bytes of the header and of a row, and fields (name, type, width, decimals)."""

    rows: int
    head: int
    width: int
    fields: list[tuple[str, str, int, int]]
    encoding: str


def _table(stem: str) -> Table | None:
    if not _there(f"{stem}.dbf"):
        return None
    rows, head, width = struct.unpack("<IHH", _bytes(f"{stem}.dbf", 4, 8))
    raw, fields = _bytes(f"{stem}.dbf", 32, head - 32), []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    named = _bytes(f"{stem}.cpg", 0, 40).decode("ascii", "ignore").strip() if _there(f"{stem}.cpg") else ""
    encoding = {"": "latin-1", "65001": "utf-8"}.get(named, named)
    return Table(rows, head, width, fields, encoding)


def _kind(kind: str, width: int, decimals: int) -> str:
    return {"N": "bigint" if not decimals and width <= 19 else "double", "F": "double", "L": "boolean", "D": "date"}.get(kind, "string")


def _cell(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding, "replace").rstrip(" \0")
    if kind == "string":
        return text or None
    text = text.strip()
    try:
        if kind == "date":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        return {"bigint": int, "double": float, "boolean": lambda v: {"T": True, "Y": True, "F": False, "N": False}[v.upper()]}[kind](text)
    except (ValueError, KeyError):
        return None


def shape_of(raw: bytes) -> tuple[str, list[list[dict]] | None]:
    """Kind and parts of a record's content."""
    code = struct.unpack_from("<i", raw)[0]
    kind = SHAPES.get(code % 10, "null")
    points = lambda at, n: [{"x": x, "y": y} for x, y in np.frombuffer(raw, "<f8", 2 * n, at).reshape(-1, 2).tolist()]
    if kind == "null":
        return kind, None
    if kind == "point":
        return kind, [points(4, 1)]
    if kind == "points":
        return kind, [points(40, struct.unpack_from("<i", raw, 36)[0])]
    parts, n = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    whole = points(44 + 4 * parts, n)
    return kind, [whole[a:b] for a, b in zip(starts, starts[1:])]


@dataclass
class Range(InputPartition):
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.stem, self.step = options["path"].rsplit(".", 1)[0], int(options.get("rangerows", RANGE_ROWS))

    def partitions(self) -> list[Range]:
        n = max(0, (_size(f"{self.stem}.shx") - 100) // 8)
        return [Range(a, min(n, a + self.step)) for a in range(0, n, self.step)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.start == part.end:
            return
        table = _table(self.stem)
        index = np.frombuffer(_bytes(f"{self.stem}.shx", 100 + 8 * part.start, 8 * (part.end - part.start)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        low, high = int(index[:, 0].min()), int((index[:, 0] + 8 + index[:, 1]).max())
        raw = _bytes(f"{self.stem}.shp", low, high - low)
        rows = _bytes(f"{self.stem}.dbf", table.head + table.width * part.start, table.width * (part.end - part.start)) if table else b""
        for i, (offset, size) in enumerate(index.tolist()):
            at = offset - low + 8
            row = rows[i * table.width : (i + 1) * table.width] if table else b""
            cells, place = [], 1
            for _, kind, width, decimals in table.fields if table else ():
                own = row[place : place + width]
                cells.append(_cell(own, _kind(kind, width, decimals), table.encoding) if own and row[:1] != b"*" else None)
                place += width
            yield (part.start + i, *shape_of(raw[at : at + size]), *cells)


class Shapefile(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        table = _table(self.options["path"].rsplit(".", 1)[0])
        more = "".join(f", `{n}` {_kind(k, w, d)}" for n, k, w, d in table.fields) if table else ""
        return f"nth bigint, shape string, rings {RINGS}{more}"

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("rangeRows", str(range_rows)).load(path)


def content(kind: str, rings: list[list[dict]] | None) -> bytes:
    """A record's content of this kind; null without points."""
    parts = [np.array([(p["x"], p["y"]) for p in ring], "<f8").reshape(-1, 2) for ring in rings or () if ring]
    if not parts:
        return struct.pack("<i", 0)
    whole = np.concatenate(parts)
    if kind == "point":
        return struct.pack("<i", 1) + whole[:1].tobytes()
    box = struct.pack("<4d", *whole.min(axis=0), *whole.max(axis=0))
    if kind == "points":
        return struct.pack("<i", 8) + box + struct.pack("<i", len(whole)) + whole.tobytes()
    starts = np.cumsum([0, *map(len, parts[:-1])]).astype("<i4").tobytes()
    return struct.pack("<i", CODES[kind]) + box + struct.pack("<2i", len(parts), len(whole)) + starts + whole.tobytes()


class ShapeParts(PartWriter):
    """Parts hold records, their sizes and table rows; joined to .shp, .shx, .dbf, .cpg and .prj."""

    def _fields(self) -> list[tuple[str, str, str, int, int]]:
        """(column, field name, type, width, decimals) of the attributes; names have ten bytes and are distinct."""
        out, taken = [], set()
        for n, t in self.columns:
            if n == "rings":
                continue
            short, k = n.encode("ascii", "replace").decode().replace("?", "_")[:10], 1
            while short.upper() in taken:
                k += 1
                short = f"{short[: 9 - len(str(k))]}_{k}"
            taken.add(short.upper())
            kind = {"long": ("N", WHOLE, 0), "integer": ("N", 11, 0), "short": ("N", 6, 0), "byte": ("N", 4, 0), "double": ("F", REAL, 15), "float": ("F", REAL, 15), "boolean": ("L", 1, 0), "date": ("D", 8, 0)}.get(t, ("C", TEXT, 0))
            out.append((n, short, *kind))
        return out

    @staticmethod
    def _shown(v, kind: str, width: int) -> tuple[bytes, bool]:
        if v is None:
            return b" " * width if kind != "L" else b"?", False
        if kind == "L":
            return b"T" if v else b"F", False
        if kind == "D":
            return v.strftime("%Y%m%d").encode(), False
        raw = (repr(float(v)) if kind == "F" else str(v)).encode()
        if kind != "C":
            return (raw.rjust(width), False) if len(raw) <= width else (b" " * width, True)
        cut = raw[:width].decode("utf-8", "ignore").encode()
        return cut.ljust(width), len(raw) > width

    def fill(self, local: str, batches: Iterator[pa.RecordBatch]) -> dict:
        fields, kind, sizes, cut = self._fields(), self.options["shape"], [], 0
        box = np.array([np.inf, np.inf, -np.inf, -np.inf])
        with zipfile.ZipFile(local, "w", zipfile.ZIP_STORED) as z, open(f"{local}.dbf", "wb") as rows:
            with z.open("shp", "w", force_zip64=True) as shp:
                for b in batches:
                    columns = {n: b.column(n).to_pylist() for n in b.schema.names}
                    for i in range(b.num_rows):
                        raw = content(kind, columns["rings"][i])
                        for ring in columns["rings"][i] or ():
                            for p in ring or ():
                                box = np.concatenate([np.minimum(box[:2], (p["x"], p["y"])), np.maximum(box[2:], (p["x"], p["y"]))])
                        sizes.append(len(raw))
                        shp.write(struct.pack(">2i", 0, len(raw) // 2) + raw)
                        told = [self._shown(columns[n][i], k, w) for n, _, k, w, _ in fields]
                        cut += sum(c for _, c in told)
                        rows.write(b" " + b"".join(t for t, _ in told))
            rows.flush()
            z.writestr("sizes", np.array(sizes, "<i8").tobytes())
            z.write(f"{local}.dbf", "dbf")
        return {"rows": len(sizes), "cut": cut, "box": box.tolist()}

    def join(self, parts: Iterable[tuple[str, dict]], infos: list[dict], local: str) -> dict:
        total, fields, nth, at = sum(i["rows"] for i in infos), self._fields(), 0, 100
        boxes = np.array([i["box"] for i in infos if i["rows"]] or [[0.0] * 4])
        box = [*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)]
        box = [v if np.isfinite(v) else 0.0 for v in box]
        width = 1 + sum(w for *_, w, _ in fields)
        with open(f"{local}.shp", "wb") as shp, open(f"{local}.shx", "wb") as shx, open(f"{local}.dbf", "wb") as dbf:
            shp.write(b"\0" * 100), shx.write(b"\0" * 100)
            today = datetime.date.today()
            dbf.write(struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, total, 33 + 32 * len(fields), width))
            for _, name, kind, w, d in fields:
                dbf.write(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), w, d))
            dbf.write(b"\r")
            for path, _ in parts:
                with zipfile.ZipFile(path) as z:
                    sizes = np.frombuffer(z.read("sizes"), "<i8")
                    with z.open("shp") as body:
                        for a in range(0, len(sizes), 10_000):  # records of a bounded number at a time
                            some = sizes[a : a + 10_000]
                            starts = np.concatenate([[0], np.cumsum(some + 8)[:-1]])
                            raw = np.frombuffer(body.read(int((some + 8).sum())), np.uint8).copy()
                            numbers = np.arange(nth + 1, nth + 1 + len(some), dtype=">i4").view(np.uint8).reshape(-1, 4)
                            raw[starts[:, None] + np.arange(4)] = numbers
                            shp.write(raw.tobytes())
                            shx.write(np.stack([(at + starts) // 2, some // 2], axis=1).astype(">i4").tobytes())
                            nth, at = nth + len(some), at + int((some + 8).sum())
                    with z.open("dbf") as rows:
                        while piece := rows.read(1 << 20):
                            dbf.write(piece)
            dbf.write(b"\x1a")
            for f, size in ((shp, at), (shx, 100 + 8 * total)):
                f.seek(0)
                f.write(struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i4d32x", 1000, CODES[self.options["shape"]], *box))
        for ending, text in (("cpg", "UTF-8"), ("prj", self.options.get("crs", ""))):
            with open(f"{local}.{ending}", "w", encoding="utf-8") as f:
                f.write(text)
        return {"rows": total, "cut": sum(i["cut"] for i in infos)}

    def files(self, local: str) -> list[tuple[str, str]]:
        stem = self.path.rsplit(".", 1)[0]
        return [(f"{local}.{e}", f"{stem}.{e}") for e in ("prj", "cpg", "dbf", "shx", "shp")]


class ShapefileTarget(_Files):
    kind = ShapeParts

    @classmethod
    def name(cls):
        return "shapefile_parts"


def write(df: DataFrame, path: str, shape: str, crs: str = "", replace: bool = False) -> dict[str, int]:
    """One shapefile (path ends in .shp) of the frame's ``rings`` and other columns: its rows and the number of cut or lost cells. ``crs`` is the text of the .prj file."""
    if shape not in ("point", "line", "polygon", "points") or not path.endswith(".shp"):
        raise ValueError("shape is point, line, polygon or points, and the path ends in .shp")
    shaped = df.select(*[F.col(c).cast(RINGS).alias(c) if c == "rings" else F.col(f"`{c}`") for c in df.columns])
    return _write(shaped, ShapefileTarget, path, replace, shape=shape, crs=crs)
