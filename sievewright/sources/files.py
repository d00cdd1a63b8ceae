"""File discovery, sniffing and ordered scans. Every scan adds ``_file``, ``_file_ord`` and a dense ``_row`` from 0 per file."""

from __future__ import annotations

import codecs
import datetime
import fnmatch
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sievewright.functions import encodings
from sievewright.sources import packages, work

# File endings by kind, and the default patterns of discovery.
ENDINGS = {"csv": "csv", "tsv": "csv", "txt": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet"}
INCLUDE = ("*.csv", "*.xlsx", "*.jsonl")
DELIMITERS = ",;\t|"
HEAD_BYTES = 256 << 10
META = ("_file", "_file_ord", "_row", "_bad")


@dataclass(frozen=True)
class Input:
    key: str
    path: str
    order: int

    @property
    def kind(self) -> str:
        return file_kind(self.path)


def file_kind(path: str) -> str:
    ending = path.rpartition(".")[2].lower()
    if ending not in ENDINGS:
        raise ValueError(f"{path}: no reader for this kind of file")
    return ENDINGS[ending]


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discover(spark: SparkSession, roots: list[str], include: tuple[str, ...] = INCLUDE, recursive: bool = True) -> list[Input]:
    """Files under the roots in sorted path order, each once; names starting with a dot are left out. Patterns ignore case."""
    found: dict[str, str] = {}
    for root in roots:
        _, p, fs = _fs(spark, root)
        base = fs.makeQualified(p).toString().rstrip("/")
        if fs.getFileStatus(p).isFile():
            found[base] = os.path.basename(base)
            continue
        listed = fs.listFiles(p, recursive)
        while listed.hasNext():
            path = listed.next().getPath().toString()
            inside = path[len(base) + 1 :]
            if any(part.startswith(".") for part in inside.split("/")):
                continue
            if any(fnmatch.fnmatchcase(os.path.basename(path).lower(), i.lower()) for i in include):
                found.setdefault(path, inside)
    keys, out = Counter(), []
    for order, path in enumerate(sorted(found)):
        key = found[path]
        keys[key] += 1
        out.append(Input(key if keys[key] == 1 else f"{key}#{keys[key]}", path, order))
    return out


def head(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, through Spark's file systems."""
    _, p, fs = _fs(spark, path)
    size = min(n, int(fs.getFileStatus(p).getLen()))
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


# Java's names of encodings; the second kind is open to Spark only by a setting of the session.
OTHER_CHARSETS = {"gb18030": "GB18030", "big5": "Big5", "shift_jis": "Shift_JIS", "euc_jp": "EUC-JP", "euc_kr": "EUC-KR", "cp1252": "windows-1252", "cp1251": "windows-1251"}
JAVA_NAMES = {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"} | OTHER_CHARSETS


def sniff_encoding(raw: bytes) -> str:
    """By byte-order mark, then by NUL bytes, then strict UTF-8 (a cut last character is allowed), else the likeliest encoding."""
    return encodings.sniffed(raw)


def sniff_delimiter(text: str) -> str:
    """The candidate whose lines most often have the same, most fields."""
    lines = [line for line in text.splitlines()[:200] if line.strip()]
    best = (0.0, 0, 0)
    for rank, d in enumerate(DELIMITERS):
        widths = Counter(len(re.sub(r'"[^"]*"', "", line).split(d)) for line in lines)
        width, n = max(widths.items(), key=lambda kv: (kv[1], kv[0])) if widths else (1, 0)
        if width > 1:
            best = max(best, (n / len(lines), width, -rank))
    return DELIMITERS[-best[2]] if best[1] else ","


def normal_headers(names: list[str]) -> list[str]:
    """Headers without byte-order mark and outer space; blanks numbered, repeats marked ``name#2``."""
    out, seen = [], Counter()
    for i, n in enumerate(names, 1):
        n = (n or "").lstrip("\ufeff").strip() or f"column_{i}"
        seen[n] += 1
        out.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return out


def numbered(df: DataFrame, inputs: list[Input]) -> DataFrame:
    """Adds the order columns to a scan that carries ``_path``, ``_block`` (start of the file split) and ``_id``.

    Rows of one split have consecutive ids; each split's first row number is the count of rows in the file's splits
    before it. Only one row a split is shuffled for that.
    """
    splits = df.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_path", "_block", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    files = df.sparkSession.createDataFrame([(i.path, i.key, i.order) for i in inputs], "_p string, _file string, _file_ord int")
    same = F.regexp_replace("_path", "^file:/+", "/") == F.regexp_replace("_p", "^file:/+", "/")
    starts = starts.join(files, same).drop("_p")
    return df.join(starts, ["_path", "_block"]).withColumn("_row", F.col("_start") + F.col("_id") - F.col("_first")).drop("_path", "_block", "_id", "_first", "_start")


def _scan(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def read_csv(spark: SparkSession, inputs: list[Input], delimiter: str | None = None, encoding: str | None = None, multiline: bool = False, header: bool = True) -> DataFrame:
    """Text files of one header as strings; short rows end in "", rows of another width are marked in ``_bad``."""
    raw = head(spark, inputs[0].path)
    encoding = encoding or sniff_encoding(raw)
    text = codecs.getincrementaldecoder(encoding)("replace").decode(raw)
    delimiter = delimiter or sniff_delimiter(text)
    import csv

    first = next(csv.reader(io.StringIO(text), delimiter=delimiter), [])
    names = normal_headers(first) if header else [f"column_{i}" for i in range(1, len(first) + 1)]
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField("_bad", StringType())])
    wide = encoding.startswith(("utf-16", "utf-32"))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "header": str(header).lower(), "enforceSchema": "true", "multiLine": str(multiline or wide).lower(), "encoding": JAVA_NAMES.get(encoding, encoding.upper())}
    if encoding in OTHER_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = spark.read.schema(schema).options(**options).csv([i.path for i in inputs])
    out = numbered(_scan(rows, *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], F.col("_bad").isNotNull().alias("_bad")), inputs)
    return out


def json_keys(spark: SparkSession, path: str, lines: int = 200) -> list[str]:
    """Ordered union of the keys of the first lines."""
    import json

    keys: dict[str, None] = {}
    for line in head(spark, path).decode("utf-8-sig", "replace").splitlines()[:lines]:
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict):
            keys |= dict.fromkeys(record)
    return list(keys)


def read_jsonl(spark: SparkSession, inputs: list[Input], keys: list[str] | None = None) -> DataFrame:
    """One object a line, members as text; ``_bad`` marks lines that are no object, ``_unknown`` counts keys outside the header."""
    keys = keys or json_keys(spark, inputs[0].path)
    lines = _scan(spark.read.text([i.path for i in inputs]), F.regexp_replace("value", "^\ufeff", "").alias("line"))
    members = F.from_json("line", "map<string,string>")
    parsed = lines.filter(F.trim("line") != "").withColumn("m", members).withColumn("_bad", F.col("m").isNull() | ~F.trim("line").startswith("{"))
    known = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    return numbered(parsed.select(*[F.element_at("m", k).alias(k) for k in keys], "_bad", F.size(F.array_except(F.map_keys(F.coalesce("m", F.create_map().cast("map<string,string>"))), known)).alias("_unknown"), "_path", "_block", "_id"), inputs)


def read_parquet(spark: SparkSession, inputs: list[Input]) -> DataFrame:
    """Typed as the files are; row numbers from the files themselves."""
    rows = spark.read.parquet(*[i.path for i in inputs])
    files = spark.createDataFrame([(i.path, i.key, i.order) for i in inputs], "_p string, _file string, _file_ord int")
    scan = rows.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return scan.join(F.broadcast(files.withColumn("_p", F.regexp_replace("_p", "^file:/+", "/"))), F.col("_path") == F.col("_p")).drop("_path", "_p")  # one row a file


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # Fixed values: the built-in number formats that show dates and times


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path inside the workbook) of its sheets, in the order of the tabs."""
    links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = [(s.get("name", ""), links.get(s.get(f"{LINKED}id"), "")) for s in book.iter(f"{NS}sheet")]
    return [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in targets if t]


def sheet_path(z: zipfile.ZipFile, sheet: int | str) -> str:
    parts = sheet_parts(z)
    if isinstance(sheet, str):
        if sheet not in (named := dict(parts)):
            raise ValueError(f"no sheet {sheet!r}")
        return named[sheet]
    if sheet >= len(parts):
        raise ValueError(f"no sheet {sheet} among {len(parts)}")
    return parts[sheet][1]


def date_styles(z: zipfile.ZipFile) -> tuple[set[int], datetime.datetime]:
    """The cell styles that show a number as a date or time, and the day from which the workbook counts."""
    book = ET.fromstring(z.read("xl/workbook.xml")).find(f"{NS}workbookPr")
    start = datetime.datetime(1904, 1, 1) if book is not None and book.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
    if "xl/styles.xml" not in z.namelist():
        return set(), start
    styles = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{NS}numFmt")}
    shown = DATE_FORMATS | {n for n, code in own.items() if re.search("[ymdhs]", code, re.I)}
    cells = styles.find(f"{NS}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in shown}, start


def shown_date(text: str, start: datetime.datetime) -> str:
    """A day number as ISO date, with the time if it has one; a number below one as time; what is no date stays."""
    try:
        number = float(text)
        at = start + datetime.timedelta(seconds=round(number * 86400))
    except (ValueError, OverflowError):
        return text
    if 0 <= number < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d") if number == int(number) else at.strftime("%Y-%m-%d %H:%M:%S")


def sheet_rows(raw: bytes, sheet: int | str = 0) -> Iterator[list[str]]:
    """Cell texts of one sheet (by place or name) of a workbook, row by row, blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{NS}t")))
        dates, start = date_styles(z)
        with z.open(sheet_path(z, sheet)) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{NS}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{NS}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v, kind = c.find(f"{NS}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                    elif v is not None:
                        text = v.text or ""
                        if kind in (None, "n") and int(c.get("s", 0)) in dates:
                            cells[at] = shown_date(text, start)
                        else:
                            cells[at] = shared[int(text)] if kind == "s" else ("true" if text == "1" else "false") if kind == "b" else re.sub(r"\.0$", "", text)
                row.clear()
                if any(cells):
                    yield cells


def read_xlsx(spark: SparkSession, inputs: list[Input], sheet: int | str = 0) -> DataFrame:
    """Workbooks of one header, a file a task (a sheet holds at most 1,048,576 rows)."""
    raw = spark.read.format("binaryFile").load([i.path for i in inputs]).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    first = raw.filter(F.col("path") == re.sub("^file:/+", "/", inputs[0].path)).first()
    names = normal_headers(next(sheet_rows(bytes(first.content), sheet), []))
    order = {re.sub("^file:/+", "/", i.path): (i.key, i.order) for i in inputs}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                key, at = order[path]
                rows, n = [], 0
                for i, cells in enumerate(sheet_rows(bytes(content), sheet)):
                    if i:
                        rows.append([*(cells + [""] * len(names))[: len(names)], len(cells) > len(names), key, at, i - 1])
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[*names, "_bad", "_file", "_file_ord", "_row"])
                        n, rows = n + len(rows), []
                yield pd.DataFrame(rows, columns=[*names, "_bad", "_file", "_file_ord", "_row"])

    from pyspark.sql.types import BooleanType, IntegerType

    schema = StructType([*[StructField(n, StringType()) for n in names], StructField("_bad", BooleanType()), StructField("_file", StringType()), StructField("_file_ord", IntegerType()), StructField("_row", LongType())])
    return raw.repartition(len(inputs)).mapInPandas(run, schema)


READERS = {"csv": read_csv, "jsonl": read_jsonl, "parquet": read_parquet, "xlsx": read_xlsx}


def read(spark: SparkSession, i: list[Input], **options) -> DataFrame:
    return READERS[i[0].kind](spark, i, **options)


RUN_FILES = ("data.xlsx", "data.csv", "data.json", "data.jsonl")


def read_run(spark: SparkSession, path: str, staging: str | None = None) -> DataFrame:
    """The rows of an earlier run's result as text: a JSON array of objects, JSON lines, CSV, a workbook, or a ZIP that holds one of ``RUN_FILES``.

    A ZIP's entry is unpacked into ``staging`` (a folder that executors share; a work folder if not given). An archive without one of these files and a document that is no array
    have no rows.
    """
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "zip":
        folder = (staging or work.new_path(spark, "run-file")).removeprefix("file://")
        found = {e["path"].rsplit("/", 1)[-1]: e["path"] for e in packages.unpacked(path.removeprefix("file://"), folder, frozenset(f".{n.rsplit('.', 1)[-1]}" for n in RUN_FILES))}
        name = next((found[n] for n in RUN_FILES if n in found), None)
        return read_run(spark, f"file://{folder}/{name}") if name else spark.createDataFrame([], StructType([]))
    if ending == "json":
        objects = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.regexp_replace("value", "^\ufeff", ""), "array<string>")).alias("_row", "line"))
        members = objects.filter(F.trim("line").startswith("{")).withColumn("m", F.from_json("line", "map<string,string>"))
        keys = [r[0] for r in members.select(F.posexplode(F.map_keys("m")).alias("at", "k")).groupBy("k").agg(F.min("at").alias("at")).orderBy("at", "k").select("k").collect()]  # one row a column
        return members.select(*[F.element_at("m", k).alias(k) for k in keys], F.col("_row").cast("long"))
    return read(spark, [Input(path.rsplit("/", 1)[-1], path, 0)])


def inspect(spark: SparkSession, item: Input, rows: int = 20, **options) -> dict:
    """Header, sample rows and an estimate of the row count from the sample's mean size."""
    df = read(spark, [item], **options)
    names = [c for c in df.columns if c not in META]
    sample = df.orderBy("_row").limit(rows).collect()
    _, p, fs = _fs(spark, item.path)
    size = int(fs.getFileStatus(p).getLen())
    mean = sum(sum(len(str(r[c] or "")) + 1 for c in names) for r in sample) / len(sample) if sample else 0
    return {"headers": names, "sample": [[r[c] for c in names] for r in sample], "size": size, "estimate": max(0, round(size / mean) - 1) if mean else 0, "formulas": sum(str(r[c] or "")[:1] in "=+-@" and bool(r[c]) for r in sample for c in names)}
