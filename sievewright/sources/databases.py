"""Tables of SQLite files and of databases behind JDBC: lists, schemas, partitioned scans, pages, and whole-database documents.

SQLite is read by a Python data source (``spark.read.format("sqlite_table")``): the driver cuts the table into ranges of
row ids and tasks read them, so the file must be reachable by every executor.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import sqlite3
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievewright.sources.work import new_path

RANGE_ROWS = 100_000
PAGE_ROWS = 1_000_000  # the largest page that may be asked for


def _named(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


@contextlib.contextmanager
def _open(path: str) -> Iterator[sqlite3.Connection]:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        yield con
    finally:
        con.close()


def tables(path: str) -> list[str]:
    with _open(path) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]


def schema(path: str, table: str) -> list[dict]:
    """name, type, primary_key and nullable of every column."""
    with _open(path) as con:
        found = con.execute(f"PRAGMA table_info({_named(table)})").fetchall()
    if not found:
        raise LookupError(f"no table {table!r}")
    return [{"name": name, "type": kind, "primary_key": bool(key), "nullable": not needed and not key} for _, name, kind, needed, _, key in found]


def _spark_type(kind: str) -> str:
    """By SQLite's own rules of column affinity."""
    kind = kind.upper()
    return "bigint" if "INT" in kind else "string" if any(k in kind for k in ("CHAR", "CLOB", "TEXT")) else "binary" if "BLOB" in kind else "double" if any(k in kind for k in ("REAL", "FLOA", "DOUB")) else "string"


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, types: list[str]):
        self.path, self.table, self.types = options["path"], options["table"], types
        self.rows = int(options.get("rangerows", RANGE_ROWS))

    def partitions(self):
        with _open(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read as one
                return [_Range(None, None)]
        return [_Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)] if low is not None else [_Range(0, 0)]

    def read(self, partition):
        kinds = {"bigint": int, "double": float, "string": str, "binary": bytes}

        def value(v, kind):
            if v is None or isinstance(v, kinds[kind]):
                return v
            if kind == "string":
                return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
            try:
                return str(v).encode() if kind == "binary" else kinds[kind](v)
            except ValueError:
                return None

        where = "" if partition.low is None else f" WHERE rowid >= {int(partition.low)} AND rowid < {int(partition.high)}"
        with _open(self.path) as con:
            for row in con.execute(f"SELECT * FROM {_named(self.table)}{where}"):
                yield tuple(value(v, t) for v, t in zip(row, self.types, strict=True))


class SqliteTable(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_table"

    def _types(self) -> list[tuple[str, str]]:
        return [(c["name"], _spark_type(c["type"])) for c in schema(self.options["path"], self.options["table"])]

    def schema(self):
        return ", ".join(f"`{n}` {t}" for n, t in self._types())

    def reader(self, schema):
        return _Reader(dict(self.options), [t for _, t in self._types()])


def scan(spark: SparkSession, path: str, table: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("table", table).option("rangeRows", str(range_rows)).load(path)


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """Names of a PostgreSQL database's public tables (its driver jar must be on the class path)."""
    return spark.read.jdbc(url, "(SELECT tablename AS name FROM pg_catalog.pg_tables WHERE schemaname = 'public') t", properties=properties).orderBy("name")


def jdbc_scan(spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str | None = None, parts: int = 16) -> DataFrame:
    """A table behind JDBC, in ``parts`` ranges of a numeric column if one is named."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    low, high = spark.read.jdbc(url, f"(SELECT min({_named(column)}) AS lo, max({_named(column)}) AS hi FROM {table}) b", properties=properties).first()
    return spark.read.jdbc(url, table, column=column, lowerBound=low or 0, upperBound=high or 1, numPartitions=parts, properties=properties)


def page(df: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a table in a stated order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, PAGE_ROWS)))


def _exported(c: str, kind: str) -> Column:
    """Bytes as hex and times in ISO form, as JSON has neither."""
    if kind == "binary":
        return F.lower(F.hex(c))
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else F.col(f"`{c}`")


def export_document(spark: SparkSession, path: str, target: str, names: list[str] | None = None) -> dict:
    """The database as one JSON document ``{version, type, tables: [{name, schema, rows}]}`` in a ZIP.

    Tasks write the rows of each table as JSON lines to the shared folder; the document is joined from these files, line by line as bytes, and put in place by a rename.
    """
    counts, staging, draft = {}, new_path(spark, "export"), f"{target}.{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(staging)
    try:
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as package, package.open("database.json", "w", force_zip64=True) as out:
            out.write(b'{"version":1,"type":"sqlite","tables":[')
            for n, name in enumerate(names if names is not None else tables(path)):
                out.write(("," * (n > 0) + f'{{"name":{json.dumps(name)},"schema":{json.dumps(schema(path, name))},"rows":[').encode())
                rows = scan(spark, path, name)
                rows = rows.select(F.to_json(F.struct(*[_exported(c, t).alias(c) for c, t in rows.dtypes]), {"ignoreNullFields": "false"}).alias("value"))
                rows.write.text(f"{staging}/{n}")
                counts[name] = 0
                for part in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/{n}")) if f.base_name.startswith("part-")):
                    with fs.open_input_stream(part) as lines:
                        for line in io.BufferedReader(lines):
                            out.write(b"," * (counts[name] > 0) + line.rstrip(b"\n"))
                            counts[name] += 1
                out.write(b"]}")
            out.write(b"]}")
        os.replace(draft, target)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(draft)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(root)
    return {"tables": len(counts), "rows": sum(counts.values())}


def backup_tables(spark: SparkSession, document: str) -> dict[str, DataFrame]:
    """Frames of the tables in an exported document (``database.json``, already unpacked), by name; values as text."""
    text = spark.read.text(document, wholetext=True).select(F.parse_json("value").alias("v"))
    table = F.explode(F.variant_get("v", "$.tables", "array<variant>")).alias("t")
    listed = text.select(table).select(F.variant_get("t", "$.name", "string").alias("name"), F.variant_get("t", "$.schema", "array<struct<name:string>>")["name"].alias("columns"), F.col("t"))
    out = {}
    for r in listed.select("name", "columns").collect():  # a row per table
        rows = listed.filter(F.col("name") == r.name).select(F.explode(F.variant_get("t", "$.rows", "array<map<string,string>>")).alias("row"))
        out[r.name] = rows.select(*[F.element_at("row", c).alias(c) for c in r["columns"]])
    return out
