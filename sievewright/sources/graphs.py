"""RDF/XML, GeoJSON and other record sources that need a small parser per file, and clients given from outside."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML = "{http://www.w3.org/XML/1998/namespace}"


def _uri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def rdf_triples(text: str) -> Iterator[tuple[str, str, str, bool, str, str]]:
    """(s, p, o, resource, lang, datatype) of an RDF/XML document; nested nodes, containers and blank nodes included."""
    root = ET.fromstring(text)
    base, blanks = root.get(f"{XML}base", ""), iter(range(1 << 62))

    def absolute(u: str) -> str:
        return base.rstrip("#") + u if u.startswith("#") or not u else u

    def name(e: ET.Element) -> str:
        if (u := e.get(f"{RDF}about")) is not None:
            return absolute(u)
        if (u := e.get(f"{RDF}ID")) is not None:
            return absolute("#" + u)
        return f"_:{e.get(f'{RDF}nodeID')}" if e.get(f"{RDF}nodeID") else f"_:b{next(blanks)}"

    def node(e: ET.Element, lang: str) -> Iterator[tuple]:
        s, lang = name(e), e.get(f"{XML}lang", lang)
        yield ("node", s)
        if e.tag != f"{RDF}Description":
            yield (s, _uri(f"{RDF}type"), _uri(e.tag), True, "", "")
        for k, v in e.attrib.items():
            if not k.startswith((RDF, XML)):
                yield (s, _uri(k), v, False, lang, "")
        for n, p in enumerate(e, 1):
            yield from member(s, p, _uri(p.tag) if p.tag != f"{RDF}li" else f"{_uri(RDF)}_{n}", p.get(f"{XML}lang", lang))

    def member(s: str, p: ET.Element, pred: str, lang: str) -> Iterator[tuple]:
        if (u := p.get(f"{RDF}resource")) is not None:
            yield (s, pred, absolute(u), True, "", "")
        elif p.get(f"{RDF}nodeID"):
            yield (s, pred, f"_:{p.get(f'{RDF}nodeID')}", True, "", "")
        elif p.get(f"{RDF}parseType") == "Collection":
            ends = [f"_:b{next(blanks)}" for _ in p]
            yield (s, pred, ends[0] if ends else _uri(f"{RDF}nil"), True, "", "")
            for i, x in enumerate(p):
                for t in node(x, lang):
                    yield (ends[i], _uri(f"{RDF}first"), t[1], True, "", "") if t[0] == "node" else t
                yield (ends[i], _uri(f"{RDF}rest"), ends[i + 1] if i + 1 < len(ends) else _uri(f"{RDF}nil"), True, "", "")
        elif len(p) and p.get(f"{RDF}parseType") != "Literal":
            for x in p:
                for t in node(x, lang):
                    yield (s, pred, t[1], True, "", "") if t[0] == "node" else t
        else:
            yield (s, pred, "".join(p.itertext()), False, lang, p.get(f"{RDF}datatype", ""))

    for e in [root] if root.tag != f"{RDF}RDF" else root:
        for t in node(e, root.get(f"{XML}lang", "")):
            if t[0] != "node" or len(t) > 2:
                yield t


TRIPLES = "path string, s string, p string, o string, resource boolean, lang string, datatype string"


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML files, a file a row of work; repeated triples are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, *t) for t in rdf_triples(bytes(raw).decode("utf-8-sig"))], columns=["path", "s", "p", "o", "resource", "lang", "datatype"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TRIPLES)
    return found.dropDuplicates(["s", "p", "o", "lang"])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features with their properties as a map, geometry as JSON text and its bounding box, by Spark's JSON functions."""
    text = spark.read.text(path, wholetext=True)
    shape = "struct<features:array<struct<properties:map<string,string>,geometry:string>>>"
    one = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.properties", "f.geometry", F.get_json_object("f.geometry", "$.type").alias("type"))
    numbers = F.transform(F.regexp_extract_all(F.get_json_object("geometry", "$.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*-?[0-9.eE+-]+"), F.lit(1)), lambda v: v.try_cast("double"))
    lats = F.transform(F.regexp_extract_all(F.get_json_object("geometry", "$.coordinates"), F.lit(r"\[\s*-?[0-9.eE+-]+\s*,\s*(-?[0-9.eE+-]+)"), F.lit(1)), lambda v: v.try_cast("double"))
    return one.withColumns({"west": F.array_min(numbers), "east": F.array_max(numbers), "south": F.array_min(lats), "north": F.array_max(lats)})


# Kinds of values that a graph database's client tells apart, each by an ``is_`` and an ``as_`` method; those of time have ISO forms.
SCALARS, TIMES, MANY, GRAPH = ("bool", "int", "double", "string"), {"time": "time", "date": "date", "datetime": "datetime"}, ("list", "set"), {"vertex": "node", "edge": "relationship", "path": "path"}


def decoded(value):
    """A client's typed value as plain Python, ready for JSON; empty and null are None, what is of no known kind is ""."""
    told = lambda kind, prefix="is": getattr(value, f"{prefix}_{kind}", lambda: None)()
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if told("empty") or told("null"):
        return None
    if kind := next(filter(told, SCALARS), None):
        return told(kind, "as")
    if kind := next(filter(told, TIMES), None):
        moment = told(TIMES[kind], "as")
        return moment.isoformat() if hasattr(moment, "isoformat") else str(moment)
    if kind := next(filter(told, MANY), None):
        items = [decoded(v) for v in told(kind, "as")]
        return items if kind == "list" else sorted(items, key=lambda v: (str(type(v)), str(v)))
    if told("map"):
        return {str(k): decoded(v) for k, v in told("map", "as").items()}
    kind = next(filter(told, GRAPH), None)
    return _graph_part(told(GRAPH[kind], "as"), kind) if kind else ""


def _graph_part(part, kind: str):
    """Nodes, relationships and paths by what their objects offer."""
    if kind == "vertex":
        return {"id": decoded(part.get_id()), "tags": {t: {k: decoded(v) for k, v in part.properties(t).items()} for t in part.tags()}}
    if kind == "edge":
        return {"s": decoded(part.start_vertex_id()), "d": decoded(part.end_vertex_id()), "type": part.edge_name(), "rank": part.ranking(), "properties": {k: decoded(v) for k, v in part.properties().items()}}
    return {"nodes": [_graph_part(n, "vertex") for n in part.nodes()], "edges": [_graph_part(e, "edge") for e in part.relationships()]}


def decoded_rows(client: Callable[[str], Iterator[dict]], names: list[str]) -> Callable[[str], Iterator[dict]]:
    """A client for ``scanned`` whose typed values become text: strings as they are, all else as JSON, null as null."""

    def shown(value) -> str | None:
        plain = decoded(value)
        return plain if plain is None or isinstance(plain, str) else json.dumps(plain, ensure_ascii=False, sort_keys=True)

    def rows(part: str) -> Iterator[dict]:
        for record in client(part):
            yield {n: shown(record.get(n)) for n in names}

    return rows


def vertices(rows: DataFrame) -> DataFrame:
    """(v_id, tags, tags_info JSON) as vertices with a property map."""
    return rows.select(F.col("v_id").cast("string").alias("id"), F.split("tags", ",").alias("tags"), F.from_json("tags_info", "map<string,string>").alias("properties"))


def edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("s_vid").cast("string").alias("s"), F.col("d_vid").cast("string").alias("d"), F.coalesce(F.col("rank").cast("bigint"), F.lit(0)).alias("rank"), "type", F.from_json("type_info", "map<string,string>").alias("properties"))


def search_documents(rows: DataFrame) -> DataFrame:
    """Exported lines ``{"_id", "_source"}`` as id and source text."""
    return rows.select(F.get_json_object("value", "$._id").alias("id"), F.get_json_object("value", "$._source").alias("source"))


def scanned(spark: SparkSession, parts: list[str], client: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of an outside service: ``client(part)`` pages through one part (a key pattern, an index slice, a space) inside a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["part"]:
                page: list[dict] = []
                for row in client(part):
                    page.append(row)
                    if len(page) == 1000:
                        yield pd.DataFrame(page)
                        page = []
                if page:
                    yield pd.DataFrame(page)

    given = spark.createDataFrame([(p,) for p in parts], "part string")
    return given.repartition(max(1, len(parts))).mapInPandas(run, schema)


def sent(df: DataFrame, client: Callable[[list[dict]], tuple[int, int]], size: int = 1000) -> DataFrame:
    """Rows given to an outside service in lists of ``size`` inside tasks; (sent, failed) by list. The client must be idempotent by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [json.loads(v) for v in b["value"]]
            done = [client(rows[i : i + size]) for i in range(0, len(rows), size)]
            yield pd.DataFrame(done, columns=["sent", "failed"])

    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(run, "sent long, failed long")
