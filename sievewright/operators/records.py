"""Records of web pages, JSON documents, graphs and tiles as frames."""

from __future__ import annotations

import html
import html.parser
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import mercator
from sievewright.functions.urls import clean_url, pointer_token

# web pages

BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre section article div tr ul ol li br".split())
HIDDEN = frozenset("script style noscript template svg".split())


class _Page(html.parser.HTMLParser):
    """Text by blocks, links with their texts, and the title of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title = [], [], []
        self.hidden, self.in_title = 0, False
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.anchor = [dict(attrs).get("href") or "", ""]
        if tag in BLOCKS:
            self.parts.append("\n" + "• " * (tag == "li"))

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.anchor:
            self.links.append(tuple(self.anchor))
            self.anchor = None
        if tag in BLOCKS:
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append("\t")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data)
            if self.anchor:
                self.anchor[1] += data


def _read(page: str) -> _Page:
    p = _Page()
    p.feed(page or "")
    p.close()
    return p


def _lines(parts: list[str]) -> str:
    lines = (re.sub(r"[\t\f\v ]+", " ", line).strip() for line in "".join(parts).splitlines())
    return "\n".join(line for line in lines if line)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, url, title and the readable text of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [_read(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "title": [" ".join("".join(p.title).split()) for p in read], "content": [_lines(p.parts) for p in read]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, content string")


def page_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: page_id, position, absolute URL without fragment, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, n, urljoin(u or "", h), " ".join(t.split())) for i, u, page in zip(b["page_id"], b["url"], b["html"], strict=True) for n, (h, t) in enumerate(_read(page).links)]
            yield pd.DataFrame(out, columns=["page_id", "nth", "link", "anchor"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, nth int, link string, anchor string")
    return found.withColumn("link", clean_url(F.col("link")))


def page_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def text_urls(c: Column) -> Column:
    """URLs of free text, distinct, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"https?://[^\s,;\"'<>]+"), F.lit(0)))


def link_score(text: Column, link: Column) -> Column:
    """Weighted rules of an article link: long text, a date or number in the path, no listing word."""
    score = F.when(F.length(text) >= 12, 2).otherwise(F.when(F.length(text) >= 6, 1).otherwise(0))
    score = score + F.when(link.rlike(r"/\d{4}[/-]?\d{2}|\d{5,}|\.s?html?\b"), 2).otherwise(0)
    return score - F.when(F.lower(link).rlike(r"/(login|signup|about|tag|category|search|page)\b"), 3).otherwise(0)


# JSON documents

MAX_DEPTH, MAX_CHARS = 100, 5_000_000


def _no_repeats(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"key {k!r} repeats")
        out[k] = v
    return out


def strict_json(text: str):
    """The parsed document; refuses repeated keys, NaN, integers beyond 2**53, depth over 100 and over 5 million characters."""
    if len(text) > MAX_CHARS:
        raise ValueError("the document is too long")

    def refuse(name):
        raise ValueError(f"{name} is no JSON number")

    value = json.loads(text, object_pairs_hook=_no_repeats, parse_constant=refuse)
    level = [(value, 1)]
    while level:
        v, depth = level.pop()
        if depth > MAX_DEPTH:
            raise ValueError("the document is too deep")
        if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 2**53 - 1:
            raise ValueError("an integer is not exact")
        level += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return value


def _kind(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _walk(v, pointer: str = "", depth: int = 0):
    yield pointer, depth, _kind(v), None if isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)
    items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    for k, x in items:
        yield from _walk(x, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", depth + 1)


def flattened(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per node of each document: key, pointer, depth, type, value; a document that does not parse gives one row of type invalid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["key"], b["doc"], strict=True):
                try:
                    out += [(k, *node) for node in _walk(strict_json(text))]
                except (ValueError, TypeError, RecursionError) as e:
                    out.append((k, "", 0, "invalid", str(e)[:200]))
            yield pd.DataFrame(out, columns=["key", "pointer", "depth", "type", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(column).alias("doc")).mapInPandas(run, f"key {kind}, pointer string, depth int, type string, value string").withColumnRenamed("key", key)


def flat_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Top-level members as (key, pointer, value), by built-in functions only."""
    pairs = F.from_json(column, "map<string,string>")
    return df.select(key, F.explode(pairs).alias("name", "value")).select(key, F.concat(F.lit("/"), pointer_token(F.col("name"))).alias("pointer"), "value")


def json_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of flattened documents: the shallowest added, removed or changed pointers."""
    a = left.select(key, "pointer", F.col("type").alias("type_a"), F.col("value").alias("value_a"))
    b = right.select(key, "pointer", F.col("type").alias("type_b"), F.col("value").alias("value_b"))
    both = a.join(b, [key, "pointer"], "full_outer")
    change = F.when(F.col("type_a").isNull(), "added").when(F.col("type_b").isNull(), "removed").when(~F.col("type_a").eqNullSafe(F.col("type_b")) | ~F.col("value_a").eqNullSafe(F.col("value_b")), "changed")
    found = both.withColumn("change", change).filter("change IS NOT NULL")
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("pointer", "/")) - 1), lambda n: F.array_join(F.slice(F.split("pointer", "/"), F.lit(1), n), "/"))
    cut = found.select(key, "pointer", "change", "value_a", "value_b", F.when(F.col("pointer") == "", F.array().cast("array<string>")).otherwise(parents).alias("above"))
    over = cut.select(key, "pointer", F.explode("above").alias("parent"))
    hidden = over.join(found.select(key, F.col("pointer").alias("parent")), [key, "parent"], "left_semi").select(key, "pointer").distinct()
    return cut.join(hidden, [key, "pointer"], "left_anti").drop("above")


def tabulated(c: Column, fields: list[str]) -> Column:
    """Array of objects as structs of strings, all its objects with the named fields; null where the text is no array."""
    return F.from_json(c, "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>")


# triples

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
# Predicates and types that tell a node's kind.
CLASS_TYPES = (OWL + "Class", RDFS + "Class", RDFS + "Datatype")
PROPERTY_TYPES = (RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty", OWL + "FunctionalProperty", OWL + "TransitiveProperty", OWL + "SymmetricProperty")
CLASS_SUBJECT, PROPERTY_SUBJECT = (RDFS + "subClassOf", OWL + "equivalentClass", OWL + "disjointWith"), (RDFS + "domain", RDFS + "range", RDFS + "subPropertyOf", OWL + "inverseOf")
CLASS_OBJECT, PROPERTY_OBJECT = (RDFS + "subClassOf", RDFS + "domain", RDFS + "range"), (RDFS + "subPropertyOf", OWL + "onProperty")
LABELS = (RDFS + "label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://purl.org/dc/elements/1.1/title", "http://xmlns.com/foaf/0.1/name")


def distinct_triples(t: DataFrame) -> DataFrame:
    return t.dropDuplicates(["s", "p", "o", "lang"])


def node_kinds(t: DataFrame) -> DataFrame:
    """Kind of every node, from partially aggregated facts about its outgoing and incoming triples."""
    out = t.groupBy(F.col("s").alias("node")).agg(
        F.bool_or((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Ontology")).alias("ontology"),
        F.bool_or((F.col("p") == RDF + "type") & F.col("o").isin(*CLASS_TYPES)).alias("class_type"),
        F.bool_or((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Restriction")).alias("restriction"),
        F.bool_or((F.col("p") == RDF + "type") & F.col("o").isin(*PROPERTY_TYPES)).alias("property_type"),
        F.bool_or(F.col("p") == RDF + "first").alias("first"),
        F.bool_or(F.col("p").isin(*PROPERTY_SUBJECT)).alias("property_subject"),
        F.bool_or(F.col("p").isin(*CLASS_SUBJECT)).alias("class_subject"),
        F.lit(True).alias("has_out"),
    )
    into = t.filter("resource").groupBy(F.col("o").alias("node")).agg(F.bool_or(F.col("p").isin(*PROPERTY_OBJECT)).alias("property_object"), F.bool_or(F.col("p").isin(*CLASS_OBJECT)).alias("class_object"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(yes("ontology"), "ontology").when(yes("class_type"), "class").when(yes("restriction"), "restriction").when(yes("property_type"), "property").when(yes("first"), "list")
    kind = kind.when(yes("property_subject"), "property").when(yes("class_subject"), "class").when(yes("property_object"), "property").when(yes("class_object"), "class")
    return out.join(into, "node", "full_outer").select("node", kind.when(~yes("has_out"), "resource").otherwise("individual").alias("kind"))


def node_labels(t: DataFrame) -> DataFrame:
    """Best label of every subject by the order of label predicates, else the end of its URI."""
    rank = F.lit(None).cast("int")
    for n, uri in reversed(list(enumerate(LABELS))):
        rank = F.when((F.col("p") == uri) & ~F.col("resource"), n).otherwise(rank)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("o").alias("o"))))
    return t.groupBy(F.col("s").alias("node")).agg(best.alias("b")).select("node", F.coalesce("b.o", F.regexp_extract("node", r"([^#/]*)[#/]?\z", 1)).alias("label"))


def graph_edges(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resource triples whose two ends are both in ``nodes``."""
    n = nodes.select("node")
    return t.filter("resource").join(n.withColumnRenamed("node", "s"), "s", "left_semi").join(n.withColumnRenamed("node", "o"), "o", "left_semi").select("s", "p", "o")


# tiles

TILE_PATH = r"(?:^|/)(?:[^/]*?)(\d+)/(\d+)/(\d+)\.(?i:png|jpe?g|webp)$"


def tile_inventory(paths: DataFrame, column: str = "path") -> DataFrame:
    """Valid tiles of z/x/y paths."""
    part = lambda n: F.regexp_extract(column, TILE_PATH, n).try_cast("bigint")
    found = paths.select(column, part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.lower(F.regexp_extract(column, r"\.([^.]+)$", 1)).alias("format"))
    return found.filter(F.coalesce(mercator.is_valid(F.col("x"), F.col("y"), F.col("z")), F.lit(False)))


def tile_summary(tiles: DataFrame) -> DataFrame:
    """Count, zoom range, bounds at the highest zoom and formats: one row."""
    by = tiles.groupBy("z").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.collect_set("format").alias("f"))
    one = by.agg(F.sum("n").alias("n"), F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.max_by(F.struct("x0", "x1", "y0", "y1"), "z").alias("b"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))), ",").alias("formats"))
    z = F.col("max_zoom")
    return one.select("n", "min_zoom", "max_zoom", mercator.tile_west(F.col("b.x0"), z).alias("west"), mercator.tile_north(F.col("b.y1") + 1, z).alias("south"), mercator.tile_west(F.col("b.x1") + 1, z).alias("east"), mercator.tile_north(F.col("b.y0"), z).alias("north"), "formats")


def tiles_in_box(tiles: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Tiles whose bounds meet the box."""
    b = mercator.bounds(F.col("x"), F.col("y"), F.col("z"))
    return tiles.filter((b["west"] < east) & (b["east"] > west) & (b["south"] < north) & (b["north"] > south))


# samples and alignment


def even_sample(df: DataFrame, order: str, quota: int) -> DataFrame:
    """``quota`` rows spread evenly over the order: positions round(i*(n-1)/(quota-1)).

    Positions come from per-range counts, so no task numbers the whole table.
    """
    numbered = with_position(df, order)
    n = df.count()
    if quota >= n:
        return numbered.drop("__pos")
    spots = {n // 2} if quota <= 1 else {round(i * (n - 1) / (quota - 1)) for i in range(quota)}
    wanted = df.sparkSession.createDataFrame([(s,) for s in sorted(spots)], "__pos long")
    return numbered.join(wanted, "__pos", "left_semi").drop("__pos")


def with_position(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """Adds ``__pos``, the row's position from 0 in ascending order of a numeric unique column."""
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("__part", part)
    sizes = sorted((r["__part"], r["count"]) for r in cut.groupBy("__part").count().collect())  # at most ``parts`` rows
    starts, at = {}, 0
    for p, n in sizes:
        starts[p], at = at, at + n
    if not starts:
        return df.withColumn("__pos", F.lit(0).cast("long"))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("__part"))
    w = Window.partitionBy("__part").orderBy(order)
    return cut.withColumn("__pos", (first + F.row_number().over(w) - 1).cast("long")).drop("__part")


def stratified_quota(sizes: DataFrame, limit: int) -> DataFrame:
    """Quota of every stratum (stratum, n): proportional, one at least, the rest to the largest deficits."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    base = sizes.withColumn("total", total).withColumn("quota", F.when(F.col("total") <= limit, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * limit / F.col("total")))))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("n") - F.col("quota")), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    used = F.sum("quota").over(Window.partitionBy(F.lit(1)))
    open_ = base.withColumn("left", F.greatest(F.lit(limit) - used, F.lit(0))).withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("quota")).over(w), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("n") - F.col("quota"), F.col("left") - F.col("before")))
    return open_.select("stratum", "n", (F.col("quota") + F.when(F.col("total") > limit, more).otherwise(0)).cast("bigint").alias("quota"))


def aligned(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cell by cell by row key: one row per cell that was added, removed or changed."""
    a = before.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = after.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    one = [F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields]
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("c.before").eqNullSafe(F.col("c.after")), "changed")
    return both.select(key, "in_a", "in_b", F.explode(F.array(*one)).alias("c")).withColumn("change", change).filter("change IS NOT NULL").select(key, "c.field", "c.before", "c.after", "change")


def positional(left: DataFrame, right: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Element i of one array column beside element i of another; missing ones are null."""
    x = left.select(by, F.posexplode(a).alias("i", a))
    y = right.select(by, F.posexplode(b).alias("i", b))
    return x.join(y, [by, "i"], "left")


def region_sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


# Prefixes of common vocabularies, annotation predicates and types of the vocabulary itself.
PREFIXES = {RDF: "rdf", RDFS: "rdfs", OWL: "owl", "http://www.w3.org/2001/XMLSchema#": "xsd", "http://www.w3.org/2004/02/skos/core#": "skos", "http://purl.org/dc/elements/1.1/": "dc", "http://purl.org/dc/terms/": "dcterms", "http://xmlns.com/foaf/0.1/": "foaf"}
SKOS, DC, DCTERMS = "http://www.w3.org/2004/02/skos/core#", "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"
ANNOTATIONS = (
    *(RDFS + n for n in ("label", "comment", "seeAlso", "isDefinedBy")), OWL + "versionInfo", OWL + "deprecated", *(SKOS + n for n in ("prefLabel", "altLabel", "definition", "note")),
    *(space + n for space in (DC, DCTERMS) for n in ("title", "description", "creator")),
)
META_TYPES = (
    RDF + "Property", RDFS + "Class", RDFS + "Resource", RDFS + "Datatype",
    *(OWL + n for n in ("Class", "Ontology", "Thing", "Nothing", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty", "AsymmetricProperty", "ReflexiveProperty", "IrreflexiveProperty", "Restriction", "NamedIndividual", "DeprecatedClass", "DeprecatedProperty")),
)


def short_uri(uri: Column) -> Column:
    """The prefixed name of a known vocabulary, else the end of the URI; blank nodes as they are."""
    short = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(uri, "[/#]+$", ""), r"([^/#]*)\z", 1), F.lit("")), uri)
    for space, prefix in reversed(PREFIXES.items()):
        short = F.when(uri.startswith(space), F.concat(F.lit(prefix + ":"), F.substr(uri, F.lit(len(space) + 1)))).otherwise(short)
    return F.when((uri == "") | uri.startswith("_:"), uri).otherwise(short)


def is_hidden(literals: bool = False, annotations: bool = False, meta_types: bool = False) -> Column:
    """Whether a graph view leaves a triple (p, o, resource) out: literals, annotations and the vocabulary's own types unless asked for."""
    note = F.col("p").isin(*ANNOTATIONS)
    meta = (F.col("p") == RDF + "type") & F.col("o").isin(*META_TYPES) | F.col("o").startswith("http://www.w3.org/2001/XMLSchema#")
    return F.when(~F.col("resource"), F.when(note, F.lit(not annotations)).otherwise(F.lit(not literals))).otherwise(meta & F.lit(not meta_types))
