"""Map sheets as fixed-section text layers: attributes and geometry joined by position.

A sheet is a set of files with one stem: ``.SMS`` holds its metadata, and for each layer letter X ``.XSX`` has attributes, ``.XTP`` pointers and ``.XZB`` geometry. Layer files begin with six
lines, the fifth of which names the format; sections follow, each after a line ``kind count`` (P points, L lines, A areas, N notes). Lines become rows; a window carries each
section's header over its lines, so attributes, points and notes, which take a line each, need nothing else. Lines and areas have a line with their number of points and then as many coordinates
over any number of lines: which feature a line belongs to is counted in order, section by section. Attributes and geometry of a section meet by their place in it.

Coordinates are relative: origin and scale come from the sheet's metadata (values of -32000 or less mean no data, a scale must be positive).

Cases: a layer file without the format's name is an error; blank lines count as nothing; a section with fewer features than attributes (or the other way round) leaves the rest without a partner;
areas without points keep their anchor; bytes that are no GB 18030 become U+FFFD; a sheet without metadata has origin 0 and scale 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The format's name, lines before the sections, kinds of sections, names of metadata.
FORMAT, HEAD_LINES, KINDS = "GJB5068-2004", 6, "PLAN"
ORIGIN_X, ORIGIN_Y, SCALE, ZONE, UNIT, PROJECTION, DATUM = "相对原点横坐标", "相对原点纵坐标", "坐标放大系数", "高斯投影带号", "坐标单位", "地图投影", "大地基准"
NO_DATA = -32000
POINTS = "array<struct<x:double,y:double>>"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, layer, part, n, line) of all files in a folder: part is SMS, or SX, TP, ZB with the layer's letter apart."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("gb18030", "replace"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("sheet"), F.when(ending == "SMS", "").otherwise(F.substring(ending, 1, 1)).alias("layer"), F.when(ending == "SMS", ending).otherwise(F.substring(ending, 2, 9)).alias("part"), decoded("content").alias("text"))
    return named.filter(F.col("part").isin("SMS", "SX", "TP", "ZB")).select("sheet", "layer", "part", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))


def metadata(lines: DataFrame) -> DataFrame:
    """(sheet, name, value) of the numbered lines of metadata."""
    pattern = r"^\s*\d+\s+(\S+)\s+(.*?)\s*$"
    return lines.filter((F.col("part") == "SMS") & F.col("line").rlike(pattern)).select("sheet", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"))


def sheets(lines: DataFrame) -> DataFrame:
    """(sheet, origin_x, origin_y, scale, crs), one row for each sheet with metadata."""
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    one = metadata(lines).groupBy("sheet").agg(*[value(n).alias(a) for n, a in ((ORIGIN_X, "x"), (ORIGIN_Y, "y"), (SCALE, "s"), (ZONE, "zone"), (UNIT, "unit"), (PROJECTION, "projection"), (DATUM, "datum"))])
    known = lambda c, default: F.coalesce(F.when(F.col(c).try_cast("double") > NO_DATA, F.col(c).try_cast("double")), F.lit(default))
    zone = F.col("zone").try_cast("int")
    degrees = F.coalesce(F.col("unit").isin("度", "经纬度") | F.col("projection").isin("无投影", "地理坐标", "经纬度"), F.lit(False))
    crs = F.when(zone.between(1, 60), F.concat(F.lit("CGCS2000 / Gauss-Kruger zone "), zone.cast("string"))).when(degrees & F.coalesce(F.col("datum"), F.lit("")).rlike("(?i)2000|cgcs"), "EPSG:4490").when(degrees, "EPSG:4326").otherwise("EPSG:4498")
    return one.select("sheet", known("x", 0.0).alias("origin_x"), known("y", 0.0).alias("origin_y"), F.when(known("s", 1.0) > 0, known("s", 1.0)).otherwise(1.0).alias("scale"), crs.alias("crs"))


def sectioned(lines: DataFrame, part: str) -> DataFrame:
    """(sheet, layer, kind, n, words): the filled lines of the sections of one part, without headers."""
    own = lines.filter(F.col("part") == part)
    head = rf"^\s*([{KINDS}])\s+(\d+)\s*$"
    checked = F.when((F.col("n") == 4) & (F.trim("line") != FORMAT), F.raise_error(F.concat("sheet", F.lit("."), "layer", F.lit(f"{part}: no {FORMAT}")))).otherwise(F.col("line"))
    body = own.withColumn("line", checked).withColumn("header", F.when(F.col("n") >= HEAD_LINES, F.nullif(F.regexp_extract("line", head, 1), F.lit(""))))
    before = Window.partitionBy("sheet", "layer").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = body.withColumn("kind", F.last("header", ignorenulls=True).over(before))
    return held.filter("header IS NULL AND kind IS NOT NULL AND trim(line) <> ''").select("sheet", "layer", "kind", "n", F.split(F.trim("line"), r"\s+").alias("words"))


def _nth(df: DataFrame) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("sheet", "layer", "kind").orderBy("n")) - 1)


def attributes(lines: DataFrame) -> DataFrame:
    """One row for each attribute line, with its place in the section; notes have columns of their own."""
    w, n = F.col("words"), F.size("words")
    note, word = F.col("kind") == "N", lambda i: F.get(w, F.lit(i))
    middle = F.when(n >= 6, F.slice(w, 3, F.greatest(n - 5, F.lit(0)))).otherwise(F.slice(w, 3, F.greatest(n - 2, F.lit(0))))
    extras = F.slice(middle, 3, F.greatest(F.size(middle) - 2, F.lit(0)))
    gid = F.get(F.filter(extras, lambda t: t.rlike(r"^\d{12,}$")), F.lit(0))
    last = lambda i: F.when(n >= i, F.get(w, n - i))
    common = {
        "name": F.get(middle, F.lit(0)), "note": F.get(middle, F.lit(1)), "gid": gid, "extra": F.array_join(F.when(gid.isNull(), extras).otherwise(F.array_remove(extras, gid)), " "),
        "gtype": last(3), "ptr": F.coalesce(last(2).try_cast("bigint"), F.lit(0)), "tail": last(1),
    }
    notes = {"text": word(2), "font": word(3), "style": word(4), "size": word(5).try_cast("double"), "color": F.when(n > 6, F.get(w, n - 1))}
    return _nth(sectioned(lines, "SX")).select("sheet", "layer", "kind", "nth", word(0).try_cast("bigint").alias("seq"), word(1).alias("code"), *[F.when(~note, v).alias(k) for k, v in common.items()], *[F.when(note, v).alias(k) for k, v in notes.items()])


def pointers(lines: DataFrame) -> DataFrame:
    """(sheet, layer, kind, nth, pointer) of the pointer lines."""
    return _nth(sectioned(lines, "TP")).select("sheet", "layer", "kind", "nth", F.coalesce(F.get("words", F.lit(1)).try_cast("bigint"), F.lit(0)).alias("pointer"))


def _owned(rows: DataFrame) -> DataFrame:
    """Adds ``nth``, the feature each line of lines and areas belongs to, and ``first``: a feature's first line says how many points follow."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nth, need = None, -1, 0
        for b in batches:
            out = []
            for sheet, layer, kind, n, words in zip(b["sheet"], b["layer"], b["kind"], b["n"], b["words"], strict=True):
                if (sheet, layer, kind) != key:
                    key, nth, need = (sheet, layer, kind), -1, 0
                first = need <= 0
                if first:
                    at = 1 if kind == "L" else 4
                    said = words[at] if len(words) > at else "0"
                    nth, need = nth + 1, 2 * int(said) if str(said).isdigit() else 0
                else:
                    need -= len(words)
                out.append((sheet, layer, kind, n, words, nth, first))
            yield pd.DataFrame(out, columns=["sheet", "layer", "kind", "n", "words", "nth", "first"])

    dealt = rows.repartition("sheet", "layer", "kind").sortWithinPartitions("sheet", "layer", "kind", "n")
    return dealt.mapInPandas(count, "sheet string, layer string, kind string, n int, words array<string>, nth int, first boolean")


def _points(values: Column) -> Column:
    """Pairs of numbers as points."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(values))), lambda i: F.struct(F.get(values, i).alias("x"), F.get(values, i + 1).alias("y")))


def geometries(lines: DataFrame) -> DataFrame:
    """(sheet, layer, kind, nth, anchor, points) in relative coordinates: points and notes have an anchor and further points, lines and areas their vertices."""
    rows = sectioned(lines, "ZB")
    numbers = lambda start: F.transform(F.slice("words", start, F.greatest(F.size("words") - (start - 1), F.lit(0))), lambda v: v.try_cast("double"))
    single = _nth(rows.filter(F.col("kind").isin("P", "N")))
    real = F.filter(_points(numbers(2)), lambda p: (p["x"] != 0) | (p["y"] != 0))  # zeros stand for no point
    anchor = F.when(F.col("kind") == "N", F.get(_points(numbers(2)), F.lit(0))).otherwise(F.coalesce(F.get(real, F.lit(0)), F.get(_points(numbers(2)), F.lit(0))))
    further = F.when(F.col("kind") == "N", F.concat(F.slice(_points(numbers(4)), 1, 1), _points(numbers(7)))).otherwise(F.slice(real, 2, F.greatest(F.size(real) - 1, F.lit(0))))
    one = single.select("sheet", "layer", "kind", "nth", anchor.cast("struct<x:double,y:double>").alias("anchor"), further.cast(POINTS).alias("points"))
    many = _owned(rows.filter(F.col("kind").isin("L", "A")))
    start = F.max(F.when(F.col("first") & (F.col("kind") == "A"), F.struct(F.get("words", F.lit(1)).try_cast("double").alias("x"), F.get("words", F.lit(2)).try_cast("double").alias("y"))))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("n", "words"))))
    most = F.max(F.when(F.col("first"), F.get("words", F.when(F.col("kind") == "L", F.lit(1)).otherwise(F.lit(4))).try_cast("int")))
    parts = many.groupBy("sheet", "layer", "kind", "nth").agg(start.alias("anchor"), ordered.alias("rows"), F.coalesce(most, F.lit(0)).alias("most"))
    values = F.transform(F.flatten(F.transform("rows", lambda r: r["words"])), lambda v: v.try_cast("double"))
    vertices = F.slice(_points(values), 1, F.col("most"))
    return one.unionByName(parts.select("sheet", "layer", "kind", "nth", F.col("anchor").cast("struct<x:double,y:double>").alias("anchor"), vertices.cast(POINTS).alias("points")))


def features(lines: DataFrame) -> DataFrame:
    """Attributes, pointers and geometry of all layers of all sheets by place, in absolute coordinates."""
    at = ["sheet", "layer", "kind", "nth"]
    whole = attributes(lines).join(geometries(lines), at, "full_outer").join(pointers(lines), at, "left").join(sheets(lines), "sheet", "left")
    moved = lambda p: F.when(p.isNotNull(), F.struct((F.coalesce("origin_x", F.lit(0.0)) + p["x"] * F.coalesce("scale", F.lit(1.0))).alias("x"), (F.coalesce("origin_y", F.lit(0.0)) + p["y"] * F.coalesce("scale", F.lit(1.0))).alias("y")))
    return whole.withColumns({"anchor": moved(F.col("anchor")), "points": F.transform("points", moved), "crs": F.coalesce("crs", F.lit("EPSG:4498"))}).drop("origin_x", "origin_y", "scale")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return features(text_lines(spark, path))
