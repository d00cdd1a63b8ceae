"""Tile folders and MBTiles files as frames of (z, x, y, format, content)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import mercator
from sievewright.operators.records import tile_inventory

# First bytes of image formats.
MAGIC = {b"\x89PNG": "png", b"\xff\xd8\xff": "jpg", b"RIFF": "webp"}


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tiles = tile_inventory(raw.select("path"))
    return tiles.join(raw.select("path", "content"), "path")


def read_mbtiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of MBTiles files, a file a task; rows count from the north as in folders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(raw))
                cursor = db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles")
                while rows := cursor.fetchmany(500):
                    yield pd.DataFrame([(z, x, y, next((f for m, f in MAGIC.items() if d.startswith(m)), "bin"), d) for z, x, y, d in rows], columns=["z", "x", "y", "format", "content"])
                db.close()

    tiles = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "z long, x long, y long, format string, content binary")
    return tiles.withColumn("y", mercator.flip_row(F.col("y"), F.col("z"))).filter(mercator.is_valid(F.col("x"), F.col("y"), F.col("z")))
