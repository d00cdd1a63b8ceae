"""Polygons against tiles, and the union of polygons that share edges.

A polygon is a row with an id and ``rings``: arrays of points (x: longitude, y: latitude) of all its parts and holes, counted even-odd. Tiles are (z, x, y) of Web Mercator;
edges are straight in longitude and latitude. A tile meets a polygon if they have a point in common, borders included.

``cover`` cuts a polygon into cells of the tile pyramid: border cells, which an edge meets, and full ones, which lie inside; each cell keeps whether its inner point is inside, so its
children need only the edges that its parent met. Tiles find cells by equality: a tile inside a full cell, or one that is a cell itself, meets the polygon; below the deepest level the few tiles in a border cell are
tested against that cell's edges alone. No pair of a tile and a polygon apart from it is ever made.

``dissolved`` unites polygons whose borders run in one sense (counter-clockwise outside, clockwise around holes) and whose common borders have common end points, as tiles have: edges of
opposite directions cancel in an aggregate, the others are joined to rings by pointer doubling, in a number of rounds logarithmic in the longest ring.

Cases: null, empty and degenerate rings have no edges; a ring may repeat its first point or not; polygons that share an id are one; latitudes beyond the tiles' range count; repeated tiles are kept in semi-joins;
edges that occur more often in one direction leave their surplus once (a polygon that is repeated counts once).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import mercator
from sievewright.sources.work import written

COVER = 10
INNER = (0.41421356237, 0.73205080757)  # a cell's inner point: on no line that data are likely to follow
RINGS = "array<array<struct<x:double,y:double>>>"
_CELLS = "id string, k int, cx long, cy long, full boolean, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _edges(rings) -> np.ndarray:
    parts = []
    for ring in rings if rings is not None else ():
        points = np.array([(p["x"], p["y"]) for p in ring if p is not None] if ring is not None else [], float).reshape(-1, 2)
        if len(points) > 1:
            parts.append(np.hstack([points, np.roll(points, -1, axis=0)]))
    out = np.concatenate(parts) if parts else np.zeros((0, 4))
    return out[(out[:, :2] != out[:, 2:]).any(axis=1)]


def _box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    n = 2.0**z
    return x / n * 360 - 180, float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + 1) / n))))), (x + 1) / n * 360 - 180, float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y / n)))))


def _meets(e: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which edges have a point in the closed box: their ranges overlap and its corners are not all on one side."""
    west, south, east, north = box
    x1, y1, x2, y2 = e.T
    near = (np.minimum(x1, x2) <= east) & (np.maximum(x1, x2) >= west) & (np.minimum(y1, y2) <= north) & (np.maximum(y1, y2) >= south)
    sides = [(x2 - x1) * (b - y1) - (y2 - y1) * (a - x1) for a in (west, east) for b in (south, north)]
    return near & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)


def _inner(box: tuple[float, float, float, float]) -> tuple[float, float]:
    return box[0] + INNER[0] * (box[2] - box[0]), box[1] + INNER[1] * (box[3] - box[1])


def _odd(e: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> bool:
    """Whether the way from a along x, then along y to b crosses the edges an odd number of times."""
    x1, y1, x2, y2 = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        across = (y1 > a[1]) != (y2 > a[1])
        at = x1 + (a[1] - y1) / (y2 - y1) * (x2 - x1)
        n = int((across & ((a[0] < at) != (b[0] < at))).sum())
        along = (x1 > b[0]) != (x2 > b[0])
        at = y1 + (b[0] - x1) / (x2 - x1) * (y2 - y1)
        n += int((along & ((a[1] < at) != (b[1] < at))).sum())
    return n % 2 == 1


def cells(rings, deepest: int) -> Iterator[tuple]:
    """(k, x, y, full, inside, edges) of a polygon's cover; edges are given for the border cells of the deepest level."""
    e = _edges(rings)
    if not len(e):
        return
    root = _box(0, 0, 0)
    far = (float(e[:, [0, 2]].max()) + 1, _inner(root)[1])  # outside
    stack = [(0, 0, 0, e[_meets(e, root)], _odd(e, far, _inner(root)))]
    while stack:
        k, x, y, own, inside = stack.pop()
        if not len(own):
            if inside:
                yield k, x, y, True, True, None
            continue
        yield k, x, y, False, inside, own if k == deepest else None
        if k < deepest:
            here = _inner(_box(k, x, y))
            for cx in (2 * x, 2 * x + 1):
                for cy in (2 * y, 2 * y + 1):
                    box = _box(k + 1, cx, cy)
                    stack.append((k + 1, cx, cy, own[_meets(own, box)], inside != _odd(own, here, _inner(box))))


def cover(polygons: DataFrame, deepest: int = COVER) -> DataFrame:
    """(id, k, cx, cy, full, inside, edges) of all polygons."""

    names = [f.split(" ", 1)[0] for f in _CELLS.split(", ")]
    edge = pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")])
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(edge)]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*held, strict=True)) or [[]] * len(names), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for name, rings in zip(b.column("id"), b.column("rings"), strict=True):
                for *cell, own in cells(rings.as_py(), deepest):
                    held.append((name.as_py(), *cell, None if own is None else [dict(zip(edge.names, v, strict=True)) for v in own.tolist()]))
                    if len(held) == 4096:
                        yield batch(held)
                        held = []
            yield batch(held)

    one = polygons.select(F.col("id").cast("string").alias("id"), F.col("rings").cast(RINGS).alias("rings"))
    return one.groupBy("id").agg(F.flatten(F.collect_list("rings")).alias("rings")).mapInArrow(run, _CELLS)


def _touches(box: dict[str, Column], edges: Column) -> Column:
    """Whether one of the edges has a point in the closed box."""

    def meets(e: Column) -> Column:
        near = (F.least(e["x1"], e["x2"]) <= box["east"]) & (F.greatest(e["x1"], e["x2"]) >= box["west"]) & (F.least(e["y1"], e["y2"]) <= box["north"]) & (F.greatest(e["y1"], e["y2"]) >= box["south"])
        sides = [(e["x2"] - e["x1"]) * (b - e["y1"]) - (e["y2"] - e["y1"]) * (a - e["x1"]) for a in (box["west"], box["east"]) for b in (box["south"], box["north"])]
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(edges, meets)


def _crossings(edges: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the way from a along x, then along y to b crosses an odd number of edges."""

    def across(e: Column) -> Column:
        at = e["x1"] + (ay - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"])
        return ((e["y1"] > ay) != (e["y2"] > ay)) & ((ax < at) != (bx < at))

    def along(e: Column) -> Column:
        at = e["y1"] + (bx - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) * (e["y2"] - e["y1"])
        return ((e["x1"] > bx) != (e["x2"] > bx)) & ((ay < at) != (by < at))

    return (F.size(F.filter(edges, across)) + F.size(F.filter(edges, along))) % 2 == 1


def _point(box: dict[str, Column]) -> tuple[Column, Column]:
    return box["west"] + INNER[0] * (box["east"] - box["west"]), box["south"] + INNER[1] * (box["north"] - box["south"])


def meeting(tiles: DataFrame, polygons: DataFrame, deepest: int = COVER) -> DataFrame:
    """Every tile (all its columns) with the id of each polygon that it meets, as ``polygon``."""
    found = written(cover(polygons, deepest), "cover")
    full = [r.k for r in found.filter("full").select("k").distinct().collect()]  # a number for each level
    own = F.least(F.col("z").cast("int"), F.lit(deepest))
    levels = F.array_distinct(F.concat(F.filter(F.array(*[F.lit(k).cast("int") for k in full]), lambda k: k < own), F.array(own)))
    up = F.pow(F.lit(2.0), F.col("z") - F.col("__k"))
    asked = tiles.withColumn("__k", F.explode(levels)).withColumns({"__cx": F.floor(F.col("x") / up), "__cy": F.floor(F.col("y") / up)})
    cell = found.select([F.col(c).alias(f"__c_{c}") for c in found.columns])  # no name of a tile's column is taken
    joined = asked.join(cell, (F.col("__k") == F.col("__c_k")) & (F.col("__cx") == F.col("__c_cx")) & (F.col("__cy") == F.col("__c_cy")))
    box, around, edges = mercator.bounds(F.col("x"), F.col("y"), F.col("z")), mercator.bounds(F.col("__cx"), F.col("__cy"), F.col("__k")), F.col("__c_edges")
    inside = F.col("__c_inside") != _crossings(edges, *_point(around), *_point(box))
    tested = (F.col("__k") == deepest) & edges.isNotNull() & (_touches(box, edges) | inside)
    return joined.filter(F.col("__c_full") | (F.col("z") == F.col("__k")) | tested).select(*tiles.columns, F.col("__c_id").alias("polygon"))


def tiles_in_polygons(tiles: DataFrame, polygons: DataFrame, deepest: int = COVER) -> DataFrame:
    """The tiles that meet any of the polygons; repeated tiles stay repeated."""
    once = meeting(tiles.select("z", "x", "y").distinct(), polygons, deepest).select("z", "x", "y").distinct()
    return tiles.join(once, ["z", "x", "y"], "left_semi").select(*tiles.columns)


def tile_edges(tiles: DataFrame) -> DataFrame:
    """The four directed edges of each tile, counter-clockwise, between corners (x, y) of its zoom's grid (y counts down)."""
    x, y = F.col("x"), F.col("y")
    corners = [(x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)]
    sides = [F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    return tiles.select("z", F.inline(F.array(*sides)))


def dissolved(edges: DataFrame, by: list[str], up: bool = True) -> DataFrame:
    """Rings of the union of all polygons of a group: by, x, y, n_edges and area (negative for holes).

    ``edges`` has ``by`` and x1, y1, x2, y2, with the inside on the left as drawn (``up``: y counts up). x and y are the least start of a ring's edges. At a point where several borders meet, each goes on with the edge furthest to the left, so polygons that touch in a point stay apart.
    """
    hand = 1.0 if up else -1.0
    place = lambda n: F.struct(F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"))
    ends = edges.select(*by, place(1).alias("p"), place(2).alias("q")).filter("p <> q")
    ends = ends.select(*by, F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), F.when(F.col("p") < F.col("q"), 1).otherwise(-1).alias("ahead"))
    left = ends.groupBy(*by, "low", "high").agg(F.sum("ahead").alias("n")).filter("n <> 0")
    left = left.select(*by, F.when(F.col("n") > 0, F.struct(F.col("low").alias("p"), F.col("high").alias("q"))).otherwise(F.struct(F.col("high").alias("p"), F.col("low").alias("q"))).alias("e"))
    left = written(left, "border-edges")
    mine = lambda other: [F.col(c).eqNullSafe(other[f"_{c}"]) for c in by]
    leaving = left.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("e").alias("f"))
    pairs = left.join(leaving, [*mine(leaving), F.col("e.q") == F.col("f.p")])
    ux, uy, vx, vy = (F.col(f"{e}.q.{n}") - F.col(f"{e}.p.{n}") for e in ("e", "f") for n in ("x", "y"))
    turn = F.when(F.col("f.q") == F.col("e.p"), F.lit(-4.0)).otherwise(F.atan2(hand * (ux * vy - uy * vx), ux * vx + uy * vy))  # straight back comes last
    ring = written(pairs.groupBy(*by, "e").agg(F.max_by("f", turn).alias("next")).withColumn("least", F.least("e", "next")), "ring-steps")
    while True:  # after n rounds an edge knows the least of 2**n edges from it on
        on = ring.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("e").alias("f"), F.col("next").alias("then"), F.col("least").alias("lower"))
        moved = ring.join(on, [*mine(on), F.col("next") == F.col("f")])
        moved = written(moved.select(*by, "e", F.col("then").alias("next"), F.least("least", "lower").alias("least"), (F.col("lower") < F.col("least")).alias("changed")), "ring-steps")
        ring = moved.drop("changed")
        if not moved.filter("changed").limit(1).count():
            break
    cross = (F.col("e.p.x") * F.col("e.q.y") - F.col("e.q.x") * F.col("e.p.y")) / 2
    rings = ring.groupBy(*by, "least").agg(F.count("*").alias("n_edges"), (F.sum(cross) * hand).alias("area"))
    return rings.select(*by, F.col("least.p.x").alias("x"), F.col("least.p.y").alias("y"), "n_edges", "area")
