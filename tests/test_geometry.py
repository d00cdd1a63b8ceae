"""Tiles against polygons by brute force, and unions of tiles by flood fill."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sievewright.operators import geometry

POLYGON = "id string, rings array<array<struct<x:double,y:double>>>"


def star(draw, lon, lat, r, n=9):
    return [(lon + r * draw.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), lat + r * draw.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def sides(rings):
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if a != b]


def meets(rings, z, x, y):
    west, south, east, north = geometry._box(z, x, y)
    for x1, y1, x2, y2 in sides(rings):
        if min(x1, x2) <= east and max(x1, x2) >= west and min(y1, y2) <= north and max(y1, y2) >= south:
            s = [(x2 - x1) * (b - y1) - (y2 - y1) * (a - x1) for a in (west, east) for b in (south, north)]
            if min(s) <= 0 <= max(s):
                return True
    px, py = (west + east) / 2 + 1e-7, (south + north) / 2 + 1e-7
    return sum((y1 > py) != (y2 > py) and px < x1 + (py - y1) / (y2 - y1) * (x2 - x1) for x1, y1, x2, y2 in sides(rings)) % 2 == 1


def frame(spark, polygons):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in polygons.items()], POLYGON)


@pytest.mark.parametrize("deepest", [0, 3, 6, 9])
def test_polygons_with_holes(spark, deepest):
    draw = random.Random(4)
    polygons = {f"p{i}": [star(draw, draw.uniform(-150, 150), draw.uniform(-70, 70), draw.choice([0.5, 5, 30]))] for i in range(6)}
    polygons["hole"] = [[(-20, -20), (20, -20), (20, 20), (-20, 20)], [(-10, -10), (10, -10), (10, 10), (-10, 10)], [(40, 0), (50, 0), (45, 9)]]
    polygons["world"] = [[(-400, -100), (400, -100), (400, 100), (-400, 100)]]
    polygons["none"] = []
    tiles = {(z, draw.randrange(1 << z), draw.randrange(1 << z)) for z in range(9) for _ in range(60)} | {(3, 4, 4), (10, 512, 512), (10, 540, 512)}
    given = spark.createDataFrame([(*t, n) for n, t in enumerate(sorted(tiles))], "z int, x long, y long, id int").repartition(3)
    got = {(r.z, r.x, r.y, r.polygon) for r in geometry.meeting(given, frame(spark, polygons), deepest).collect()}
    assert got == {(*t, k) for t in tiles for k, rings in polygons.items() if meets(rings, *t)}


def test_touching_counts_and_holes_do_not(spark):
    box = {"b": [[(0, 0), (90, 0), (90, 40), (0, 40), (0, 0)]]}
    tiles = spark.createDataFrame([(2, 2, 1), (2, 1, 1), (2, 0, 1), (2, 3, 1), (2, 3, 1)], "z int, x long, y long")
    got = sorted((r.x, r.y) for r in geometry.tiles_in_polygons(tiles, frame(spark, box)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1)]  # the neighbours share a border; a repeated tile stays repeated
    hole = {"h": [[(-170, -80), (170, -80), (170, 80), (-170, 80)], [(-100, -60), (100, -60), (100, 60), (-100, 60)]]}
    inside = spark.createDataFrame([(5, 16, 16), (5, 4, 16)], "z int, x long, y long")
    assert [(r.x, r.y) for r in geometry.tiles_in_polygons(inside, frame(spark, hole), 3).collect()] == [(4, 16)]


def test_degenerate_polygons(spark):
    odd = spark.createDataFrame([("null", None), ("empty", [[]]), ("point", [[{"x": 1.0, "y": 1.0}] * 3]), ("line", [[{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}]])], POLYGON)
    tiles = spark.createDataFrame([(0, 0, 0), (4, 8, 7), (4, 0, 0)], "z int, x long, y long")
    assert sorted((r.polygon, r.z) for r in geometry.meeting(tiles, odd).collect()) == [("line", 0), ("line", 4)]


def test_no_pairs_in_the_plan(spark):
    tiles = spark.createDataFrame([(4, 8, 7)], "z int, x long, y long")
    plan = geometry.meeting(tiles, frame(spark, {"a": [[(0, 0), (9, 0), (9, 9)]]}))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def fill(cells):
    """(number of areas joined by sides, area) of a set of grid cells."""
    rest, parts = set(cells), 0
    while rest:
        parts, queue = parts + 1, deque([rest.pop()])
        while queue:
            x, y = queue.popleft()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in rest:
                    rest.remove(c), queue.append(c)
    return parts


def rings(spark, cells):
    tiles = spark.createDataFrame([(9, x, y) for x, y in cells], "z int, x long, y long").repartition(3)
    return [(r.x, r.y, r.n_edges, r.area) for r in geometry.dissolved(geometry.tile_edges(tiles), ["z"], up=False).orderBy("x", "y", "area").collect()]


def test_union_of_tiles(spark):
    assert rings(spark, [(0, 0), (1, 0)]) == [(0, 0, 6, 2.0)]
    assert rings(spark, [(0, 0), (1, 1)]) == [(0, 0, 4, 1.0), (1, 1, 4, 1.0)]  # they touch in a point only
    block = [(x, y) for x in range(3) for y in range(3)]
    assert rings(spark, [c for c in block if c != (1, 1)]) == [(0, 0, 12, 9.0), (1, 1, 4, -1.0)]
    assert rings(spark, block + block) == [(0, 0, 12, 9.0)] and rings(spark, []) == []


def test_union_of_random_cells(spark):
    draw = random.Random(8)
    cells = {(x, y) for x in range(40) for y in range(40) if draw.random() < 0.6}
    got = rings(spark, sorted(cells))
    outside = {(x, y) for x in range(-1, 41) for y in range(-1, 41)} - cells
    assert sum(r[3] for r in got) == len(cells)
    assert sum(r[3] > 0 for r in got) >= fill(cells) and sum(r[2] for r in got) == sum((x + a, y + b) in outside for x, y in cells for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))


def test_hundred_thousand_boxes(spark):
    """Stripes of three rows with a gap, and a hole in each: long rings in a few rounds."""
    ids = spark.range(0, 100_800, 1, 8)
    tiles = ids.select(F.lit(12).alias("z"), (F.col("id") % 1200).alias("x"), (F.floor(F.col("id") / 1200) + F.floor(F.floor(F.col("id") / 1200) / 3)).alias("y"))
    tiles = tiles.filter((F.col("x") != 600) | (F.col("y") % 4 != 1))
    got = geometry.dissolved(geometry.tile_edges(tiles), ["z"], up=False).groupBy(F.col("area") > 0).agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.max("n_edges").alias("most")).collect()
    assert {(r[0], r.n, r.area, r.most) for r in got} == {(True, 28, 100_800.0, 2406), (False, 28, -28.0, 4)}


def test_polygons_that_share_a_border(spark):
    ring = lambda *p: [(*a, *b) for a, b in zip(p, p[1:] + p[:1])]
    edges = ring((0.0, 0.0), (2.0, 0.0), (1.0, 1.0)) + ring((2.0, 0.0), (2.0, 2.0), (1.0, 1.0))
    got = geometry.dissolved(spark.createDataFrame([("g", *e) for e in edges] + [("h", *e) for e in edges[:3]], "k string, x1 double, y1 double, x2 double, y2 double"), ["k"]).collect()
    assert {(r.k, r.x, r.y, r.n_edges, r.area) for r in got} == {("g", 0.0, 0.0, 4, 2.0), ("h", 0.0, 0.0, 3, 1.0)}
