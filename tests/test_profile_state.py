"""Profiles merged from stored state: equal to the profile of everything, without reading anything twice."""

import math
import os
import random
import statistics

import pytest

from sievewright.operators import profile_state
from sievewright.operators.profile_state import ProfileStore

FIELDS = ["a", "b"]


@pytest.fixture
def files(spark, tmp_path):
    draw, out = random.Random(5), []
    for n in range(4):
        rows = [(draw.choice([None, "", "x", "yy", *map(str, range(300))]), str(round(draw.lognormvariate(2, 2), 3)) if draw.random() < 0.98 else "n/a") for _ in range(3000 * (n > 0))]
        path = f"file://{tmp_path}/in/{n}"
        spark.createDataFrame(rows, "a string, b string").write.parquet(path)
        out.append((path, rows))
    return out


def shown(rows):
    """Exact parts of a profile."""
    return {r.field: (r.n, r.n_empty, r.codes, r.min_length, r.max_length, round(r.mean_length, 9), r.n_numbers, r.numeric, round(r["mean"], 6), round(r.stddev, 6), r.least, r.most, [(f["item"], f["count"]) for f in r.frequent]) for r in rows}


def test_one_at_a_time_equals_all(spark, files, tmp_path):
    store = ProfileStore(spark, f"file://{tmp_path}/one", FIELDS)
    for path, _ in files:
        assert ProfileStore(spark, f"file://{tmp_path}/one").refresh([path], lambda p: spark.read.parquet(*p)) == [path]
    whole = ProfileStore(spark, f"file://{tmp_path}/all", FIELDS)
    whole.add([p for p, _ in files], spark.read.parquet(*[p for p, _ in files]))
    a, b = store.profile().collect(), whole.profile().collect()
    assert shown(a) == shown(b)
    every = [r for _, rows in files for r in rows]
    numbers = [float(v) for _, v in every if v != "n/a"]
    got = next(r for r in a if r.field == "b")
    assert got.n == len(every) and math.isclose(got["mean"], statistics.fmean(numbers)) and math.isclose(got.stddev, statistics.stdev(numbers))
    for r in (got, next(r for r in b if r.field == "b")):
        for q, v in zip((0.5, 0.95), r.percentiles, strict=True):
            ranks = [sum(x < v for x in numbers) / len(numbers), sum(x <= v for x in numbers) / len(numbers)]
            assert ranks[0] - profile_state.RANK_ERROR <= q <= ranks[1] + profile_state.RANK_ERROR
    distinct = len({t for t, _ in every if t})
    assert abs(next(r for r in a if r.field == "a").n_distinct - distinct) <= 0.04 * distinct
    store.compact(), store.clean()
    assert shown(store.profile().collect()) == shown(a) and len([n for n in os.listdir(tmp_path / "one") if n.startswith("part-")]) == 1
    assert store.sources().count() == 4


def test_old_files_are_not_read_again(spark, files, tmp_path):
    store, asked = ProfileStore(spark, f"file://{tmp_path}/s", FIELDS), []
    read = lambda paths: asked.append(paths) or spark.read.parquet(*paths)
    paths = [p for p, _ in files]
    store.refresh(paths[:3], read)
    assert store.refresh(paths, read) == paths[3:] and store.refresh(paths, read) == []
    assert asked == [paths[:3], paths[3:]]
    scanned = {os.path.dirname(f) for f in store.profile().inputFiles()}
    assert scanned and all("/s/part-" in d and d.endswith("/state") for d in scanned)
    with pytest.raises(ValueError):
        store.add(paths[:1], spark.read.parquet(paths[0]))


def test_unfinished_and_empty(spark, files, tmp_path, monkeypatch):
    store = ProfileStore(spark, f"file://{tmp_path}/s", FIELDS)
    assert [(r.field, r.n, r.percentiles, r.frequent) for r in store.profile().orderBy("field").collect()] == [("a", 0, None, None), ("b", 0, None, None)]
    monkeypatch.setattr(ProfileStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.refresh([files[1][0]], lambda p: spark.read.parquet(*p))
    monkeypatch.undo()
    assert store.sources().count() == 0
    store.refresh([files[1][0]], lambda p: spark.read.parquet(*p))
    assert {r.field: r.n for r in store.profile().collect()} == {"a": 3000, "b": 3000}
    with pytest.raises(ValueError):
        ProfileStore(spark, f"file://{tmp_path}/s", ["c"])
