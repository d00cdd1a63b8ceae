"""The stored uniqueness index: several runs, failures, compaction, clashes, and plans without a shuffle of what is stored."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievewright.operators import uniqueness
from sievewright.operators.uniqueness import UniqueIndex

SCHEMA = "_file_ord int, _row long, v string"


def frame(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def again(index, df):
    return [r[0] for r in index.marked(df, "v").orderBy("_row").select("__again_v").collect()]


def plain(seen, texts):
    out, seen = [], set(seen)
    for t in texts:
        out.append(bool(t) and t in seen)
        seen.add(t)
    return out


def test_three_runs(spark, tmp_path):
    draw, seen = random.Random(1), set()
    for run in range(3):
        texts = [draw.choice([None, "", "漢字", *map(str, range(60))]) for _ in range(80)]
        index = UniqueIndex(spark, f"file://{tmp_path}/index", 8)
        df = frame(spark, texts)
        assert again(index, df) == plain(seen, texts)
        new = {t for t in texts if t} - seen
        assert index.add(df, "v", f"run {run}") == len(new)
        seen |= new
        assert again(index, df) == [bool(t) for t in texts] and index.count() == len(seen)
    with pytest.raises(ValueError):
        index.add(df, "v", "run 1")
    index.compact()
    assert again(index, df) == [bool(t) for t in texts] and index.count() == len(seen) == index.accepted().count()
    index.clean()
    assert index.accepted().count() == len(seen)
    first = index.state()["runs"][0]["texts"]
    index.truncate("run 0")
    assert index.count() == first == index.accepted().count()
    index.compact(16)
    assert index.accepted().count() == first
    left = [t for t in texts if t]
    more = index.add(df, "v", "run 1")
    assert 0 < more < len(left) and index.count() == first + more and all(again(index, frame(spark, left)))
    assert index.add(frame(spark, []), "v", "empty") == 0


def test_unfinished_run_is_not_seen(spark, tmp_path, monkeypatch):
    index = UniqueIndex(spark, f"file://{tmp_path}/index", 4)
    index.add(frame(spark, ["a"]), "v", "one")
    monkeypatch.setattr(UniqueIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.add(frame(spark, ["a", "b"]), "v", "two")
    monkeypatch.undo()
    df = frame(spark, ["a", "b", "c", "b"])
    assert again(index, df) == [True, False, False, True] and index.count() == 1
    assert index.add(df, "v", "two") == 2
    index.compact(), index.clean()
    assert index.accepted().count() == 3


def test_two_writers(spark, tmp_path):
    index = UniqueIndex(spark, f"file://{tmp_path}/index", 4)
    state = index.state()
    index.add(frame(spark, ["a"]), "v", "one")
    with pytest.raises(RuntimeError):
        index._commit(state | {"runs": []})


def test_clashing_digests_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(uniqueness, "digest", lambda text: F.pmod(F.xxhash64(text), F.lit(3)).cast("bigint"))
    index = UniqueIndex(spark, f"file://{tmp_path}/index", 4)
    assert index.add(frame(spark, map(str, range(50))), "v", "one") == 50
    assert again(index, frame(spark, map(str, range(40, 60)))) == [i < 50 for i in range(40, 60)]


def test_stored_side_does_not_move(spark, tmp_path):
    index = UniqueIndex(spark, f"file://{tmp_path}/index", 4)
    for run in range(3):
        index.add(frame(spark, map(str, range(run, 100 + run))), "v", str(run))
    plan = index.marked(frame(spark, ["a"]), "v")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "digest" in line)
    indent = len(re.match(r"[\s:+\-|]*", lines[scan])[0])
    for line in reversed(lines[:scan]):  # the operators over the scan, up to the join
        depth = len(re.match(r"[\s:+\-|]*", line)[0])
        if depth < indent:
            indent = depth
            assert "Exchange" not in line
            if "SortMergeJoin" in line:
                break
    else:
        raise AssertionError(plan)
