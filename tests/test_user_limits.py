"""User functions in supervised processes: endless loops, allocations, crashes, restarts and what passes through."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sievewright.operators import userfn
from sievewright.operators.userfn import Limits, Supervised
from sievewright.plans.config import ConfigError, Function

CODE = """
import re
SEEN = []
def transform(row):
    SEEN.append(1)
    v = row['v']
    if v == 'loop':
        while True:
            pass
    if v == 'much':
        return {'w': 'x' * (1 << 32)}
    if v == 'leave':
        raise SystemExit(3)
    if v == 'bad':
        raise KeyError('no')
    print('noise' * 100)
    return {'w': v.upper(), 'n': len(SEEN), 'other': 'not asked for'}
"""


def ran(spark, values, mode="row", code=CODE, on_error="keep", **limits):
    df = spark.createDataFrame([(i, v, "old") for i, v in enumerate(values)], "i int, v string, w string").coalesce(1).sortWithinPartitions("i")
    out = userfn.apply_function(df, code, ["v"], ["w", "n"], mode, on_error, Limits(**({"rows": 2, "seconds": 2} | limits)))
    assert out.columns == ["i", "v", "w", "n", "_error"]
    return [(r.w, r.n, r._error) for r in out.orderBy("i").collect()]


def test_same_results_as_without_limits_and_one_child_for_all_batches(spark):
    assert ran(spark, ["a", "bad", "c", "d", "e"]) == [("A", "1", None), ("old", None, "KeyError: 'no'"), ("C", "3", None), ("D", "4", None), ("E", "5", None)]
    column = "def transform(c):\n    if 'bad' in c['v']:\n        return {'w': []}\n    return {'w': [len(v) for v in c['v']]}\n"
    assert ran(spark, ["a", "bb", "bad", "d"], "column", column, "empty") == [("1", None, None), ("2", None, None), ("", "", "ValueError: columns of another length"), ("", "", "ValueError: columns of another length")]


def test_endless_loop(spark):
    began = time.time()
    got = ran(spark, ["a", "b", "loop", "c", "d"], seconds=1)
    assert got == [("A", "1", None), ("B", "2", None), *[("old", None, "timeout: no answer in 1 s")] * 2, ("D", "1", None)] and time.time() - began < 40


def test_allocation(spark):
    got = ran(spark, ["much", "a"], memory_mb=256, seconds=20)
    assert got[0][0] == "old" and ("MemoryError" in got[0][2] or "crash" in got[0][2]) and got[1] in (("A", "2", None), ("old", None, got[0][2]))


def test_fifth_crash_turns_the_function_off(spark):
    df = ["leave", "a"] * 5 + ["b", "c"]
    got = ran(spark, df, restarts=4)
    assert all(g[2].startswith("crash") for g in got[:10]) and got[10:] == [("old", None, "disabled: 5 children of the function were lost")] * 2
    assert ran(spark, df, restarts=5)[10:] == [("B", "1", None), ("C", "2", None)]


def test_code_that_does_not_load(spark):
    got = ran(spark, ["a", "b", "c"], code="X = 1 / 0\ndef transform(row):\n    return {}\n")
    assert [g[2].split(":")[0] for g in got] == ["ZeroDivisionError", "ZeroDivisionError", "disabled"]


def test_children_end_with_their_task():
    child = Supervised(CODE, "row", ["w"], Limits())
    assert child.ask({"rows": [{"v": "a"}]}) == {"rows": [[{"w": "A"}, None]]}
    pid = child.process.pid
    child.close()
    with pytest.raises(ProcessLookupError):
        os.kill(pid, 0)


def test_failures_are_counted(spark):
    df = spark.createDataFrame([("timeout: x",), ("timeout: y",), (None,), ("KeyError: a: b",)], "_error string")
    assert {r.kind: r.n for r in userfn.failures(df).collect()} == {"timeout": 2, "KeyError": 1}


def test_limits_in_a_task():
    f = Function("f", CODE, ("v",), ("w",), limits={"seconds": 1.5})
    assert f.limits == Limits(seconds=1.5)
    for bad in ({"seconds": 0}, {"colour": 1}, {"memory_mb": 1}):
        with pytest.raises(ConfigError):
            Function("f", CODE, ("v",), ("w",), limits=bad)
