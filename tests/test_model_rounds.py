"""Model columns under a budget: scripted clients, failures, aborts and restarts."""

import json
import os

import pytest

from sievewright.operators import model_rounds
from sievewright.operators.model_rounds import budgeted_columns


def scripted(log, fails=(), dies=()):
    """A client that logs every call to a folder and answers prompts ``ask x`` with x; batches with a failing word give no JSON."""

    def client(prompts):
        with open(f"{log}/{os.urandom(8).hex()}", "w") as f:
            f.write("\n".join(prompts))
        words = [p.removeprefix("ask ") for p in prompts]
        if any(w in dies for w in words):
            raise ConnectionError("gone")
        return "sorry" if any(w in fails for w in words) else json.dumps([{"o": w.upper(), "n": len(w)} for w in words])

    return client


def calls(log):
    return [open(f"{log}/{n}").read().split("\n") for n in os.listdir(log)]


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "t string")


def ask(spark, tmp_path, words, client, budget, **more):
    out, told = budgeted_columns(frame(spark, words), "ask ${t}", ["o", "n"], client, f"file://{tmp_path}/cache", budget, size=3, **more)
    return {r.t: (r.o, r.n) for r in out.collect()}, told


def test_equal_prompts_once_and_no_call_twice(spark, tmp_path, log):
    words = [f"w{i}" for i in range(10)] * 3
    got, told = ask(spark, tmp_path, words, scripted(log), 50)
    assert got == {w: (w.upper(), "2") for w in words} and told == {"calls": 4, "failed": 0, "aborted": False, "exhausted": False}
    assert sorted(p for c in calls(log) for p in c) == sorted({f"ask {w}" for w in words})
    got, told = ask(spark, tmp_path, [*words, "new"], scripted(log), 50)
    assert got["new"] == ("NEW", "3") and told["calls"] == 5 == len(calls(log))


def test_failed_batches_are_asked_alone(spark, tmp_path, log):
    got, told = ask(spark, tmp_path, [f"w{i}" for i in range(9)], scripted(log, fails=("w4",), dies=("w7",)), 50, abort=0.9)
    assert {w for w, v in got.items() if v == (None, None)} == {"w4", "w7"} and told["failed"] in (3, 4)
    asked = [p for c in calls(log) for p in c]
    assert max(map(asked.count, asked)) == 2 and told["calls"] == len(calls(log))


def test_never_more_calls_than_the_budget(spark, tmp_path, log):
    words = [f"w{i}" for i in range(30)]
    got, told = ask(spark, tmp_path, words, scripted(log, fails=("w3",)), 5, round_calls=2)
    assert told == {"calls": 5, "failed": 1, "aborted": False, "exhausted": True} and len(calls(log)) == 5
    got, told = ask(spark, tmp_path, words, scripted(log), 5)
    assert len(calls(log)) == 5 and sum(v[0] is not None for v in got.values()) == 12
    got, told = ask(spark, tmp_path, words, scripted(log), 100)
    assert not told["exhausted"] and all(v[0] for v in got.values())


def test_abort_ratio_holds_over_rounds_and_restarts(spark, tmp_path, log):
    words = [f"w{i}" for i in range(60)]
    got, told = ask(spark, tmp_path, words, scripted(log, fails=words), 100, least=4, round_calls=2)
    assert told == {"calls": 4, "failed": 4, "aborted": True, "exhausted": False} and len(calls(log)) == 4
    assert ask(spark, tmp_path, words, scripted(log), 100)[1]["calls"] == 4  # aborted for good


def test_restart_in_a_round_asks_nothing_twice(spark, tmp_path, log, monkeypatch):
    words = [f"w{i}" for i in range(12)]
    monkeypatch.setattr(model_rounds.PromptCache, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ask(spark, tmp_path, words, scripted(log), 10)
    monkeypatch.undo()
    assert len(calls(log)) == 4
    claims = [n for n in os.listdir(tmp_path / "cache") if n.startswith("round-")]
    reply = next(n for n in os.listdir(tmp_path / "cache" / claims[0]) if n.endswith(".reply"))
    os.remove(tmp_path / "cache" / claims[0] / reply)  # a task that was lost between its call and the reply
    got, told = ask(spark, tmp_path, words, scripted(log), 10)
    asked = [p for c in calls(log) for p in c]
    assert all(v[0] for v in got.values()) and told["calls"] == len(calls(log)) <= 10 and told["failed"] == 1
    assert sorted(p for p in asked if asked.count(p) == 1) and len(asked) == 12 + 3  # only the lost batch, by prompt


def test_nothing_to_ask(spark, tmp_path, log):
    assert ask(spark, tmp_path, [], scripted(log), 10)[0] == {} and ask(spark, tmp_path, ["a"], scripted(log), 0)[0] == {"a": (None, None)} and calls(log) == []
