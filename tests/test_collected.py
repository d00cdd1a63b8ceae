"""A stream of numbered files: nothing lost or repeated over restarts, late files, and a seen-set that forgets."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sievewright.streaming import collected


def put(folder, number, rows, extra=""):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{number:010d}.jsonl").write_text("\n".join(map(json.dumps, rows)) + extra)


def passed(spark, tmp_path, seconds=None, plain=False, out="out"):
    """Everything that is there, through the stream from its checkpoint on; all rows so far in the output."""
    stream = collected.read_stream(spark, f"file://{tmp_path}/in", ["url", "title"])
    query = (stream if plain else collected.unseen(stream, "url", seconds)).writeStream.format("json").option("checkpointLocation", f"{tmp_path}/check-{out}").option("path", f"{tmp_path}/{out}").start()
    until = time.time() + 90
    try:
        if seconds is None:
            query.processAllAvailable()
        else:  # with timers a query always has another batch to run
            done = lambda: any(p.numInputRows for p in query.recentProgress)  # noqa: E731  of a batch that is committed
            while not done() and query.exception() is None and time.time() < until:
                time.sleep(0.5)
    finally:
        query.stop()
    schema = "file long, line long, bad boolean, url string, title string"
    return sorted((r.file, r.line, r.url) for r in spark.read.schema(schema).json(f"{tmp_path}/{out}").collect())


def page(i):
    return {"url": f"http://a/{i}", "title": [i], "other": 1}


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    put(tmp_path / "in", 1, [page(1), page(2), page(1)])
    put(tmp_path / "in", 2, [page(2), page(3)])
    want = [(1, 0, "http://a/1"), (1, 1, "http://a/2"), (2, 1, "http://a/3")]
    assert passed(spark, tmp_path) == want
    put(tmp_path / "in", 3, [page(3), page(4)])
    put(tmp_path / "in", 5, [page(6)])  # number 4 is late
    assert passed(spark, tmp_path) == [*want, (3, 1, "http://a/4")]
    put(tmp_path / "in", 4, [page(5), page(1)])
    assert passed(spark, tmp_path) == [*want, (3, 1, "http://a/4"), (4, 0, "http://a/5"), (5, 0, "http://a/6")]
    assert passed(spark, tmp_path) == [*want, (3, 1, "http://a/4"), (4, 0, "http://a/5"), (5, 0, "http://a/6")]


def test_failure_in_a_batch(spark, tmp_path):
    """A batch that failed comes again whole, with the same rows."""
    put(tmp_path / "in", 1, [page(1), page(2)])
    assert len(passed(spark, tmp_path, plain=True)) == 2
    put(tmp_path / "in", 2, [page(3), page(3)])
    stream = collected.read_stream(spark, f"file://{tmp_path}/in", ["url", "title"])
    broken = stream.withColumn("title", F.when(F.col("url").endswith("3"), F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    query = broken.writeStream.format("json").option("checkpointLocation", f"{tmp_path}/check-out").option("path", f"{tmp_path}/out").start()
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    query.stop()
    put(tmp_path / "in", 3, [page(4)])
    assert [(f, n) for f, n, _ in passed(spark, tmp_path, plain=True)] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]


def test_bad_lines_and_null_keys(spark, tmp_path):
    put(tmp_path / "in", 1, [{"title": "no url"}, {"url": None}], "\nnot json\n[1]\n\n")
    (tmp_path / "in" / "page-x.jsonl").write_text("{}"), (tmp_path / "in" / "notes.txt").write_text("x")
    assert passed(spark, tmp_path, plain=True, out="all") == [(1, n, None) for n in range(4)]
    assert passed(spark, tmp_path) == [(1, 0, None)]


def test_keys_are_forgotten(spark, tmp_path):
    put(tmp_path / "in", 1, [page(1)])
    assert len(passed(spark, tmp_path, 4.0)) == 1
    put(tmp_path / "in", 2, [page(1)])
    time.sleep(5)
    assert len(passed(spark, tmp_path, 4.0)) == 2
