"""Language-model columns under a hard budget of calls, with a stored cache of prompts.

Prompts are asked in rounds. A round takes the next distinct prompts that the cache does not hold, as many as the calls that are left allow, deals them into batches of one call
each and commits the answers as one Parquet part. Before a task calls, it leaves a claim for the batch in the round's folder, and right after the call the reply; a
repeated task finds the reply, or a claim without one, which counts as a spent call and is not made again. So there are never more calls than the budget, over all tasks, rounds
and restarts, and nothing that was answered is asked twice. A prompt without a usable answer is asked again alone in a later round, up to ``tries`` calls in all.

Tasks look at the claims and failures of the round before each call: once at least ``least`` calls are made and more than ``abort`` of them failed, nothing more is called.

Cases: equal prompts are one; a reply that is not a JSON array of one object for each prompt is a failure, and so is an exception of the client; outputs that an object does not have are null, as
are all outputs of prompts never answered; an empty table calls nothing; a budget of 0 only reads the cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import patterns
from sievewright.operators.clean import text_of
from sievewright.sources.work import Folder

SIZE, TRIES, ABORT, LEAST, ROUND_CALLS = 10, 2, 0.5, 20, 1000


class PromptCache:
    """Answers by prompt key in a folder: committed Parquet parts, and documents with the calls spent."""

    def __init__(self, spark: SparkSession, path: str, outputs: list[str]) -> None:
        self.spark, self.folder, self.outputs = spark, Folder(spark, path), list(outputs)
        if not self._names():
            self.folder.create("state-0000000000", {"outputs": self.outputs, "parts": [], "calls": 0, "failed": 0, "aborted": False})
        if self.state()["outputs"] != self.outputs:
            raise ValueError(f"the cache holds {self.state()['outputs']}")

    def _names(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("state-")]

    def state(self) -> dict:
        return self.folder.read(self._names()[-1])

    def commit(self, state: dict) -> None:
        if not self.folder.create(f"state-{int(self._names()[-1][6:16]) + 1:010d}", state):
            raise RuntimeError("another run has changed the cache since this one began")

    def schema(self) -> str:
        return "key string, tries int, answered boolean, " + ", ".join(f"`{o}` string" for o in self.outputs)

    def answers(self) -> DataFrame:
        """(key, tries, answered, outputs): what the last round that asked a prompt got, and the calls of all rounds."""
        parts = [f"{self.folder.path}/{p}" for p in self.state()["parts"]]
        if not parts:
            return self.spark.createDataFrame([], self.schema())
        rows = self.spark.read.schema(self.schema()).parquet(*parts)
        best = F.max_by(F.struct("answered", *self.outputs), F.struct("answered", "tries"))
        return rows.groupBy("key").agg(F.sum("tries").cast("int").alias("tries"), best.alias("b")).select("key", "tries", "b.*")


def _parsed(reply: str, n: int) -> list[dict] | None:
    try:
        got = json.loads(reply)
    except ValueError:
        return None
    return got if isinstance(got, list) and len(got) == n and all(isinstance(g, dict) for g in got) else None


def _asker(client: Callable[[list[str]], str], outputs: list[str], uri: str, before: tuple[int, int], abort: float, least: int):
    """What a task does with a batch: claim, call, keep the reply."""

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("key")
        fs, folder = pafs.FileSystem.from_uri(uri)
        name = hashlib.sha256(" ".join(batch["key"]).encode()).hexdigest()
        fs.create_dir(folder)
        there = [f.base_name for f in fs.get_file_info(pafs.FileSelector(folder))]
        got, called = None, True
        if f"{name}.reply" in there:
            with fs.open_input_stream(f"{folder}/{name}.reply") as f:
                got = _parsed(f.read().decode(), len(batch))
        elif f"{name}.claim" not in there:
            calls, failed = before[0] + sum(n.endswith(".claim") for n in there), before[1] + sum(n.endswith(".failed") for n in there)
            if calls >= least and failed > abort * calls:
                called = False
            else:
                with fs.open_output_stream(f"{folder}/{name}.claim"):
                    pass
                try:
                    reply = client(batch["prompt"].tolist())
                except Exception as e:  # noqa: BLE001  the call's own failure
                    reply = repr(e)
                got = _parsed(reply, len(batch))
                if got is None:
                    with fs.open_output_stream(f"{folder}/{name}.failed"):
                        pass
                with fs.open_output_stream(f"{folder}/{name}.draft") as f:
                    f.write(reply.encode())
                fs.move(f"{folder}/{name}.draft", f"{folder}/{name}.reply")
        rows = got or [{}] * len(batch)
        made = {o: [None if g.get(o) is None else str(g[o]) for g in rows] for o in outputs}
        return pd.DataFrame({"key": batch["key"].tolist(), "tries": int(called), "answered": got is not None, **made})

    return ask


def budgeted_columns(
    rows: DataFrame, prompt: str, outputs: list[str], client: Callable[[list[str]], str], path: str, budget: int,
    size: int = SIZE, tries: int = TRIES, abort: float = ABORT, least: int = LEAST, round_calls: int = ROUND_CALLS,
) -> tuple[DataFrame, dict]:
    """The rows with the outputs, and (calls, failed, aborted, exhausted) of the cache in ``path`` over all runs; ``budget`` bounds its calls in all."""
    cache = PromptCache(rows.sparkSession, path, outputs)
    cells = {c: text_of(rows, c) for c in rows.columns}
    asked = rows.withColumn("__prompt", patterns.render(prompt, cells)).withColumn("__key", F.sha2("__prompt", 256))
    prompts = asked.groupBy(F.col("__key").alias("key")).agg(F.first("__prompt").alias("prompt"))
    exhausted = False
    while not (state := cache.state())["aborted"]:
        known = cache.answers()
        todo = prompts.join(known.select("key", "tries", "answered"), "key", "left").filter(f"NOT coalesce(answered, false) AND coalesce(tries, 0) < {int(tries)}")
        calls = min(budget - state["calls"], round_calls)
        # as many prompts as the calls can take; new ones before those that failed, which go alone
        some = todo.select("key", "prompt", F.coalesce("tries", F.lit(0)).alias("tries")).orderBy("tries", "key").limit(max(0, calls) * size)
        place = Window.orderBy("tries", "key")  # over no more rows than the round's calls take
        numbered = some.withColumn("nth", F.row_number().over(place) - 1).withColumn("fresh", F.count_if(F.col("tries") == 0).over(Window.partitionBy()))
        batch = F.when(F.col("tries") == 0, F.floor(F.col("nth") / size)).otherwise(F.ceil(F.col("fresh") / size) + F.col("nth") - F.col("fresh"))
        dealt = numbered.withColumn("batch", batch.cast("bigint")).filter(F.col("batch") < calls).select("key", "prompt", "batch")
        wanted = todo.limit(1).count()
        if not wanted or calls <= 0:
            exhausted = bool(wanted)
            break
        nth = int(cache._names()[-1][6:16])
        claims, part = f"{cache.folder.path}/round-{nth:010d}", f"part-{nth:010d}"
        ask = _asker(client, cache.outputs, claims, (state["calls"], state["failed"]), abort, least)
        made = dealt.groupBy("batch").applyInPandas(ask, cache.schema())
        made.write.mode("overwrite").parquet(f"{cache.folder.path}/{part}")
        there = Folder(cache.spark, claims).names()
        calls, failed = (state[k] + sum(n.endswith(e) for n in there) for k, e in (("calls", ".claim"), ("failed", ".failed")))
        lost = sum(n.endswith(".claim") for n in there) - sum(n.endswith(".reply") for n in there)
        cache.commit(state | {"parts": [*state["parts"], part], "calls": calls, "failed": failed + lost, "aborted": calls >= least and failed + lost > abort * calls})
        cache.folder.remove(f"round-{nth:010d}")
    found = cache.answers().select(F.col("key").alias("__key"), *cache.outputs)
    told = cache.state()
    return asked.drop(*cache.outputs).join(found, "__key", "left").drop("__key", "__prompt"), {k: told[k] for k in ("calls", "failed", "aborted")} | {"exhausted": exhausted}
