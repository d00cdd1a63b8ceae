"""User functions over rows or columns, checked before they run and with failures kept by row.

With ``Limits`` a function runs in a child process of each Python worker, started once and used for all batches of a task: a batch that takes too long, runs out of memory or ends the
process fails as a whole, its rows pass through with the reason in ``_error``, and the next batch gets a new child. After ``restarts`` new children the function is off
for the rest of the task: rows pass through unchanged with ``disabled`` as the reason.
"""

from __future__ import annotations

import ast
import contextlib
import dataclasses
import json
import os
import select
import signal
import struct
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievewright.operators import child

# Modules a function may import, and names it may not use.
MODULES = ("re", "math", "json", "datetime", "decimal", "string", "unicodedata", "hashlib", "statistics", "collections", "itertools", "functools")
BANNED = ("eval", "exec", "compile", "open", "input", "__import__", "globals", "locals", "vars", "getattr", "setattr", "delattr", "breakpoint", "exit", "quit")


def problems(code: str) -> list[str]:
    """Why the code may not run; empty if it may."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"line {e.lineno}: {e.msg}"]
    out = []
    for n in ast.walk(tree):
        names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
        out += [f"line {n.lineno}: import of {m}" for m in names if m.split(".")[0] not in MODULES]
        if isinstance(n, ast.Name) and n.id in BANNED:
            out.append(f"line {n.lineno}: use of {n.id}")
        if isinstance(n, ast.Attribute) and n.attr.startswith("__"):
            out.append(f"line {n.lineno}: attribute {n.attr}")
    out += [f"line {n.lineno}: loop outside a function" for n in tree.body if isinstance(n, (ast.For, ast.While))]
    if not any(isinstance(n, ast.FunctionDef) and n.name == "transform" for n in tree.body):
        out.append("no function transform")
    return out


def _loaded(code: str):
    space: dict = {}
    exec(compile(code, "<user function>", "exec"), space)  # noqa: S102  checked by ``problems``
    return space["transform"]


@dataclasses.dataclass(frozen=True)
class Limits:
    """Seconds for a batch and for a start, memory of the child, new children for a task, rows of a batch."""

    seconds: float = 5.0
    start_seconds: float = 30.0
    memory_mb: int = 1024
    restarts: int = 5
    rows: int = 2000

    def __post_init__(self) -> None:
        if self.seconds <= 0 or self.start_seconds <= 0 or self.memory_mb < 64 or self.restarts < 0 or self.rows < 1:
            raise ValueError("limits: seconds above 0, memory of 64 MB or more, restarts of 0 or more, rows of 1 or more")


class Inside:
    """The function in the worker itself, without limits."""

    def __init__(self, code: str, mode: str, outputs: list[str]) -> None:
        self.f, self.mode, self.outputs = _loaded(code), mode, outputs

    def ask(self, question: dict) -> dict:
        try:
            return {"rows": child.rows(self.f, question["rows"], self.outputs)} if self.mode == "row" else {"columns": child.columns(self.f, question["columns"], question["n"], self.outputs)}
        except Exception as e:  # noqa: BLE001
            return {"failure": child.said(e)}

    def close(self) -> None:
        pass


class Supervised:
    """A child process that answers one question at a time; killed with its group when it is late."""

    def __init__(self, code: str, mode: str, outputs: list[str], limits: Limits) -> None:
        self.start, self.limits, self.process, self.log, self.starts = {"code": code, "mode": mode, "outputs": outputs, "memory_mb": limits.memory_mb}, limits, None, None, 0

    def close(self) -> None:
        if self.process:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(self.process.pid, signal.SIGKILL)
            self.process.stdout.close()
            with contextlib.suppress(BrokenPipeError):
                self.process.stdin.close()
            self.process.wait()
            self.log.close()
            self.process = None

    def _send(self, value: dict) -> None:
        data = json.dumps(value, default=str).encode()
        self.process.stdin.write(struct.pack(">I", len(data)) + data)
        self.process.stdin.flush()

    def _answer(self, seconds: float) -> dict:
        """The child's next frame; TimeoutError or EOFError if there is none."""
        data, need, until = bytearray(), 4, time.monotonic() + seconds
        while len(data) < need:
            if not select.select([self.process.stdout], [], [], max(0.0, until - time.monotonic()))[0]:
                raise TimeoutError
            got = os.read(self.process.stdout.fileno(), 1 << 16)
            if not got:
                raise EOFError
            data += got
            if need == 4 and len(data) >= 4:
                need = 4 + struct.unpack(">I", data[:4])[0]
        return json.loads(data[4:])

    def _last_words(self) -> str:
        self.log.seek(max(0, os.fstat(self.log.fileno()).st_size - 200))
        return " ".join(self.log.read().decode("utf-8", "replace").split())[-120:]

    def ask(self, question: dict) -> dict:
        if not self.process:
            if self.starts > self.limits.restarts:
                return {"failure": f"disabled: {self.starts} children of the function were lost"}
            self.starts += 1
            self.log = tempfile.TemporaryFile()
            self.process = subprocess.Popen([sys.executable, "-I", str(Path(child.__file__))], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=self.log, start_new_session=True)
            began = True
        else:
            began = False
        limit = self.limits.seconds
        try:
            if began:
                limit = self.limits.start_seconds
                self._send(self.start)
                ready = self._answer(limit)
                if "failure" in ready:
                    self.close()
                    self.starts = self.limits.restarts + 1  # its code will not load the next time either
                    return {"failure": ready["failure"]}
                limit = self.limits.seconds
            self._send(question)
            return self._answer(limit)
        except TimeoutError:
            self.close()
            return {"failure": f"timeout: no answer in {limit:g} s"}
        except (EOFError, BrokenPipeError, ConnectionResetError):
            words = self._last_words()
            self.close()
            return {"failure": f"crash: the child ended{': ' + words if words else ''}"}


def apply_function(df: DataFrame, code: str, inputs: list[str], outputs: list[str], mode: str = "row", on_error: str = "keep", limits: Limits | None = None) -> DataFrame:
    """Adds or replaces the output columns as text, and ``_error`` with each failed row's message.

    Row mode: transform(dict) -> dict or None (None: unchanged). Column mode: transform({name: list}) -> {name: list} of
    equal length, per Arrow batch; a batch that fails marks all its rows. ``on_error`` empty blanks the outputs of
    failed rows, keep leaves their values. ``limits`` put the function into a supervised process; a batch then has at most ``limits.rows`` rows.
    """
    if found := problems(code):
        raise ValueError("; ".join(found))
    if mode not in ("row", "column") or on_error not in ("empty", "keep"):
        raise ValueError("mode is row or column; on_error is empty or keep")
    base = df.withColumns({o: F.lit(None).cast("string") if o not in df.columns else F.col(o).cast("string") for o in outputs})
    schema = StructType([*[f for f in base.schema if f.name != "_error"], StructField("_error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with contextlib.closing(Inside(code, mode, outputs) if limits is None else Supervised(code, mode, outputs, limits)) as runner:
            for whole in batches:
                for at in range(0, len(whole), limits.rows if limits else max(1, len(whole))):
                    b = whole.iloc[at : at + limits.rows].copy() if limits else whole
                    new = {o: b[o].tolist() for o in outputs}
                    errors: list[str | None] = [None] * len(b)
                    if mode == "row":
                        answer = runner.ask({"rows": b[inputs].to_dict("records")})
                        for i, (made, error) in enumerate(answer.get("rows", ())):
                            errors[i] = error
                            for o, v in made.items():
                                new[o][i] = v
                    else:
                        answer = runner.ask({"columns": {n: b[n].tolist() for n in inputs}, "n": len(b)})
                        new |= answer.get("columns", {})
                    if "failure" in answer:
                        errors = [answer["failure"]] * len(b)
                    for o in outputs:
                        b[o] = ["" if e and on_error == "empty" else v for v, e in zip(new[o], errors, strict=True)]
                    yield b.assign(_error=errors)[schema.names]

    return base.drop("_error").mapInPandas(run, schema)


def failures(df: DataFrame, name: str = "_error") -> DataFrame:
    """How many rows failed, by kind: timeout, crash, disabled or the error's class."""
    return df.filter(F.col(name).isNotNull()).groupBy(F.substring_index(name, ":", 1).alias("kind")).agg(F.count("*").alias("n"))
