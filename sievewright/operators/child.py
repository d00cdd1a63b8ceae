"""Runs one user function in a process of its own: reads frames from standard input, answers each with one.

A frame is a length and JSON. Started by ``userfn.Supervised`` by path, so it imports nothing of the package. What the function prints goes to
standard error; memory is bounded by the system before the function's code is loaded.
"""

import json
import os
import resource
import struct
import sys


def read(stream):
    head = stream.read(4)
    return json.loads(stream.read(struct.unpack(">I", head)[0])) if len(head) == 4 else None


def write(stream, value):
    data = json.dumps(value).encode()
    stream.write(struct.pack(">I", len(data)) + data)
    stream.flush()


def shown(v):
    return None if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def said(e):
    return f"{type(e).__name__}: {e}"[:300]


def rows(f, given, outputs):
    """For each row its changed outputs and, where it failed, why."""
    out = []
    for row in given:
        try:
            made = f(row)
            if made is not None and not isinstance(made, dict):
                raise TypeError("a row function gives a dict or None")
            out.append([{o: shown(made[o]) for o in outputs if o in made} if made else {}, None])
        except Exception as e:
            out.append([{}, said(e)])
    return out


def columns(f, given, n, outputs):
    made = f(given)
    if any(len(v) != n for v in made.values()):
        raise ValueError("columns of another length")
    return {o: list(map(shown, made[o])) for o in outputs if o in made}


def main():
    answers = os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)
    start = read(sys.stdin.buffer)
    limit = start["memory_mb"] << 20
    resource.setrlimit(resource.RLIMIT_AS, (limit, limit))
    resource.setrlimit(resource.RLIMIT_FSIZE, (10 << 20, 10 << 20))  # of what it prints
    try:
        space = {}
        exec(compile(start["code"], "<user function>", "exec"), space)
        f = space["transform"]
    except BaseException as e:
        write(answers, {"failure": said(e)})
        return
    write(answers, {"ready": True})
    while (ask := read(sys.stdin.buffer)) is not None:
        try:
            if start["mode"] == "row":
                write(answers, {"rows": rows(f, ask["rows"], start["outputs"])})
            else:
                write(answers, {"columns": columns(f, ask["columns"], ask["n"], start["outputs"])})
        except Exception as e:
            write(answers, {"failure": said(e)})


if __name__ == "__main__":
    main()
