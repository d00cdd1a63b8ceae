"""ZIP archives of inputs and outputs. Entries are copied in pieces, so no file is held whole."""

from __future__ import annotations

import os
import shutil
import zipfile
from pathlib import Path, PurePosixPath

INPUTS = frozenset((".csv", ".tsv", ".txt", ".jsonl", ".ndjson", ".json", ".xlsx", ".xlsm", ".parquet"))
ENTRIES = 10_000
PIECE = 1 << 20
LINK = 0o120000


def unpacked(archive: str, folder: str, kinds: frozenset[str] = INPUTS, entries: int = ENTRIES) -> list[dict]:
    """Unpack the entries with a known ending; absolute paths, parents and links are refused, and so is what the disk cannot hold."""
    out = []
    with zipfile.ZipFile(archive) as package:
        found = [i for i in package.infolist() if not i.is_dir()]
        if len(found) > entries:
            raise ValueError(f"{len(found)} entries, {entries} at most")
        for i in found:
            path = PurePosixPath(i.filename.replace("\\", "/"))
            if path.is_absolute() or ".." in path.parts or ":" in path.parts[0] or (i.external_attr >> 16) & 0o170000 == LINK:
                raise ValueError(f"unsafe entry {i.filename!r}")
        for i in found:
            path = PurePosixPath(i.filename.replace("\\", "/"))
            if path.suffix.lower() not in kinds:
                continue
            target = Path(folder, *path.parts)
            target.parent.mkdir(parents=True, exist_ok=True)
            if shutil.disk_usage(target.parent).free < i.file_size:
                raise OSError(f"no room for {i.filename!r}")
            with package.open(i) as source, open(target, "wb") as sink:
                shutil.copyfileobj(source, sink, PIECE)
            out.append({"path": path.as_posix(), "size": target.stat().st_size})
    return out


def packed(archive: str, folder: str, **more: str) -> list[str]:
    """A task's output files as one ZIP, without Spark's own markers, and ``more`` texts by name with ``__`` for a dot; written aside and renamed when whole."""
    names, aside = [], f"{archive}.part"
    with zipfile.ZipFile(aside, "w", zipfile.ZIP_DEFLATED) as package:
        for path in sorted(p for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith(("_", "."))):
            names.append(path.relative_to(folder).as_posix())
            package.write(path, names[-1])
        for name, text in more.items():
            names.append(name.replace("__", "."))
            package.writestr(names[-1], text)
    os.replace(aside, archive)
    return names
