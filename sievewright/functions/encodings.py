"""Which encoding bytes are in: by their mark, by NUL bytes, by strict UTF-8, else by likelihood.

Every candidate encoding has a model of the text that is usually written in it: the share of ASCII, and how the rest falls into classes of characters, each as
likely as any other of its class. The classes come from the layout of the public character sets (common characters have rows of their own, apart from rare ones), so no sample texts are needed.
A text's likelihood is that of the characters its bytes decode to, for each byte; a byte that decodes to nothing costs as much as a very rare character. Right decodings
fall into the common classes; wrong ones scatter over the rare ones. In Western text letters beyond ASCII stand between ASCII letters, in Cyrillic text beside their like, so the opposite costs more.
"""

from __future__ import annotations

import codecs
import functools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
FAULT, RARE = math.log(1e-9), math.log(1e-7)
HEAD = 1 << 16
# Rows of two-byte characters as (first leads, last leads, first trail, last trail, share): the common ones of each set.
ROWS = {
    "gb18030": ((0xB0, 0xD7, 0xA1, 0xFE, 0.90), (0xD8, 0xF7, 0xA1, 0xFE, 0.02), (0xA1, 0xA3, 0xA1, 0xFE, 0.07)),
    "big5": ((0xA4, 0xC6, 0x40, 0x7E, 0.45), (0xA4, 0xC6, 0xA1, 0xFE, 0.45), (0xC9, 0xF9, 0x40, 0x7E, 0.01), (0xC9, 0xF9, 0xA1, 0xFE, 0.01), (0xA1, 0xA2, 0x40, 0xFE, 0.07)),
    "shift_jis": ((0x82, 0x82, 0x9F, 0xF1, 0.45), (0x83, 0x83, 0x40, 0x96, 0.15), (0x88, 0x97, 0x40, 0xFC, 0.30), (0x98, 0x9F, 0x40, 0xFC, 0.01), (0x81, 0x81, 0x40, 0xFC, 0.08)),
    "euc_jp": ((0xA4, 0xA4, 0xA1, 0xF3, 0.45), (0xA5, 0xA5, 0xA1, 0xF6, 0.15), (0xB0, 0xCF, 0xA1, 0xFE, 0.30), (0xD0, 0xF4, 0xA1, 0xFE, 0.01), (0xA1, 0xA1, 0xA1, 0xFE, 0.08)),
    "euc_kr": ((0xB0, 0xC8, 0xA1, 0xFE, 0.93), (0xCA, 0xFD, 0xA1, 0xFE, 0.01), (0xA1, 0xA1, 0xA1, 0xFE, 0.05)),
}
# Letters beyond ASCII of single-byte encodings, as places in the code page, with their share.
LETTERS = {"cp1252": ((0xC0, 0xFF, 0.9), (0x91, 0x96, 0.05)), "cp1251": ((0xE0, 0xFF, 0.9), (0xC0, 0xDF, 0.08))}
LEANING = {"gb18030": 0.05}  # what a short text's tie is decided by


@functools.lru_cache(maxsize=None)
def model(encoding: str) -> np.ndarray:
    """Logarithm of the probability of every character of the basic plane."""
    out = np.full(1 << 16, RARE)
    out[:128] = math.log(0.3 / 64)
    out[:32] = FAULT
    out[[9, 10, 13]] = out[32]
    for first, last, low, high, share in ROWS.get(encoding, ()):
        found = {c for lead in range(first, last + 1) for trail in range(low, high + 1) if len(c := bytes([lead, trail]).decode(encoding, "ignore")) == 1 and ord(c) > 127}
        out[[ord(c) for c in found if ord(c) < 1 << 16]] = math.log(0.7 * share / len(found))
    for first, last, share in LETTERS.get(encoding, ()):
        found = [ord(c) for b in range(first, last + 1) if (c := bytes([b]).decode(encoding, "ignore"))]
        out[found] = math.log((0.6 if encoding == "cp1251" else 0.1) * share / len(found))
    out[0xFFFD] = FAULT
    return out


def likelihood(raw: bytes, encoding: str) -> float:
    """Mean logarithm of probability for each byte; a character that the end cuts off counts for nothing."""
    text = codecs.getincrementaldecoder(encoding)("replace").decode(raw)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    each = model(encoding)[np.minimum(points, 0xFFFD)]
    total = float(each.sum())
    high, plain = points > 127, (points < 128) & ((points | 32) >= 97) & ((points | 32) <= 122)
    if encoding == "cp1252":  # accented letters stand alone
        total += 3 * RARE / 4 * float((high[1:] & high[:-1]).sum())
    elif encoding == "cp1251":  # words are in one script
        total += RARE / 4 * float((high[1:] & plain[:-1]).sum() + (plain[1:] & high[:-1]).sum())
    return total / max(1, len(raw)) + LEANING.get(encoding, 0.0)


def ranking(raw: bytes, also: tuple[str, ...] = ()) -> list[tuple[float, str]]:
    """Candidates that decode the bytes, the likeliest first."""
    head = raw[:HEAD]
    return sorted(((likelihood(head, e), e) for e in (*ROWS, *LETTERS, *also)), reverse=True)


def marked(raw: bytes) -> str | None:
    """The encoding whose mark the bytes begin with, or that their NUL bytes show."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    if raw and raw.count(0) > len(raw) // 4:
        return "utf-16-le" if raw[1::2].count(0) > raw[::2].count(0) else "utf-16-be"
    return None


def strict(raw: bytes, encoding: str) -> bool:
    """Whether all bytes decode, but for a last character that is cut off."""
    try:
        codecs.getincrementaldecoder(encoding)().decode(raw)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def sniffed(raw: bytes) -> str:
    return marked(raw) or ("utf-8" if strict(raw, "utf-8") else ranking(raw)[0][1])


def named(raw: bytes, header: str) -> list[str]:
    """Encodings that the page's first bytes or the header name, as far as Python knows them; supersets stand for the Chinese national ones."""
    labels = re.findall(r"(?i)(?:charset|encoding)\s*=\s*[\"']?\s*([\w.:-]+)", raw[: HEAD // 4].decode("latin-1") + "\n" + header)
    out = []
    for label in labels:
        try:
            codec = codecs.lookup(label).name
        except LookupError:
            continue
        out.append("gb18030" if codec in ("gb2312", "gbk", "hz") else codec)
    return out


def page_text(raw: bytes, header: str = "") -> str:
    """A page's text: its mark decides, then what it is said to be if all bytes agree, then likelihood; names that servers give by default say nothing."""
    encoding = marked(raw)
    if encoding is None:
        said = (e for e in named(raw, header) if e not in ("iso8859-1", "ascii") and strict(raw, e))
        encoding = next(said, None) or sniffed(raw)
    return raw.decode(encoding, "replace")


def decoded(raw: Column, header: Column | None = None) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else page_text(bytes(p), h or "") for p, h in zip(pages, headers, strict=True)])

    return run(raw, header if header is not None else F.lit(""))
