"""Quality score from two zstandard dictionaries, one trained on good and one on bad labelled text.

A text is compressed in windows of ``WINDOW`` bytes (all of them) once with each dictionary. The
difference of the two sizes over the larger one, over the whole text and for its worst window, are the raw scores;
logistic regression on the two, fitted on labelled texts that were not used for the dictionaries and weighted to
the labels' own shares, calibrates them.
Fitting uses at most ``SAMPLE`` texts per label and purpose, taken in the order of a hash of doc_id. Whole texts stay
in tasks: the driver gets at most ``WINDOWS`` windows per label for the dictionaries, and label and raw scores of the
others, so what it holds is bounded however long the texts are.

Cases: null text is an empty document; empty texts have raw scores 0 and so the calibrated value
there; rows without label or with a null label are scored but never learned from; repeated rows
are scored alike and the least text of a doc_id is learned, with its least label; an empty table gives no rows; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store
from sievewright.llm.bytes import flat, slices

SAMPLE = 1500
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
WINDOW = 512
WINDOWS = 32768


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    base: float
    level: int = LEVEL


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(model: Model, column) -> np.ndarray:
    """Normalised compressed-size differences of each text, positive where good text explains it better: whole, worst window."""
    good, bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)
    data, bounds = flat(column)
    raw = memoryview(data)
    out = np.zeros((len(bounds) - 1, 2))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        g = w = 0
        worst = 1.0
        for at in range(a, b, WINDOW):
            part = raw[at : min(at + WINDOW, b)]
            x, y = len(good.compress(part)), len(bad.compress(part))
            g, w, worst = g + x, w + y, min(worst, (y - x) / max(x, y))
        if b > a:
            out[i] = (w - g) / max(w, g), worst
    return out


def log_odds(model: Model, column) -> np.ndarray:
    return differences(model, column) @ np.array(model.slopes) + model.base


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and base by Newton steps with a small ridge."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(beta[:-1] / scale, beta[-1])


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows that may be learned from: crc32 of the doc_id's text modulo 3 is not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 3 != 1)


def _labelled(docs: DataFrame, usable: DataFrame, sample: int) -> DataFrame:
    """(label, h, text) of up to 2 * ``sample`` documents of each label, one text per doc_id; h orders them."""
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = store.texts(docs).join(F.broadcast(ids), "doc_id")  # at most 4 * sample ids
    once = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return store.written(once.select("label", F.xxhash64("doc_id").alias("h"), "text"), "labelled")


def _windows(rows: DataFrame, value: int, most: int) -> list[bytes]:
    """The windows of one label's texts, in their order; of more than ``most`` those with the least hash."""
    raw = rows.filter((F.col("label") == value) & (F.octet_length("text") > 0)).select("h", F.col("text").cast("binary").alias("raw"))
    places = F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / WINDOW).cast("int"))
    cut = raw.select("h", F.posexplode(F.transform(places, lambda i: F.substring(F.col("raw"), i * WINDOW + 1, F.lit(WINDOW)))).alias("at", "part"))
    found = cut.orderBy(F.xxhash64("h", "at"), "h", "at").limit(most).collect()  # at most ``most`` * WINDOW bytes
    return [bytes(r.part) for r in sorted(found, key=lambda r: (r.h, r.at))]


def _measured(rows: DataFrame, model: Model) -> list[tuple[int, float, float]]:
    """Label and raw scores of each row; the texts stay in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                d = differences(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(d[:, 0]), pa.array(d[:, 1])], ["label", "whole", "worst"])

    return sorted(tuple(r) for r in rows.select("label", "text").mapInArrow(run, "label int, whole double, worst double").collect())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", windows: int = WINDOWS) -> Model | None:
    """Dictionaries from up to ``sample`` texts of each label, calibration from as many others."""
    usable = learnable(labels).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    rows = _labelled(docs, usable, sample)
    order = {0: [], 1: []}
    for r in rows.select("label", "h").collect():  # at most 4 * sample rows
        order[r.label].append(r.h)
    if min(map(len, order.values())) < 8:
        return None
    cut = {v: sorted(hs)[max(4, len(hs) // 2)] for v, hs in order.items()}
    early = F.col("h") < F.when(F.col("label") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0]))
    trained = {}
    for v in order:
        parts = _windows(rows.filter(early), v, windows)
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 8))
        try:
            trained[v] = zstandard.train_dictionary(size, parts, threads=1).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            trained[v] = b"".join(parts)[-size:]
    model = Model(trained[1], trained[0], (1.0, 0.0), 0.0)
    held = np.array(_measured(rows.filter(~early), model))
    x, y = held[:, 1:], held[:, 0]
    n = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    rate = [n[v] / max(1, int((y == v).sum())) for v in (0, 1)]  # the sample holds both labels alike
    weight = np.where(y == 1, rate[1], rate[0])
    *slopes, base = _logistic(x, y, weight * len(y) / weight.sum()).tolist()
    return Model(model.good, model.bad, tuple(slopes), base)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; other inputs than the text are not read."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                z = log_odds(model, rows.column("text")) if model else np.zeros(rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    out = store.texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents scored ``least`` or more, with all their columns; scored in place, without a join."""
    model = fit(docs, labels)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                if model is None:
                    yield rows
                    continue
                z = log_odds(model, rows.column("text"))
                yield rows.filter(pa.array(z >= np.log(least / (1 - least))))

    return docs.mapInArrow(run, schema)
