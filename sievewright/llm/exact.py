"""Exact duplicates by content-defined chunk recipes; DataFrame functions only.

A text is cut after ``CHUNK_MIN`` to ``CHUNK_MAX`` characters where its own characters say so: at the first sentence
or line end, where there is none at the first white space, and in unbroken text (code on one line,
base64, Chinese) after the first character of a sparse class. A cut depends on what follows the cut before only, so after an
insertion chunks fall in step again. Chunks get 64-bit identifiers, verified over the
whole corpus: one identifier must stand for one SHA-256 digest. The few that stand for more are
told apart by their digests in the recipes that hold them. Documents are equal when their ordered identifier lists
are; only these short lists are shuffled, never texts.

Cases: null text counts as empty; an empty text has an empty recipe and equals other empty texts;
rows that repeat both doc_id and text all count in group_size and get the same decision
(``keep_one_copy`` keeps one of them, the first by the JSON of all columns); a null doc_id stays only if its whole group has none;
an empty table gives no rows; other columns are ignored, and keep their values and names in ``keep_one_copy`` whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import store

CHUNK_MIN, CHUNK_MAX = 1024, 4096
CLASH_LIST = 1000
# A sparse class of characters: 9 of the 64 of base64, and every 16th row of 64 code points.
SPARSE = "0-3QXZqz" + "".join(rf"\x{{{a:x}}}-\x{{{a + 63:x}}}" for a in range(0x80, 0x20000, 0x400) if not 0xD800 <= a < 0xE000)


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The text's chunks in order; joined they are the text."""
    cuts = "|".join(rf".{{{least},{most}}}?(?<=[{c}])" for c in (r"\n.!?", r"\s", SPARSE))
    return F.regexp_extract_all(text, F.lit(rf"(?s){cuts}|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _digest(c: Column) -> tuple[Column, Column]:
    """120 bits of SHA-256 as two longs, so that they aggregate in place."""
    hexed = F.sha2(c, 256)
    return tuple(F.conv(F.substring(hexed, a, 15), 16, 10).cast("bigint") for a in (1, 16))


def chunk_identifiers(docs: DataFrame) -> DataFrame:
    """Every distinct 64-bit chunk identifier: its occurrences, and whether it stands for one content."""
    cut = store.texts(docs).select(F.explode(chunks(F.col("text"))).alias("chunk"))
    a, b = _digest(F.col("chunk"))
    named = cut.select(identifier(F.col("chunk")).alias("ident"), F.length("chunk").alias("n"), a.alias("a"), b.alias("b"))
    ends = [f(c).alias(f"{c}_{name}") for c in ("n", "a", "b") for f, name in ((F.min, "lo"), (F.max, "hi"))]
    same = F.col("n_lo").eqNullSafe(F.col("n_hi")) & (F.col("a_lo") == F.col("a_hi")) & (F.col("b_lo") == F.col("b_hi"))
    return named.groupBy("ident").agg(F.count("*").alias("n_chunks"), *ends).select("ident", "n_chunks", same.alias("verified"))


def recipes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_sha256 and the ordered list of verified chunk identifiers.

    Identifiers that stand for several contents are as good as none at any size (64 bits); up to ``CLASH_LIST`` of them are told
    apart where they occur, and should there ever be more, every chunk carries its digest.
    """
    clash = [r.ident for r in chunk_identifiers(docs).filter(~F.col("verified")).select("ident").limit(CLASH_LIST + 1).collect()]
    cut = chunks(F.col("text"))
    if not clash:
        ids = F.transform(cut, identifier)
    else:
        doubtful = (lambda c: F.lit(True)) if len(clash) > CLASH_LIST else (lambda c: identifier(c).isin(clash))
        ids = F.transform(cut, lambda c: F.struct(identifier(c).alias("ident"), F.when(doubtful(c), F.sha2(c, 256)).alias("digest")))
    return store.texts(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"), ids.alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: the largest doc_id of its group of equal texts stays."""
    once = store.written(recipes(docs), "recipes")
    groups = once.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(F.col("recipe").alias("g_recipe"), F.xxhash64("recipe").alias("g_key"), "keep_id", "group_size")
    groups = store.written(groups, "recipe-groups")
    rows = once.withColumn("key", F.xxhash64("recipe"))
    out = rows.join(groups, (F.col("key") == F.col("g_key")) & F.col("recipe").eqNullSafe(F.col("g_recipe")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows the one whose other columns come first as JSON."""
    decided = exact_duplicates(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.col("text_sha256").alias("sha"), "kept")
    return store.only_kept(docs, decided)
