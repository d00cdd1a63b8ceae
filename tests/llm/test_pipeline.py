"""Pipeline stages against brute force on the whole small table."""

import corpus_pipeline as P

from sievewright.llm import decontam, quality

from test_llm_operators import SF, check_packing, kept_rows


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    columns = docs.columns
    good = P.quality(spark, docs, SF).cache()
    scores = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p} and good.columns == columns
    once = P.exact_dedup(spark, good, SF).cache()
    last = {}
    for r in good.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(last.values()) and once.columns == columns
    apart = P.near_dedup(spark, once, SF).cache()
    rows = [(r.doc_id, r.text) for r in once.collect()]
    assert {r.doc_id for r in apart.collect()} == {d for d, _ in kept_rows(rows)} and apart.columns == columns
    clean = P.decontaminate(spark, apart, SF).cache()
    found = {r.doc_id for r in decontam.contaminated(apart, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in apart.collect()} - found and clean.columns == columns
    check_packing(P.pack(spark, clean, SF).collect(), [(r.doc_id, r.text) for r in clean.collect()], 2048)


def test_run(spark):
    assert P.run(spark, SF).count() > 0
