"""One query per operator over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.bitpack import packed_round_trip
from sievewright.llm.decontam import contaminated
from sievewright.llm.exact import exact_duplicates
from sievewright.llm.licences import licence_scan
from sievewright.llm.merkle import Manifest, tampered
from sievewright.llm.packing import pack_sequences
from sievewright.llm.quality import fit, score
from sievewright.llm.search import ranked
from sievewright.llm.secrets import secret_spans
from sievewright.llm.shards import sharded
from sievewright.llm.simhash import near_duplicates
from sievewright.llm.substrings import substring_dedup
from sievewright.llm.urls import url_verdicts

# The rules of op12.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = sharded(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op3_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_round_trip(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Manifest(_table(spark, sf_dir, "documents"), tampered()).proofs()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_bit_packing, op4_decontamination, op5_quality, op6_exact_dedup, op7_license_scan, op8_secret_scan, op9_best_fit_packing, op10_simhash_near_dedup, op11_ranked_search, op12_url_filter, op13_merkle_manifest)}

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op2_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
        keyed AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM win),
        dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM keyed) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM dup),
        every AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
        kept AS (SELECT e.doc_id, e.i, e.word, g.i IS NULL AS keep FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i),
        summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT keep) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (keep) AS t FROM kept GROUP BY doc_id)
        SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN summed s ON w.doc_id = s.doc_id""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op11_ranked_search": """
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        d AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM t WHERE len(ws) > 0),
        all_ AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, all_),
        m AS (SELECT r, doc_id, 10 + ((90 * n * nn) // l) AS m FROM d, all_),
        s AS (SELECT i.item_id, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY i.item_id, p.r),
        k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN m ON m.r = s.r WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10""",
    "op12_url_filter": """
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        rules(h, q, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        fits AS (SELECT page_id, host, path, h || q AS rule, verdict FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op13_merkle_manifest": """
        WITH RECURSIVE bits AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
        heads AS (SELECT d.*, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
            CASE WHEN c % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents d LEFT JOIN bits USING (doc_id)),
        leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS seen FROM heads),
        sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) AS size FROM leaves GROUP BY source),
        placed AS (SELECT l.doc_id, l.leaf, l.seen, s.g, s.size, row_number() OVER (PARTITION BY s.g ORDER BY l.doc_id NULLS FIRST, l.leaf, l.seen) - 1 AS pos FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
        low AS (SELECT g, 0 AS level, pos, size, leaf AS h FROM placed UNION ALL
            SELECT g, level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY g, level, pos // 3, size),
        top AS (SELECT 0 AS level, g AS pos, (SELECT count(*) FROM sources) AS size, h FROM low WHERE size = 1 UNION ALL
            SELECT level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY level, pos // 3, size),
        heights AS (SELECT g, max(level) AS height FROM low GROUP BY g),
        nodes AS (SELECT g, level, pos, size, h FROM low WHERE size > 1 UNION ALL SELECT o.g, o.height + t.level, t.pos, t.size, t.h FROM top t, heights o WHERE t.size > 1),
        ways AS (SELECT p.doc_id, p.g, p.pos AS leaf_pos, p.seen AS h, 0 AS level, CASE WHEN p.size = 1 THEN p.g ELSE p.pos END AS pos, CAST('' AS VARCHAR) AS digests, p.size > 1 AS inside FROM placed p UNION ALL
            SELECT w.doc_id, w.g, w.leaf_pos, sha256(string_agg(CASE WHEN n.pos = w.pos THEN w.h ELSE n.h END, '' ORDER BY n.pos)), w.level + 1,
                CASE WHEN w.inside AND max(n.size) <= 3 THEN w.g ELSE w.pos // 3 END, w.digests || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> w.pos), ''), w.inside AND max(n.size) > 3
            FROM ways w JOIN nodes n ON n.g = w.g AND n.level = w.level AND n.pos // 3 = w.pos // 3 GROUP BY w.doc_id, w.g, w.leaf_pos, w.h, w.level, w.pos, w.digests, w.inside),
        done AS (SELECT g, leaf_pos, h AS folded_root, digests FROM ways QUALIFY row_number() OVER (PARTITION BY g, leaf_pos ORDER BY level DESC) = 1)
        SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(d.digests) AS proof_sha256, d.folded_root, d.folded_root = t.h AS verified
        FROM placed p JOIN done d ON d.g = p.g AND d.leaf_pos = p.pos JOIN (SELECT g, h FROM low WHERE size = 1) r ON r.g = p.g, (SELECT h FROM top WHERE size = 1) t""",
}
