"""The queries of this package, each over its whole table with the operators' own parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import bpe, ctw, decontam, exact, langid, licenses, neardup, pii, quality, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in three batches, in the order of their ids; each is held against one index that the earlier ones have filled."""
    index = exact.new_index(spark)
    parts = exact.arrivals(_read(spark, sf_dir, "documents"), 3)
    return reduce(DataFrame.unionByName, [exact.exact_dedup_ids(p, index, f"batch {k}") for k, p in enumerate(parts)])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_read(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redactions(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_scores(_read(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text again."""
    docs = _read(spark, sf_dir, "documents")
    return bpe.round_trip(docs)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.ctw_scores(_read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_decontam": op6_decontam,
    "op7_licenses": op7_licenses,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_language": op10_language,
}

ORACLE_SQL = {
    "op6_decontam": r"""
        WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
        itoks AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
        iruns AS (SELECT item_id, greatest(1, len(w) - 2) AS span, i, array_to_string(w[i:i + 2], ' ') AS s FROM itoks, unnest(range(1, 1 + greatest(1, len(w) - 2))) AS u(i) WHERE len(w) > 0),
        iset AS (SELECT DISTINCT item_id, span, s, count(DISTINCT s) OVER (PARTITION BY item_id) AS size FROM iruns),
        druns AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 2], ' ') AS s FROM toks, unnest(range(1, len(w) - 1)) AS u(i)),
        hits AS (SELECT doc_id, item_id, span, size, p, druns.s FROM druns JOIN iset USING (s)),
        wins AS (SELECT a.doc_id, a.item_id, a.size, a.p, count(DISTINCT b.s) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + a.span GROUP BY a.doc_id, a.item_id, a.size, a.p),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, p) AS k FROM wins WHERE n >= ceil(size * 0.6 - 1e-9))
        SELECT doc_id, item_id, round(n / size, 6) AS containment, p AS start_word FROM best WHERE k = 1""",
    "op8_exact_dedup": """
        SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)
        UNION ALL SELECT doc_id, NULL AS digest FROM documents WHERE text IS NULL""",
    "op10_language": r"""
        WITH padded AS (SELECT doc_id, lang, ' ' || unnest(regexp_extract_all(lower(text), '\p{L}+')) || ' ' AS s FROM documents WHERE text IS NOT NULL),
        words AS (SELECT doc_id, lang, s, count(*) AS times FROM padded GROUP BY ALL),
        raw AS (SELECT doc_id, lang, substr(s, i, n) AS g, n, times FROM words, unnest([1, 2, 3]) AS a(n), unnest(range(1, length(s) + 1)) AS b(i) WHERE i + n - 1 <= length(s)),
        grams AS (SELECT doc_id, lang, g, sum(times) AS c FROM raw WHERE g <> ' ' GROUP BY ALL),
        chosen AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) WHERE k <= 900),
        totals AS (SELECT lang, g, sum(c) AS c FROM grams SEMI JOIN chosen USING (doc_id) GROUP BY ALL),
        ranked AS (SELECT lang AS language, g, k FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) AS k FROM totals) WHERE k <= 300),
        own AS (SELECT doc_id, g, k FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, g) AS k FROM grams) WHERE k <= 300),
        langs AS (SELECT DISTINCT language FROM ranked),
        far AS (SELECT o.doc_id, l.language, sum(CASE WHEN r.k IS NULL THEN 300 ELSE abs(o.k - r.k) END) AS distance FROM own o CROSS JOIN langs l LEFT JOIN ranked r ON r.language = l.language AND r.g = o.g GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, language) AS k FROM far)
        SELECT d.doc_id, b.language, b.distance::BIGINT AS distance FROM documents d LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.doc_id = d.doc_id""",
}
