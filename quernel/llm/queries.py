"""One query for each training-data operator, over its whole table, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, neardup, pii, quality, secrets, tokencounts, topk, toxicity, warc
from .common import scratch, stored, table


def tokenizer_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are counted once, by three tokenizer versions. One comes in as a batch that is delivered twice, which changes
    nothing; another comes in with the counts of the byte-level BPE, which a batch revises; the BPE's own version comes and is
    deleted; all documents of the first are deleted and inserted again. Two compactions lie between."""
    docs, rollup = table(spark, sf_dir, "documents"), tokencounts.Rollup(spark, scratch(spark, "token-counts"))
    counts = stored(tokencounts.all_counts(docs, tokenizer_path()), "token-counts-rows")
    first, second = tokencounts.TOKENIZERS
    words, pieces, units = tokencounts.rows(counts, first, first), tokencounts.rows(counts, second, second, tokencounts.BPE), tokencounts.rows(counts, tokencounts.BPE, tokencounts.BPE)
    rollup.commit(f"load-{first}", tokencounts.inserts(words))
    rollup.commit(f"load-{second}", tokencounts.inserts(pieces.withColumn("n_tokens", F.col("old_tokens"))))
    rollup.commit(f"load-{tokencounts.BPE}", tokencounts.inserts(units))
    rollup.commit(f"load-{first}", tokencounts.inserts(words))
    rollup.compact()
    rollup.commit(f"revise-{second}", tokencounts.revisions(pieces))
    rollup.commit(f"delete-{first}", tokencounts.deletes(words))
    rollup.commit(f"delete-{tokencounts.BPE}", tokencounts.deletes(units))
    rollup.commit(f"again-{first}", tokencounts.inserts(words))
    rollup.compact()
    return rollup.totals()


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_neardup": op4_neardup,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
""",
    "op3_token_counts": r"""
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
  UNION ALL
  SELECT source, lang, 'pieces-2' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) AS n FROM documents
) GROUP BY ALL
""",
    "op4_neardup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * joint >= 85 * (x.n + y.n - joint)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(i, j) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.j FROM r JOIN e ON r.i = e.a WHERE r.j < e.b),
c AS (SELECT i AS doc_id, min(j) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS payload FROM pages
), l AS (SELECT payload, max(page_id) AS lead FROM p WHERE bytes >= 1000 GROUP BY payload)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM p LEFT JOIN l USING (payload)
""",
    "op7_decontaminate": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), o AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), h AS (SELECT o.doc_id, o.i, o.m, p.item FROM o JOIN p USING (m, k)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
