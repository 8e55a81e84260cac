"""Thin registered queries over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, langid, line_dedup, minhash_dedup, packing, sharding, token_files, toxicity, url_filter
from ..plans.store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary(), 4096, 1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    n = F.size("removed_lines")
    return out.select("doc_id", F.coalesce(F.when(n > 0, n), F.lit(0)).alias("n_removed"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, _vocabulary(), 1)
    return token_files.read_token_files(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_links(_table(spark, sf_dir, "embeddings"), 0.98)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), 4, 80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_words", "switches")


# The dated list of the example, and the rule that gives a page its fetch time
# (2024-01-01 and page_id * 37 mod 366 days), for the table has none.
URL_LIST = [
    ("domain", "spam-farm.example.org", "add", "2024-01-20"),
    ("domain", "spam-farm.example.org", "remove", "2024-06-01"),
    ("domain", "spam-farm.example.org", "add", "2024-09-15"),
    ("host", "adult-x.example.com", "add", "2024-02-10"),
    ("host", "cheap-pills.example.com", "add", "2024-03-05"),
    ("host", "cheap-pills.example.com", "remove", "2024-10-01"),
    ("domain", "tiontion.example.com", "add", "2024-05-01"),
    ("domain", "tiontion.example.com", "remove", "2024-05-20"),
    ("prefix", "tionsh.example.net/de", "add", "2024-04-01"),
    ("prefix", "tionsh.example.net/fr", "add", "2024-07-01"),
    ("prefix", "tionsh.example.net/fr", "remove", "2024-11-01"),
    ("domain", "example.invalid", "add", "2024-01-01"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp '2024-01-01' + make_dt_interval(cast(page_id * 37 % 366 as int))").alias("fetched"))
    entries = spark.createDataFrame(URL_LIST, "kind string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = url_filter.filter_urls(pages, entries)
    return out.select("page_id", F.col("fetched").cast("date").cast("string").alias("fetched"), "blocked", "rule_kind", "rule", F.col("rule_since").cast("date").cast("string").alias("rule_since"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_token_files, op4_decontamination, op5_embedding_dedup, op6_minhash_dedup, op7_language_id, op8_url_filter, op9_sharding, op10_toxicity)}

_LIST = ", ".join(f"('{k}', '{p}', '{a}', date '{t}')" for k, p, a, t in URL_LIST)

ORACLE_SQL = {
    "op8_url_filter": rf"""
WITH e(kind, pattern, action, since) AS (VALUES {_LIST}
), n AS (
  SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS until FROM e
), p AS (
  SELECT page_id, url, date '2024-01-01' + (page_id * 37 % 366)::int AS fetched, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS h,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/+', '/', 'g')) AS path FROM pages
), m AS (
  SELECT p.page_id, p.url, min(struct_pack(kind := n.kind, pattern := n.pattern, since := n.since)) AS r FROM p JOIN n ON n.action = 'add' AND n.since <= p.fetched AND (n.until IS NULL OR p.fetched < n.until)
    AND CASE n.kind WHEN 'host' THEN p.h = n.pattern WHEN 'domain' THEN p.h = n.pattern OR p.h LIKE '%.' || n.pattern ELSE starts_with(p.h || p.path || '/', n.pattern || '/') END
  GROUP BY p.page_id, p.url
)
SELECT p.page_id, p.fetched::date::varchar AS fetched, m.r IS NOT NULL AS blocked, m.r.kind AS rule_kind, m.r.pattern AS rule, m.r.since::varchar AS rule_since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url = m.url
""",
    "op2_line_dedup": """
WITH l AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), r AS (
  SELECT l.*, b.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) > 1 AS cut FROM l LEFT JOIN b ON l.line = b.line
), k AS (
  SELECT doc_id, sum(cut::int)::int AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS kept FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_removed, 0)::int AS n_removed, strlen(coalesce(k.kept, d.text))::bigint AS n_bytes, md5(coalesce(k.kept, d.text)) AS text_md5
FROM documents d LEFT JOIN k USING (doc_id)
""",
}
