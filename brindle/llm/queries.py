"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, lm, mixing, quality, simhash, substring, toxicity, warc, webp
from .common import crc_bucket, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = webp.read_media(webp.store_texts(table(spark, sf_dir, "documents")), pixels=False)
    return found.withColumnRenamed("id", "doc_id").drop("pixels", "width", "height")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), use=crc_bucket("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs, model).select(F.col("id").alias("doc_id"), (crc_bucket("id", 5) == 0).alias("held_out"), "severity", "p_toxic", "grade", "toxic")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    captures, shards = warc.write_archive(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archive(spark, folder, captures, shards)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), use=crc_bucket("doc_id", 5) != 0)
    return quality.score_quality(docs, model, threshold=0.3).select(F.col("id").alias("doc_id"), (crc_bucket("id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_texts(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.col("base.start")
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), "base_labels", "labels", "score")


QUERIES = {f.__name__: f for f in (op1_pfair_mixing, op2_toxicity_ordinal, op3_warc_index, op4_substring_dedup, op5_quality_rules, op6_maxent_lm, op7_benchmark_decontamination, op8_lossless_webp, op9_simhash_near_dedup, op10_license_rules)}
ORACLE_SQL = {
    "op3_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), q AS (SELECT page_id, octet_length(encode(h)) n, sha256(h) d, min(page_id) OVER (PARTITION BY h) f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND f < page_id THEN f END AS refers_to FROM q""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
win AS (SELECT doc_id, s, list_slice(ws, s, s + 19) k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) i FROM later),
word AS (SELECT doc_id, unnest(ws) x, generate_subscripts(ws, 1) i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_benchmark_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
rec AS (SELECT DISTINCT item_id, list_slice(ws, s, s + 9) k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) s FROM v WHERE len(ws) > 0)),
win AS (SELECT doc_id, s, n, list_slice(ws, s, s + n - 1) k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) s FROM w, (SELECT DISTINCT len(k) n FROM rec) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM win JOIN rec USING (k)),
covered AS (SELECT doc_id, count(*) n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n, string_agg(i, ',' ORDER BY i) t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, c.n IS NOT NULL AS contaminated FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN items x USING (doc_id)""",
}
