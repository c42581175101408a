"""From raw documents to a training mix: five stages, each written and read again by run().

Not expressible in SQL as a whole (a fitted classifier and fingerprint links), so ORACLE_SQL is None;
tests/llm holds each stage, on documents with nulls, empty, long and repeated rows and clashing column
names, against a plain version. Stages judge rows by their own texts: null and empty texts are scored and
linked like others, rows of one id stay apart (near duplicates keep or drop rows of one id together),
rows without an id count after all others. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontam, mixing, quality, simhash, substring
from brindle.llm.common import crc_bucket, discard, keep, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble rejects (score below 0.3) go; fitted on the labelled rows, less a held-out fifth."""
    labels, raw = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.keep_quality(docs, quality.fit_quality(raw, labels, use=crc_bucket("doc_id", 5) != 0))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier are cut out; documents of which nothing is left go."""
    return substring.drop_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter one) go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, with its place in a mix of sources by the root of their sizes."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mix_to_weights),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote is deleted once the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = shared_dir(spark)
        docs = keep(stage(spark, docs, sf_dir), folder)
        if last:
            discard(spark, last)
        last = folder
    return docs
