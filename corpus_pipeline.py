"""A training-data pipeline over the documents table: five stages, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.functions.workers import package_on_workers
from fieldcheck.llm import bpe, contamination, minhash, quality, secrets
from fieldcheck.llm.scratch import Scratch, small_batches
from fieldcheck.llm.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What a live credential is replaced by.
MASK = "[secret]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on those of ``docs`` that have a label.

    Without any label to fit on there is no evidence against a document, so all of them stay.
    """
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.count:
        return docs.select(*COLUMNS)
    return quality.scored(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8): the one of the smallest doc_id.

    Each row is judged by its own text, so different texts of one doc_id stay, and of equal rows one does; rows without a doc_id come behind all others.
    """
    return minhash.deduplicated(docs, words=5, num=80, den=100).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text."""
    found = contamination.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of live credentials are replaced by MASK, widely copied examples stay. n_chars follows the text."""
    return secrets.masked(docs.select(*COLUMNS), MASK).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text again."""
    found = bpe.encoded(docs.select("doc_id", "lang", "source", "text"))
    same = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the scratch folder and read again."""
    package_on_workers(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs


#: Stages one, two and five can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None
