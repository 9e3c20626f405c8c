"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Every stage takes all documents its predecessor kept and returns the columns of ``documents``, the last one the packed
pieces.  Null or empty texts pass the stages as the operators define it; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm import exact_dedup, ngram_join, packing, quality, staging, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score less are rejected: the threshold of the quality query.
LEAST_QUALITY = 0.3


#: Texts handed to a Python worker at once.  Spark's 10,000 whole texts, held on both sides of the pipe and in
#: workers that serve stage after stage, add up to more than the stages themselves need.
BATCH_ROWS = 1000


def in_small_batches(stage):
    """``stage`` with the session's Arrow batches cut to ``BATCH_ROWS``; a smaller setting stays."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
            spark.conf.set(setting, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels, usable=quality.fold(F.col("doc_id"), 5) != 0)
    return model.score(docs, out="_score").filter(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id stays."""
    return ngram_join.keep_one_of_each(docs).select(*COLUMNS)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut out of their texts, the first stays; texts that vanish are dropped."""
    cut = suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES, keep_first=True)
    return cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).filter(
        ~((F.col("n_removed") > 0) & (F.trim("text") == ""))).select(*COLUMNS)


#: Passages from this length on count as repeated: about fifty short words.
REPEAT_BYTES = 200


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs, path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_duplicates", drop_near_copies),
          ("repeated_passages", cut_repeats), ("packing", pack)]
#: Training, shingles and tokens are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staging.staged(stage(spark, docs, sf_dir), name)
    return docs
