"""From raw documents to token ids: five stages, each over everything that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.llm import bpe_codec, decontaminate, near_dup, quality, secret_scan, texts

TOKENIZER = "byte_bpe_50k.json"
# Near-duplicates share this percentage of their five-word shingles.
SIMILAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, scores at least 0.7; the others go."""
    trees = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, trees)


def keep_firsts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of documents linked by a similarity of 0.8 or more."""
    return near_dup.first_of_each(docs, percent=SIMILAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item of the benchmark in them."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in them are replaced by a mark, and ``n_chars`` follows."""
    spans = texts.fresh(docs, "spans")
    found = secret_scan.scan(docs, name=spans)
    shown = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col(spans)))
    length = F.when(F.size(spans) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return shown.withColumn("n_chars", length).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digest of what they decode to."""
    return bpe_codec.round_trip(docs, public_tokenizers.path(TOKENIZER), "doc_id", with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_firsts),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", hide_secrets),
    ("BPE encoding", encode),
]

# Fitted trees and byte-pair merges can't be written in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written below the shared folder and read again by the next."""
    config.prepare(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = shared.settle(stage(spark, rows, sf_dir), f"stage-{name.replace(' ', '-')}")
    return rows
