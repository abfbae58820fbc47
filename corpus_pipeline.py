"""From raw documents to packed sequences: five stages, each an operator at work on all that the one before it kept.

Every stage but the last returns the columns of ``documents``; what it gives is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddystream.llm import mixing, ngram_join, packing, quality, suffix_dedup
from eddystream.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    names = tuple(docs.columns)
    scored = quality.score(docs, *quality.classifier(docs, table(spark, sf_dir, "labels")), keep=names)
    return scored.where("score >= 0.5").select(*names)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more.

    Rows without an id go by a 62-bit hash of the row above all usual ids, so
    that of their copies one stays, and none beside a copy that has an id.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    hash_ = F.xxhash64(*names).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = docs.withColumn("eddystream_no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), hash_))
    left = ngram_join.distinct_documents(keyed)
    kind = docs.schema["doc_id"].dataType
    return left.withColumn("doc_id", F.when(~F.col("eddystream_no_id"), F.col("doc_id")).cast(kind)).select(*names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 200-byte strings that occur elsewhere too."""
    return suffix_dedup.deduplicated_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("packing", pack),
]

#: A trained network and an iterative join aren't SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
