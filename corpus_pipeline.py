"""Cleaning a corpus in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's
rows as Parquet in the shared folder and reads them as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsumugi.llm import bpe, mixing, ordinal, simhash, suffix
from tsumugi.llm.common import small_batches, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is high enough; null and empty texts go."""
    small_batches(spark)
    kept = ordinal.scored(docs, ordinal.trained(docs, table(spark, sf_dir, "labels"))).filter("kept")
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that with the smallest doc_id."""
    small_batches(spark)
    return simhash.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes covered by a string of suffix.PASSAGE bytes that repeats elsewhere (the length is
    for passages of over 50 words); n_chars is counted anew."""
    from pyspark.sql import functions as F

    small_batches(spark)
    out = suffix.dedup(docs, suffix.PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded texts, a row per copy."""
    small_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: the classifier's training, byte-wise cuts and BPE have no SQL form; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
