"""A corpus from raw documents: quality, near-duplicates, personal data, mixture, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import minhash, mixing, packing, pii, resampling
from causalbars.llm.common import n_words, table
from causalbars.llm.queries import MIX_WEIGHTS, SEQUENCE, tokenizer_path
from causalbars.plans.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Gumbel top-k over importance weights keeps."""
    chosen = resampling.select_quality(docs, table(spark, sf_dir, "labels"))
    return chosen.where("kept").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates over five-word shingles."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    return pii.mask_spans(pii.find_spans(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    mixed = mixing.mix_sources(docs, F.array("source"), n_words(F.col("text")), key, MIX_WEIGHTS)
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("mix_repeats"))))
    return copies.where("_copy > 0").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens, with their ids."""
    return packing.pack_documents(docs, tokenizer_path(), length=SEQUENCE)


#: (name, function) in the order of their run; each function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_duplicates", deduplicate),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Tokenization and trained weights have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written as parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
