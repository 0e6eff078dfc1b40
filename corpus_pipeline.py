"""Training corpus from documents: language, quality, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir), its rows are written as Parquet, and the next stage works
on what was read back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import langid, mixing, near_dedup, packing, quality
from sessionloom.llm.queries import BYTE_TOKENIZER, END_ID, WORD_TOKENIZER
from sessionloom.llm.storage import store

LEAST_SCORE = 0.5
MOST_SURPRISE = 2.0  # bits per byte, as a multiple of those of the texts learned from


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language is one of those learned with at least LEAST_SCORE, and whose letters
    take at most MOST_SURPRISE times the usual bits per byte in it: other languages and random letters
    go, and so do texts that are null or have no letter. Repeated rows stay or go together."""
    model = langid.train(langid.in_training(docs), BYTE_TOKENIZER)
    return langid.kept_documents(docs, model, LEAST_SCORE, MOST_SURPRISE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule stay; null and empty texts fail. Repeated rows stay or go together."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays, one row of it; texts
    without words are in no group and stay."""
    return near_dedup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them; a null source is a source of its own,
    texts without words go, repeated rows count each and stand equally often."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences; a null text is an empty one, repeated rows are each
    packed."""
    return packing.pack(docs, WORD_TOKENIZER, END_ID)


STAGES = [
    ("language", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]

# A language model fitted by expectation-maximisation and a public tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
