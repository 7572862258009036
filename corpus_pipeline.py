"""A corpus pipeline: language, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import jaccard, langid, packing, secrets, suffix
from latticework.llm.common import crc_mod, cut, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is likelier in a learned language than under a model that knows none; the others go, and so do texts that are null or have no letter.

    Where no row has a lang, all texts with a letter stay. Repeated rows stay repeated; an empty table stays empty.
    """
    small_batches(spark)
    langs, p = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.accepted(docs, langs, p)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, the one of least doc_id.

    Rows with the same doc_id and text are one document; different texts with one doc_id are two. Null doc_ids come last in their group;
    texts without a word are in none and stay. An empty table stays empty.
    """
    small_batches(spark)
    return jaccard.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that start elsewhere too. All rows stay, some with an empty text; a null text stays null."""
    small_batches(spark)
    return suffix.deduplicated(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret's span replaced. All rows stay; a null text stays null."""
    small_batches(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2,048 tokens, of all rows; a null or empty text is a piece of its end alone."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("secrets", redacted),
    ("packing", packed),
]

#: SQL has no language model, suffix index or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
