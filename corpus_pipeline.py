"""The corpus pipeline: language, near copies, secrets, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import langid, mixing, packing, secrets, simhash
from flowtide.llm.queries import END_OF_TEXT, tokenizer_file
from flowtide.plans.materialise import materialise

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a margin."""
    return langid.known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints within two bits, or five-word shingles of similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redacted(docs, chars_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeated or left out as the mix says."""
    return mixing.mixed_documents(docs, chars_col="n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 token ids, the ids included."""
    return packing.packed(docs, tokenizer_file(TOKENIZER), "bare", END_OF_TEXT[TOKENIZER])


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", without_secrets),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Language models, similarity components and tokenizers are not expressible in SQL; tests compare the stages with
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
