"""A corpus pipeline: rules, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import mixing, near_texts, packing, pii, quality
from shelfmark.llm.common import table
from shelfmark.llm.queries import tokenizer_path
from shelfmark.runtime import forget, ship, stash, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the perplexity bands keep."""
    ship(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near-duplicates: SimHash finds them, sets of five-word shingles of a similarity from 0.8 decide."""
    ship(spark)
    return near_texts.keep_one(docs, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that domains reach their target shares of tokens."""
    ship(spark)
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids (of 16 bits) and their places in sequences; ``packing.sequences`` joins them."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True, id_bytes=2)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No SQL: the language model, fingerprints and tokenizer can't be expressed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's written input is deleted once its own output is written."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs)
            forget(last)
            del last
            sweep(spark)
    return docs
