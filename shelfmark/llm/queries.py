"""The training-data queries: each applies its operator to its whole table and derives the result's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import ann, langid, license_scan, linededup, merkle, mixing, packing, phrases, pii, quality, sharding, simhash, toxicity
from shelfmark.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_passages(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.digest(mixing.with_copies(docs, labels, carry=["doc_id"]))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.drop("log_p", "n_chars_scored")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_neighbours": op7_neighbours,
    "op8_quality": op8_quality,
    "op9_lines": op9_lines,
    "op10_simhash": op10_simhash,
    "op11_toxicity": op11_toxicity,
    "op12_merkle": op12_merkle,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {"op9_lines": linededup.oracle(), "op12_merkle": merkle.oracle(), "op13_phrases": phrases.oracle()}
