"""The registered queries of this subpackage, over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotwise.llm import embeddings, licences, mixing, oracles, packing, pii, quality, repeats, simhash, tokens, toxicity
from plotwise.session import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_licences": op1_licences,
    "op2_tokens": op2_tokens,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_suffixes": op8_suffixes,
    "op9_toxicity": op9_toxicity,
    "op10_embeddings": op10_embeddings,
}

#: Operators that SQL can't express (tokens, MCD, XXH64, look-behind expressions, a trained model) are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op1_licences": oracles.licences(),
    "op5_mixing": oracles.MIXING,
    "op8_suffixes": oracles.REPEATS,
    "op10_embeddings": oracles.EMBEDDINGS,
}
