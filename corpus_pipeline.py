"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm import mixing, packing, pii, quality, similar
from plotwise.llm.common import remove, write
from plotwise.llm.registry import tokenizer
from plotwise.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the robust outlier test rejects.

    Null and empty texts fail the base rule and go; null languages and sources count as empty names; repeated rows
    share a verdict; an empty table stays empty; all columns stay.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Texts without words are one group; rows with null or repeated ids are followed by their place; all columns stay.
    """
    return similar.keep_one(docs, width=5, least=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the text.

    Null texts stay null and texts without personal data as they are; other columns stay whatever their names.
    """
    clean = pii.redact(docs)
    if not {"text", "n_chars"} <= set(docs.columns):
        return clean
    text, n_chars = (docs.columns.index(c) for c in ("text", "n_chars"))
    rows = clean.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return rows.select(*[F.length(f"_{text}").cast("long").alias(c) if i == n_chars else F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global random order.

    Null sources count as an empty name, null ids as an empty one; texts are not read; all columns stay.
    """
    return mixing.remix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; each task packs the rows it reads, in their order.

    Null and empty texts are one piece of the end token; very long ones many pieces; repeated rows are packed each.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is written in the shared folder and read again, and goes when the next is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = write(stage(spark, docs, sf_dir))
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)


#: Robust covariance, SimHash and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
