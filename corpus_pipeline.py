"""A training corpus from ``documents``: rules, boilerplate, near-duplicates, personal data,
packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, folder of the tables) and
returns a DataFrame; ``run`` writes it as Parquet in the shared folder and gives what it
reads back to the next stage. All but the last return the columns of ``documents``, with
``n_chars`` for the text as it then is. Nulls, empty and repeated rows are treated as the
operator of the stage says; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countinghouse.llm import line_frequency, line_spread, packing, pii, simhash
from countinghouse.session import stored


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with the right ``n_chars``, and the columns and types of ``like``."""
    length = F.length("text").cast(like.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length).select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects short, repetitive and depleted documents; removes lines above the limits."""
    return _counted(line_frequency.apply(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many sources share."""
    return _counted(line_spread.remove_spread_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: four-word shingles, four bits."""
    return simhash.one_of_each(docs, words=4, distance=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return _counted(pii.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents to sequences of 2048 tokens, in the corpus's own mixture."""
    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    ).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: Fingerprints, boosted trees and token ids are not for SQL; tests/llm compares with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
