from __future__ import annotations

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, a long text, repeated rows, ties, odd characters.
ROWS = [
    (1, "Plain words here.\nAnd more words there.", "en", "a", 39),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t\n ", "en", "b", 5),
    (5, "word " * 12_000, "de", "a", 60_000),
    (6, "same text\nsame line\nsame line", "en", "a", 29),
    (6, "same text\nsame line\nsame line", "en", "a", 29),
    (7, "same text\nsame line\nsame line", "en", "c", 29),
    (None, "no id at all", "fr", "b", 12),
    (8, "é 日本 \x1c 🙂 <|endoftext|> don't", "fr", None, 30),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows, with further columns named like those the operators work with."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in (
        "id", "ids", "row", "rows", "line", "lines", "host", "site", "digest", "spans", "spread",
        "fingerprint", "component", "component_id", "chosen_id", "mark", "place", "removed", "kept",
        "label", "score", "at", "queue", "start", "length", "sentence", "normal",
    ):
        docs = docs.withColumn(name, F.lit(1))
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
