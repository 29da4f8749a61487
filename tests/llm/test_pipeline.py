from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from countinghouse.llm import line_frequency, packing, pii, queries, simhash
from countinghouse.session import stored
from tests.llm.conftest import ROWS
from tests.llm.test_packing import PATH, holds, tokens  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents, tokens):  # noqa: F811
    columns, docs, seen = documents.dtypes, documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, FOLDER), "stage")
        assert after.dtypes == columns
        assert all(row.n_chars == len(row.text) for row in after.collect())
        seen.append((docs, after))
        docs = after
    given, kept = seen[0]
    verdicts = {r.id for r in line_frequency.verdicts(given).collect() if r.kept}
    assert verdicts == {r.doc_id for r in kept.collect()} and kept.count() < given.count()
    given, kept = seen[2]
    groups = {r.component_id for r in simhash.near_duplicates(given).collect()}
    assert groups == {r.doc_id for r in kept.collect()}
    given, kept = seen[3]
    detector = pii.train(given)
    wanted = {r.doc_id: pii.without(r.text, detector.spans(r.text)[1]) for r in given.collect()}
    assert wanted == {r.doc_id: r.text for r in kept.collect()}
    packed = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    holds(packed, wanted, tokens, packing.WINDOW)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == len(packed)


def prose(seed):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices("abcdefghij", k=6)) for _ in range(80))


def test_rows_of_an_awkward_table(spark, tmp_path, tokens):  # noqa: F811
    """Awkward rows are rejected, copies give one, data is redacted, clean texts stay, and
    further columns with names from inside the operators change nothing."""
    clean = {100 + n: prose(n) for n in range(6)}
    rows = [*ROWS, *((n, text, "en", "a", 0) for n, text in clean.items())]
    rows += [(110, prose(1), "en", "b", 0), (111, prose(1), None, None, None)]
    rows += [(112, prose(8), "en", "a", 0)] * 2
    rows += [(113, f"{prose(9)}\nwrite to someone@example.org", "de", "b", 0)]
    rows += [(114, f"{prose(10)} plus words\n" + "same line here\n" * 3, "de", "c", 0)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    for name in ("id", "row", "host", "digest", "removed", "kept", "spread", "component_id", "queue"):
        docs = docs.withColumn(name, F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = clean | {112: rows[-3][1], 114: rows[-1][1]}
    assert {row.doc_id for row in packed} == {*wanted, 113}
    texts = {}
    for row in sorted(packed, key=lambda row: (row.doc_id, row.start)):
        ids = np.frombuffer(row.ids, np.uint32).tolist()
        texts.setdefault(row.doc_id, []).extend(ids)
    for n, text in wanted.items():
        assert texts[n] == tokens(text)
    left = Tokenizer.from_file(PATH).decode(texts[113][:-1])
    assert "someone" not in left and left.startswith(prose(9))


def test_empty_table(spark, tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_everything_is_registered():
    known = __spark_entry__.queries()
    names = [name for name in known if name.startswith("op")]
    assert [int(name[2:].split("_")[0]) for name in names] == list(range(1, 14))
    assert "pipeline" in known and set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_like_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = queries.queries()[name](spark, FOLDER)
    wanted = duck.execute(queries.oracle_sql()[name])
    assert found.columns == [x[0] for x in wanted.description]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted.fetchall(), key=str)
