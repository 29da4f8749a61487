from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from countinghouse.llm import bpe, queries
from tests.llm.conftest import FOLDER, ROWS

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding(
        "whole", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (100, 30)])
def test_chunks_give_what_the_whole_text_gives(documents, whole, chunk, overlap):
    texts = {row.doc_id: row.text for row in documents.collect()}
    found = bpe.decode(bpe.encode(documents, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS)
    rows = found.collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert list(row.ids) == whole.encode_ordinary(texts[row.doc_id])
        assert bytes(row.decoded) == texts[row.doc_id].encode()


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (17, 6)])
def test_awkward_rows(spark, awkward, no_docs, whole, chunk, overlap):
    pick = random.Random(0)
    atoms = ["a", "'", "'re", " ", "  ", "\n", "1", "!", "don't", "x" * 50, " " * 30, " ", "日本"]
    rows = [(n, "".join(pick.choices(atoms, k=pick.randint(0, 200)))) for n in range(100)]
    rows += [(202, "hot text " * 20)] * 150 + [(None, "hot text " * 20)] * 3
    rows += [(200, "z" * 5_000), (201, " " * 900 + "a")] + [row[:2] for row in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = bpe.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap).collect()
    wanted = Counter((n, tuple(whole.encode_ordinary(text or ""))) for n, text in rows)
    assert Counter((row.doc_id, tuple(row.ids)) for row in found) == wanted
    assert bpe.encode(awkward, RANKS, PATTERN).columns == ["doc_id", "ids"]
    assert bpe.encode(awkward, RANKS, PATTERN).count() == len(ROWS)
    assert bpe.decode(bpe.encode(no_docs, RANKS, PATTERN), RANKS).count() == 0


def test_query(spark, documents):
    rows = queries.op1_byte_level_bpe(spark, FOLDER).collect()
    assert len(rows) == documents.count()
    assert all(len(row.ids_sha256) == len(row.decoded_sha256) == 64 for row in rows)
