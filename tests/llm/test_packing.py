from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from countinghouse.llm import packing, queries
from tests.llm.conftest import FOLDER, ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokens():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def holds(rows, texts, tokens, window):
    """Each id lies in one piece; sequences have no gap, and only the last isn't full."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
    assert set(by_doc) == set(texts)
    for number, text in texts.items():
        ids, at = tokens(text), 0
        for row in sorted(by_doc[number], key=lambda row: row.start):
            part = ids[at : at + row.length]
            assert (row.start, row.doc_tokens) == (at, len(ids))
            assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += row.length
        assert at == len(ids)
    for number, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or number == max(by_sequence) and at < window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query(spark, documents, tokens):
    texts = {row.doc_id: row.text for row in documents.collect()}
    holds(queries.op4_mixture_packing(spark, FOLDER).collect(), texts, tokens, 2_048)


@pytest.mark.parametrize(
    "kind", [{"mixture": {"src0": 0.7, "src1": 1e-7}}, {"grain": 1}, {"max_queues": 3}, {"window": 64, "grain": 16}]
)
def test_other_parameters(documents, tokens, kind):
    texts = {row.doc_id: row.text for row in documents.collect()}
    rows = packing.pack(documents.repartition(3), PATH, PATTERN, **kind)
    holds(rows.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, tokens, kind.get("window", 2_048))


def test_windows_have_the_mixture(spark, documents):
    sources = {row.doc_id: row.source for row in documents.collect()}
    total, windows = Counter(), defaultdict(Counter)
    rows = queries.op4_mixture_packing(spark, FOLDER).collect()
    for row in rows:
        total[sources[row.doc_id]] += row.length
        windows[row.sequence_id][sources[row.doc_id]] += row.length
    whole = sum(total.values())
    for number, window in windows.items():
        if number < max(windows) - 1:
            for source in total:
                assert abs(window[source] - 2_048 * total[source] / whole) <= 2 * packing.GRAIN


def test_a_given_mixture(spark):
    rows = [(n, "word " * 400, "ab"[n % 2], "", 0) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n bigint")
    found = packing.pack(docs, PATH, PATTERN, mixture={"a": 3.0, "b": 1.0}).collect()
    first = [row for row in found if row.sequence_id < 4]
    share = sum(row.length for row in first if row.doc_id % 2 == 0) / sum(row.length for row in first)
    assert abs(share - 0.75) < 0.05


def test_many_sources_have_their_share(spark, tokens):
    """A thousand sources, most of them in the tail: every source keeps its proportion."""
    rows = []
    for n in range(1_000):
        for _ in range(1 + (n % 7 == 0) + 20 * (n < 5)):
            rows.append((len(rows), "word " * (100 + n * 37 % 300), f"s{n:04d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    found = packing.pack(docs, PATH, PATTERN, max_queues=4).withColumn("ids_crc32", F.crc32("ids"))
    found = found.collect()
    holds(found, {number: text for number, text, _ in rows}, tokens, 2_048)
    sources = {number: source for number, _, source in rows}
    total, held = Counter(), defaultdict(Counter)
    for row in found:
        total[sources[row.doc_id]] += row.length
        held[row.sequence_id][sources[row.doc_id]] += row.length
    whole, upto, worst = sum(total.values()), Counter(), []
    for number in range(len(held) - 1):
        upto.update(held[number])
        for s in total:
            share = total[s] / whole
            assert abs(held[number][s] - 2_048 * share) <= 2 * packing.GRAIN
            worst.append((abs(upto[s] - (number + 1) * 2_048 * share), s, number))
    # Bounded however many windows: a few grains for the two levels.
    assert max(worst)[0] <= 4 * packing.GRAIN, sorted(worst)[-9:]


def test_targets_of_small_sources_are_kept(spark):
    rows = [(n, "word " * 400, "abcdz"[n % 5]) for n in range(100)]
    rows += [(1_000 + n, "word " * 900, f"big{n % 3}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixture = {"a": 0.125, "b": 0.125, "c": 0.125, "d": 0.125, "z": 0.5}
    only = docs.filter("doc_id < 1000")
    found = packing.pack(only, PATH, PATTERN, mixture=mixture, max_queues=3).collect()
    sources = {number: source for number, _, source in rows}
    held = Counter()
    for row in found:
        if row.sequence_id < 6:
            held[sources[row.doc_id]] += row.length
    assert all(abs(held[x] - 6 * 2_048 * share) <= 2 * packing.GRAIN for x, share in mixture.items())
    found = packing.pack(docs, PATH, PATTERN, mixture={"z": 0.5}, max_queues=2).collect()
    first = [row for row in found if row.sequence_id < 3]
    share = sum(row.length for row in first if sources[row.doc_id] == "z") / (3 * 2_048)
    # z has half a window's weight beside all others' part of the tokens.
    others = 1 - sum(row.length for row in found if sources[row.doc_id] == "z") / sum(
        row.length for row in found
    )
    assert abs(share - 0.5 / (0.5 + others)) < 0.05


@pytest.mark.parametrize("mixture", [{"nowhere": 1.0}, {"src0": 0.0}, {"src0": float("nan")}])
def test_targets_that_cannot_be_kept(documents, mixture):
    with pytest.raises(ValueError, match="can't be kept"):
        packing.pack(documents, PATH, PATTERN, mixture=mixture)


def test_awkward_rows(awkward, no_docs, tokens):
    found = packing.pack(awkward, PATH, PATTERN).collect()
    assert sum(row.length for row in found) == sum(len(tokens(row[1])) for row in ROWS)
    found = packing.pack(awkward, PATH, PATTERN, max_queues=1).collect()
    assert sum(row.length for row in found) == sum(len(tokens(row[1])) for row in ROWS)
    assert packing.pack(no_docs, PATH, PATTERN).count() == 0
