from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from countinghouse.llm import queries, spelling
from tests.llm.conftest import FOLDER, ROWS


def is_near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(
        long[:n] + long[n + 1 :] == short for n in range(len(long))
    )


def plain(counts, ratio=5):
    """Every word against every other."""
    near = defaultdict(list)
    words = sorted(counts)
    for n, a in enumerate(words):
        for b in words[:n]:
            if abs(len(a) - len(b)) < 2 and is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    forms = {}
    for word in words:
        best = min(near[word], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[word]:
            forms[word] = best
    out = []
    for word in words:
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        out.append((word, form, root, counts[word], len(near[word]), counts.get(form)))
    return sorted(out)


def found_in(spark, counts, parts=5):
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(parts)
    return sorted(tuple(row) for row in spelling.variants(frame).collect())


@pytest.fixture
def dealt_out(spark):
    """Seven partitions, however small."""
    own = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def few_letters():
    pick = random.Random(1)
    counts = {}
    for _ in range(700):  # few letters: many neighbours and runs of equal letters
        word = "".join(pick.choice("abé") for _ in range(pick.randint(1, 7)))
        counts[word] = pick.choice([5, 5, 25, 26, 130, 700])
    return counts


def test_like_brute_force(spark):
    assert found_in(spark, few_letters()) == plain(few_letters())


def test_like_brute_force_over_partitions(spark, dealt_out):
    assert found_in(spark, few_letters()) == plain(few_letters())


def test_chains_ties_and_long_words(spark):
    long = "long" * 5_000
    counts = {
        "colour": 5, "colors": 25, "color": 125, "colon": 125, "colours": 1, "zzzzzz": 9,
        long: 5, long[:-1]: 25, long[1:]: 25, long[:9_000] + "x" + long[9_001:]: 700,
    }
    found = {row[0]: row for row in found_in(spark, counts)}
    assert sorted(found.values()) == plain(counts)
    assert found["colours"][1:3] == ("colour", "color") or found["colours"][2] in ("color", "colon")
    assert found[long][1].count("x") == 1 and found["zzzzzz"][1:] == (None, "zzzzzz", 9, 0, None)


def test_nodes_are_those_of_the_trie(spark, dealt_out):
    pick = random.Random(2)
    words = {"".join(pick.choice("ab") for _ in range(pick.randint(1, 9))) for _ in range(300)}
    frame = spark.createDataFrame([(x,) for x in words], "word string").repartition(3)
    seen = {}
    found = spelling.numbered(frame)
    assert found.select(F.floor(F.col("place") / spelling._RANGE)).distinct().count() > 4
    rows = found.collect()
    for row in rows:
        for depth, node in enumerate(row.nodes):
            assert seen.setdefault(row.word[:depth], node) == node
        assert len(row.nodes) == len(row.word) + 1
    assert len(set(seen.values())) == len(seen)
    assert [x.word for x in sorted(rows, key=lambda x: x.place)] == sorted(words)


def words_of(rows):
    counts = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            mark = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if mark % 199 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 5}


def test_query(spark, documents):
    rows = [(row.doc_id, row.text) for row in documents.collect()]
    counts = words_of(rows)
    found = sorted(tuple(row) for row in queries.op11_trie_pairs(spark, FOLDER).collect())
    assert [(row[0], row[3]) for row in found] == sorted(counts.items())
    assert found == plain(counts)


def test_awkward_rows(spark, awkward, no_docs, tmp_path):
    docs = awkward.unionByName(awkward.withColumn("text", F.repeat(F.lit("Éclair éclair ÉCLAIR "), 9)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(x[0], x[1]) for x in ROWS] + [(x[0], "Éclair éclair ÉCLAIR " * 9) for x in ROWS]
    found = sorted(tuple(row) for row in queries.op11_trie_pairs(spark, str(tmp_path)).collect())
    assert found == plain(words_of(rows))
    assert {"Éclair", "éclair"} <= {row[0] for row in found}
    empty = spelling.runs(no_docs).select(F.col("run").alias("word"))
    assert spelling.variants(spelling.counted(empty)).count() == 0
