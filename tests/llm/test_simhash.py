from __future__ import annotations

import random
import re

import pytest
import xxhash

from countinghouse.llm import queries, simhash
from countinghouse.llm.components import components
from tests.llm.conftest import FOLDER, ROWS


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(marks, linked):
    parent = list(range(len(marks)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(marks)):
        for b in range(a):
            if linked(marks[a], marks[b]):
                parent[root(a)] = root(b)
    return [root(n) for n in range(len(marks))]


def plain(rows):
    marks = [plain_fingerprint(text) for _, text in rows]
    roots = groups(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (number, _), at in zip(rows, roots):
        if number is not None:
            least[at] = min(number, least.get(at, number))
    return sorted(
        ((n, f"{mark:016x}", least.get(at)) for (n, _), mark, at in zip(rows, marks, roots)), key=str
    )


def near_copies(text, count):
    pick, words, out = random.Random(1), text.split()[:150], []
    for _ in range(count):
        copy = list(words)
        for _ in range(pick.randint(0, 4)):
            copy[pick.randrange(len(copy))] = f"w{pick.randrange(9)}"
        out.append(" ".join(copy))
    return out


def test_like_brute_force(spark, documents):
    rows = [(row.doc_id, row.text) for row in documents.collect()]
    rows += [(1_000 + n, text) for n, text in enumerate(near_copies(rows[0][1], 120))]
    rows += [(row[0] and 20_000 + row[0], row[1]) for row in ROWS] + [(5_000, "A  B\tc\x1cd e"), (5_001, "ÀÉ É")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_digits("fingerprint").alias("f"), "component_id"
    )
    wanted = plain(rows)
    assert sorted((tuple(row) for row in found.collect()), key=str) == wanted
    kept = simhash.one_of_each(docs).collect()
    groups_ = {component for _, _, component in wanted}
    assert sorted((row.doc_id for row in kept), key=str) == sorted(groups_, key=str)


@pytest.mark.parametrize("distance", [1, 4, 7])
def test_no_link_is_lost(spark, distance):
    pick, marks = random.Random(3), set()
    for _ in range(50):
        centre = pick.getrandbits(64)
        for flips in range(9):
            mark = centre
            for _ in range(min(flips, distance + 2)):
                mark ^= 1 << pick.randrange(64)
            marks.add(mark)
    marks = sorted(marks)
    roots = groups(marks, lambda a, b: (a ^ b).bit_count() <= distance)
    signed = [mark - (mark >> 63 << 64) for mark in marks]
    wanted = {}
    for mark, root in zip(signed, roots):
        wanted.setdefault(root, set()).add(mark)
    frame = spark.createDataFrame([(mark,) for mark in signed], "fingerprint bigint")
    found = {}
    for row in simhash.links(frame, distance).collect():
        found.setdefault(row.label, set()).add(row.node)
    assert sorted(map(sorted, found.values())) == sorted(
        sorted(x) for x in wanted.values() if len(x) > 1
    )


def test_awkward_rows(awkward, no_docs):
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == len(ROWS)
    empty = {row.component_id for row in found if row.doc_id in (2, 3, 4)}
    assert empty == {2}
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(row.doc_id for row in kept.collect() if row.doc_id) == [1, 2, 5, 6, 8]
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 100 + n) for n in range(1, 40)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    found = {row.node: row.label for row in components(frame).collect()}
    assert found == {n: 0 for n in range(61)} | {100 + n: 100 for n in range(40)}
    assert components(frame.limit(0)).count() == 0


def test_query(spark, documents):
    rows = [(row.doc_id, row.text) for row in documents.collect()]
    found = queries.op9_simhash(spark, FOLDER).collect()
    assert sorted((tuple(row) for row in found), key=str) == plain(rows)
