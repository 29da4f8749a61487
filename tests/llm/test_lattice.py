from __future__ import annotations

import itertools

import numpy as np
import pytest

from countinghouse.llm import lattice, queries
from tests.llm.conftest import FOLDER
from tests.llm.test_simhash import groups

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def directions(rows):
    good = [
        x is not None
        and label is not None
        and len(x) > 0
        and None not in x
        and bool(np.isfinite(x).all())
        and any(x)
        for _, x, label in rows
    ]
    return [np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)) if ok else None
            for ok, (_, x, _) in zip(good, rows)]


def plain(rows, threshold=0.93):
    """Every pair by cosine."""
    vectors = directions(rows)

    def linked(a, b):
        x, y = vectors[a], vectors[b]
        if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
            return False
        return float(x @ y) >= threshold

    known = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if linked(a, b)}
    counts = [0] * len(rows)
    for a, b in known:
        counts[a] += 1
        counts[b] += 1
    roots = groups(list(range(len(rows))), lambda a, b: (b, a) in known)
    least = {}
    for row, root in zip(rows, roots):
        if row[0] is not None:
            least[root] = min(row[0], least.get(root, row[0]))
    return [
        (row[0], n, least.get(root), row[0] == least.get(root))
        for row, n, root in zip(rows, counts, roots)
    ], counts


def near(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return [tuple(row) for row in lattice.near_vectors(frame, **more).collect()]


def clouds(pick, centres=40, size=12, dim=64, spread=0.03):
    rows = []
    for label in range(centres):
        middle = pick.normal(size=dim)
        middle /= np.linalg.norm(middle)
        for _ in range(size):
            at = middle + pick.normal(size=dim) * spread
            rows.append((len(rows), [float(x) for x in np.float32(at * pick.uniform(0.1, 9))], label % 3))
    return rows


def test_neighbours_and_decoding():
    assert len({tuple(x) for x in lattice.NEIGHBOURS.tolist()}) == 240
    assert {int((x.astype(int) ** 2).sum()) for x in lattice.NEIGHBOURS} == {8}
    pick = np.random.default_rng(1)
    for x in pick.normal(size=(200, 8)) * 2:
        found = lattice.decode(x[None])[0] / 2
        near_ = min(
            np.linalg.norm(x - (found + step / 2)) for step in lattice.NEIGHBOURS.astype(float)
        )
        assert np.linalg.norm(x - found) <= near_ + 1e-12
        assert np.linalg.norm(x - found) <= 1 + 1e-12  # the covering radius
        whole = np.all(found == np.rint(found)) or np.all(found + 0.5 == np.rint(found + 0.5))
        assert whole and found.sum() % 2 == 0


def test_cells_do_not_depend_on_what_is_beside():
    pick, table = np.random.default_rng(2), lattice.Lattice()
    rows = pick.normal(size=(300, 64))
    together = table.cells(lattice.units(rows))
    alone = np.concatenate([table.cells(lattice.units(rows[n : n + 1])) for n in range(300)])
    assert (together == alone).all()


def test_recall_at_the_threshold():
    pick, table = np.random.default_rng(3), lattice.Lattice()
    one, turn = lattice.units(pick.normal(size=(2, 3_000, 64)).reshape(6_000, 64)).reshape(2, 3_000, 64)
    turn = lattice.units(turn - (turn * one).sum(axis=1, keepdims=True) * one)
    for cosine, wanted in ((0.93, 0.95), (0.96, 0.99), (0.99, 0.9999)):
        other = cosine * one + np.sqrt(1 - cosine * cosine) * turn
        a, b = table.cells(one), table.cells(other)
        met = np.zeros(len(one), bool)
        for t in range(table.tables):
            for probe in range(1 + table.probes):
                met |= (a[:, t, 0] == b[:, t, probe]).all(axis=1)
                met |= (b[:, t, 0] == a[:, t, probe]).all(axis=1)
        assert met.mean() >= wanted


@pytest.mark.parametrize("block", [3, 1_024])
def test_like_brute_force(spark, block):
    rows = clouds(np.random.default_rng(4), spread=0.01)  # all far above the threshold
    rows += [(1_000 + n, rows[5][1], rows[5][2]) for n in range(30)]  # copies
    rows += [(2_000 + n, rows[5][1], 7) for n in range(3)]  # the same under another label
    wanted, counts = plain(rows)
    assert sum(counts) > 4_000
    assert sorted(near(spark, rows, block=block)) == sorted(wanted)


def test_links_are_never_counted_twice(spark):
    """Wide clouds: pairs on both sides of the threshold, met in several cells and tables."""
    rows = clouds(np.random.default_rng(5), centres=12, size=40, spread=0.028)
    wanted, counts = plain(rows)
    found = sorted(near(spark, rows, block=16))
    assert all(a[1] <= b[1] for a, b in zip(found, sorted(wanted)))
    assert sum(row[1] for row in found) >= 0.97 * sum(counts)


def test_awkward_rows(spark):
    x, big = [1.0, 2.0, 3.0], [3e38, 3e38, 0.0]
    rows = [
        (1, x, 1), (2, [2.0, 4.0, 6.0], 1), (2, [2.0, 4.0, 6.0], 1), (3, x, None), (4, None, 1),
        (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1),
        (9, [1.0, float("inf"), 3.0], 1), (10, [1.0, 2.0], 1), (11, [1.0, 2.0], 1), (None, x, 1),
        (None, [5.0, -1.0, 0.0], 2), (12, big, 3), (13, big, 3), (14, [-0.0, 1.0, 0.0], 3),
        (15, [0.0, 1.0, 0.0], 3),
    ]
    wanted, _ = plain(rows)
    assert sorted(near(spark, rows), key=str) == sorted(wanted, key=str)
    assert near(spark, []) == []


def test_clashing_columns(spark):
    rows = clouds(np.random.default_rng(6), centres=3, spread=0.01)
    frame = spark.createDataFrame(rows, SCHEMA)
    wide = frame.selectExpr(
        "*", *(f"1 as {x}" for x in ("id", "node", "cell", "digest", "vector", "size", "links"))
    )
    assert sorted(map(tuple, lattice.near_vectors(wide).collect())) == sorted(plain(rows)[0])


def test_query(spark):
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [tuple(row) for row in given.select("vec_id", "embedding", "label").collect()]
    found = [tuple(row) for row in queries.op13_lattice_hashing(spark, FOLDER).collect()]
    assert sorted(found) == sorted(plain(rows)[0])
