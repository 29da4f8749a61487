from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from countinghouse.llm import nbsvm, queries
from tests.llm.conftest import ROWS

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op2_naive_bayes_svm(spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([a for a, b in held if b == 1]) > 0.97


def test_columns_are_the_distinct_n_grams():
    found = nbsvm.columns_of(b"abab", nbsvm.scratch())
    assert len(found) == len(set(found.tolist())) == 2 + 2 + 2 + 1
    strip, nbsvm.STRIP = nbsvm.STRIP, 7
    try:
        text = bytes(range(60, 120)) * 3
        cut = nbsvm.columns_of(text, nbsvm.scratch())
    finally:
        nbsvm.STRIP = strip
    assert sorted(cut) == sorted(nbsvm.columns_of(text, nbsvm.scratch()))
    assert not len(nbsvm.columns_of(b"", nbsvm.scratch()))


def test_descent_reaches_the_optimum():
    random = np.random.default_rng(0)
    rows = [np.array([0, 1, 2]) for _ in range(60)]
    values = [random.normal(size=3) for _ in range(60)]
    signs = np.array([1 if v @ [1, -2, 0.5] + 0.3 * random.normal() > 0 else -1 for v in values])

    def loss(w):
        most = {s: 60 / (2 * (signs == s).sum()) for s in (-1, 1)}
        hinge = sum(most[s] * max(0, 1 - s * (w @ v)) for s, v in zip(signs, values))
        return w @ w / 2 + hinge

    best = nbsvm.dual_coordinate_descent(rows, values, signs, rounds=200)[:3]
    for _ in range(300):
        assert loss(best) <= loss(best + random.normal(scale=0.05, size=3)) + 1e-3


@pytest.mark.parametrize("most", [1 << 25, 6_000])
def test_the_model_follows_from_the_rows(spark, monkeypatch, most):
    """Repeated ids with many texts, in any partitioning: one model."""
    monkeypatch.setattr(nbsvm, "MAX_COLUMNS", most)
    rows = [(n % 60, f"{'good plain words' if n % 2 else '$$ buy % now'} {n % 60} {n // 60}") for n in range(1_200)]
    labels = [(n, n % 2, 0) for n in range(60)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    scores = set()
    for parts in (1, 4, 8):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        model = nbsvm.train(docs, known, usable=F.lit(True), max_train=50)
        scores.add(tuple(model.score(nbsvm.columns_of(text.encode(), nbsvm.scratch())) for _, text in rows[:120]))
    (found,) = scores
    right = [(score > 0.5) == bool(number % 2) for (number, _), score in zip(rows, found)]
    assert sum(right) > 100


def test_features_that_come_to_the_driver_are_bounded(spark, monkeypatch):
    seen = []
    fit = nbsvm.fit
    monkeypatch.setattr(nbsvm, "fit", lambda rows, marks: seen.append(sum(map(len, rows))) or fit(rows, marks))
    rows = [(n, f"{n} some text with a number of different words {n * 7919}") for n in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(n, n % 2) for n in range(80)], "doc_id bigint, quality int")
    for most in (0, 500, 5_000, 1 << 25):
        monkeypatch.setattr(nbsvm, "MAX_COLUMNS", most)
        nbsvm.train(docs, known, usable=F.lit(True))
        assert seen[-1] <= most
    assert seen[0] == 0 < seen[1] < seen[2] < seen[3]


def test_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (6, 0, 1), (9, 1, 0), (5, None, 0), (None, 1, 0), (3, 1, 0), (3, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    model = nbsvm.train(awkward, labels, usable=F.lit(True))
    scores = nbsvm.scored(awkward, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    none = nbsvm.train(awkward, labels.limit(0), usable=F.lit(True))
    assert {r.score for r in nbsvm.scored(awkward, none).collect()} == {0.5}
    assert nbsvm.scored(no_docs, model).count() == 0


def plain_columns(text):
    """Distinct hashed n-grams, by whole numbers of Python."""
    found = set()
    for order in nbsvm.ORDERS:
        for start in range(len(text) - order + 1):
            code = order
            for byte in text[start : start + order]:
                code = code << 8 | byte
            found.add((code * 0x9E3779B97F4A7C15) % (1 << 64) >> 64 - nbsvm.LOG_COLUMNS)
    return found


def plain_scores(trained, labels, texts):
    """The method step by step with sets and dictionaries; the dual is solved by projected
    gradients instead of by coordinates."""
    rows = [plain_columns(text) for text in trained]
    seen = [n for n in range(len(rows)) if n % nbsvm.CURVE_PART]
    counts = [{}, {}]
    for n in seen:
        for column in rows[n]:
            counts[labels[n]][column] = counts[labels[n]].get(column, 0) + 1
    sums = [sum(count.values()) + (1 << nbsvm.LOG_COLUMNS) for count in counts]

    def scaled(row):
        value = {
            c: math.log((counts[1].get(c, 0) + 1) / sums[1] / ((counts[0].get(c, 0) + 1) / sums[0]))
            for c in row
        }
        length = math.sqrt(sum(x * x for x in value.values()))
        return {c: x / length for c, x in value.items()} if length else {}

    def product(a, b):
        return sum(x * b.get(c, 0) for c, x in a.items())

    values, signs = [scaled(rows[n]) for n in seen], np.array([2 * labels[n] - 1 for n in seen])
    gram = np.array([[product(a, b) for b in values] for a in values]) * np.outer(signs, signs)
    most = np.array([len(signs) / (2 * (signs == sign).sum()) for sign in signs])
    alpha, step = np.zeros(len(signs)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, most)
    weights = {}
    for a, sign, value in zip(alpha, signs, values):
        for c, x in value.items():
            weights[c] = weights.get(c, 0) + a * sign * x

    apart = [n for n in range(len(rows)) if n % nbsvm.CURVE_PART == 0]
    margins = np.array([product(scaled(rows[n]), weights) for n in apart])
    ones = sum(labels[n] for n in apart)
    wanted = [(ones + 1) / (ones + 2) if labels[n] else 1 / (len(apart) - ones + 2) for n in apart]
    slope = intercept = 0.0
    for _ in range(40_000):
        off = 1 / (1 + np.exp(-(slope * margins + intercept))) - wanted
        slope, intercept = slope - 0.5 * (off * margins).mean(), intercept - 0.5 * off.mean()
    return [
        1 / (1 + math.exp(-slope * product(scaled(plain_columns(t)), weights) - intercept))
        for t in texts
    ]


def test_scores_like_plain_code(spark):
    pick = random.Random(5)
    words = "the of a tree house $$ buy now click ## good story water".split()
    texts, labels = [], []
    for n in range(60):
        label = n // 4 % 2
        weights = [3, 3, 3, 2, 2, 1, 1, 1, 1, 1, 2, 2, 2] if label else [1, 1, 1, 1, 1, 3, 3, 2, 3, 2, 1, 1, 1]
        texts.append(" ".join(pick.choices(words, weights, k=pick.randint(8, 25))).encode())
        labels.append(label)
    slot = nbsvm.scratch()
    rows = [nbsvm.columns_of(text, slot) for text in texts]
    assert all(set(row.tolist()) == plain_columns(text) for row, text in zip(rows, texts))
    model = nbsvm.fit(rows, np.array(labels))
    asked = texts + [b"", b"x", "Größe ist gut".encode(), b"buy now " * 300]
    wanted = plain_scores(texts, labels, asked)
    docs = spark.createDataFrame(
        [(n, text.decode()) for n, text in enumerate(asked)] + [(len(asked), None)], "doc_id bigint, text string"
    )
    found = [row.score for row in nbsvm.scored(docs, model).orderBy("doc_id").collect()]
    assert found.pop() == found[60]  # null like empty
    assert np.abs(np.array(found) - wanted).max() < 0.02
    assert max(wanted) - min(wanted) > 0.5
