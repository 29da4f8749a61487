"""Quality classifier: naive Bayes features in a linear support vector machine.

A text's features are the byte n-grams it contains, hashed to a fixed number of
columns. Each column is scaled by the logarithm of the ratio of its smoothed counts
in the two classes, each text to unit length, and a linear hinge-loss model is fitted
by dual coordinate descent. A logistic curve, fitted to labelled rows that the model
did not see, turns margins into probabilities.

Defined results: a null or empty text is scored like one without features; repeated
rows are scored each; labels that are null or not 0 or 1 are ignored, and with labels of one class
or none every text gets the share of label 1 (0.5 without labels); an empty table
gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import bytes_of, list_array, lists, sliced
from countinghouse.llm.sampling import smallest_hashes
from countinghouse.session import stored

ORDERS = (1, 2, 3, 4)
#: Logarithm of the number of feature columns.
LOG_COLUMNS = 18
#: Bound of the training sample, in documents.
MAX_TRAIN = 6_000
#: Features of all these documents together; the given ones have about 3 000 each.
MAX_COLUMNS = 1 << 25
#: Every so many-th document of the sample fits the logistic curve.
CURVE_PART = 4
#: Bytes of a text whose n-grams are looked up at once.
STRIP = 1 << 20


def columns_of(text: bytes, slot: np.ndarray) -> np.ndarray:
    """The distinct feature columns of a text. ``slot`` is scratch space."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    found = []
    for start in range(0, max(1, len(data)), STRIP):
        strip = data[start : start + STRIP + max(ORDERS) - 1]
        for order in ORDERS:
            count = min(STRIP, len(strip) - order + 1)
            if count < 1:
                continue
            code = np.full(count, order, np.uint64)
            for n in range(order):
                code = code << np.uint64(8) | strip[n : n + count]
            code *= np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
            place = (code >> np.uint64(64 - LOG_COLUMNS)).astype(np.int64)
            at = np.arange(count)
            slot[place] = at  # of equal columns the last one stays
            found.append(place[slot[place] == at])
    if len(found) > 1:
        joined = np.concatenate(found)
        at = np.arange(len(joined))
        slot[joined] = at
        return joined[slot[joined] == at]
    return found[0] if found else np.empty(0, np.int64)


def scratch() -> np.ndarray:
    return np.zeros(1 << LOG_COLUMNS, np.int64)


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << LOG_COLUMNS))
    for row, label in zip(rows, labels):
        counts[label, row] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, rounds: int = 10
) -> np.ndarray:
    """Weights that minimise |w|²/2 plus the hinge losses, classes weighted alike."""
    weights, alpha = np.zeros(1 << LOG_COLUMNS), np.zeros(len(rows))
    most = {sign: len(signs) / (2 * (signs == sign).sum()) for sign in (-1, 1)}
    norms = np.array([value @ value for value in values])
    random = np.random.default_rng(0)
    for _ in range(rounds):
        for n in random.permutation(len(rows)):
            if not norms[n]:
                continue
            sign = signs[n]
            slope = sign * (weights[rows[n]] @ values[n]) - 1
            new = min(max(alpha[n] - slope / norms[n], 0), most[sign])
            if new != alpha[n]:
                weights[rows[n]] += (new - alpha[n]) * sign * values[n]
                alpha[n] = new
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make ``1 / (1 + exp(-(slope * m + intercept)))`` likeliest."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design = np.column_stack([margins, np.ones(len(margins))])
    solution = np.zeros(2)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ solution, -30, 30)))
        curvature = design.T @ (design * (chance * (1 - chance))[:, None]) + 1e-6 * np.eye(2)
        solution = solution - np.linalg.solve(curvature, design.T @ (chance - wanted))
    return float(solution[0]), float(solution[1])


class Model:
    """Weights by feature column, folded with the ratios, and the curve."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.ratio, self.weights, self.curve = ratio, ratio * weights, curve

    def margin(self, row: np.ndarray) -> float:
        length = np.sqrt(np.square(self.ratio[row]).sum())
        return float(self.weights[row].sum() / length) if length else 0.0

    def score(self, row: np.ndarray) -> float:
        slope, intercept = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * self.margin(row) + intercept, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    empty = np.zeros(1 << LOG_COLUMNS)
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(empty, empty, (0.0, float(np.log(share / (1 - share)))))
    for_curve = np.arange(len(rows)) % CURVE_PART == 0
    if len(set(labels[for_curve].tolist())) < 2 or len(set(labels[~for_curve].tolist())) < 2:
        for_curve[:] = False
    seen = [row for row, other in zip(rows, for_curve) if not other]
    known = labels[~for_curve]
    ratio = log_count_ratio(seen, known)
    values = []
    for row in seen:
        value = ratio[row]
        length = np.sqrt(value @ value)
        values.append(value / length if length else value)
    model = Model(ratio, dual_coordinate_descent(seen, values, known * 2 - 1), (1.0, 0.0))
    checked = for_curve if for_curve.any() else ~for_curve
    margins = np.array([model.margin(row) for row, other in zip(rows, checked) if other])
    model.curve = logistic_curve(margins, labels[checked])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slot = scratch()
    for batch in batches:
        for part in sliced(batch, 200):
            rows = [columns_of(text.as_py(), slot) for text in part["text"]]
            yield pa.RecordBatch.from_arrays(
                [part["label"], list_array(rows, pa.int32())], names=["label", "columns"]
            )


def _last_mark(found: DataFrame) -> int:
    """Up to which hash the documents hold ``MAX_COLUMNS`` features together, at most."""
    sizes = found.groupBy("mark").agg(F.sum(F.size("columns")).alias("held")).collect()
    total, last = 0, -(1 << 63)
    for row in sorted(sizes, key=lambda row: row["mark"]):
        total += row["held"]
        if total > MAX_COLUMNS:
            break
        last = row["mark"]
    return last


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model from at most ``max_train`` labelled documents, those with the smallest
    hashes of their ids. Only hashed features of this bounded sample come to the driver,
    ``MAX_COLUMNS`` of them at most; longer samples are cut at a hash of the features.

    ``usable`` tells by ``id`` which labels may be learnt from.
    """
    known = labels.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).filter(usable & F.col("label").isin(0, 1))
    sample = stored(
        known.join(smallest_hashes(known, max_train), "id")
        .groupBy("id")
        .agg(F.max("label").alias("label")),
        "labels",
    )
    # One text of each id, the smallest, so that the model follows from the rows alone.
    found = stored(
        bytes_of(docs, id_col, text_col)
        .join(sample, "id")
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .select("id", "label", "text")
        .mapInArrow(_features, "label int, columns array<int>")
        .withColumn("mark", F.xxhash64("columns")),
        "features",
    )
    kept = found.filter(F.col("mark") <= _last_mark(found)).select("label", "columns")
    found = kept.toArrow().combine_chunks()
    if not found.num_rows:
        return fit([], np.empty(0, np.int64))
    rows = [row.astype(np.int64) for row in lists(found["columns"].combine_chunks())]
    marks = found["label"].to_numpy().astype(np.int64)
    # In an order that doesn't depend on how the tasks ended.
    order = sorted(range(len(rows)), key=lambda n: (len(rows[n]), rows[n].tobytes(), marks[n]))
    order = np.random.default_rng(1).permutation(np.array(order)).tolist()
    return fit([rows[n] for n in order], marks[order])


def scored(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col`` and ``score``, the chance of label 1, of each row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # two columns of fixed length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, model = scratch(), spread.value
        for batch in batches:
            for part in sliced(batch, 500):
                scores = [model.score(columns_of(text.as_py(), slot)) for text in part["text"]]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(scores, pa.float64())], names=["id", "score"]
                )

    given = bytes_of(docs, id_col, text_col)
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
