"""Boosted trees for a few thousand rows: logistic loss, binned features, small depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
SMOOTHING = 1.0


@dataclass
class Tree:
    """A full binary tree: features and borders by inner node, values by leaf."""

    features: np.ndarray
    borders: np.ndarray
    values: np.ndarray

    def value(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        inner = len(self.features)
        while len(node) and node[0] < inner:  # all leaves have one depth
            right = rows[np.arange(len(rows)), self.features[node]] > self.borders[node]
            node = 2 * node + 1 + right
        return self.values[node - inner]


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def chance(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for tree in self.trees:
            total += tree.value(rows)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _borders(column: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))


def _tree(
    binned: np.ndarray, borders: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int
) -> Tree:
    inner = 2**depth - 1
    features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(binned), np.int64)
    for parent in range(inner):
        here = np.flatnonzero(node == parent)
        best, place = 1e-9, None
        if len(here) > 1:
            total_slope, total_curve = slope[here].sum(), curve[here].sum()
            whole = total_slope**2 / (total_curve + SMOOTHING)
            for feature, edges in enumerate(borders):
                if not len(edges):
                    continue
                bins = binned[here, feature]
                left_slope = np.cumsum(np.bincount(bins, slope[here], len(edges) + 1))[:-1]
                left_curve = np.cumsum(np.bincount(bins, curve[here], len(edges) + 1))[:-1]
                gain = (
                    left_slope**2 / (left_curve + SMOOTHING)
                    + (total_slope - left_slope) ** 2 / (total_curve - left_curve + SMOOTHING)
                    - whole
                )
                at = int(gain.argmax())
                if gain[at] > best:
                    best, place = gain[at], (feature, at)
        right = np.zeros(len(here), np.int64)
        if place:
            features[parent], cuts[parent] = place[0], borders[place[0]][place[1]]
            right = (binned[here, place[0]] > place[1]).astype(np.int64)
        node[here] = 2 * parent + 1 + right
    leaf = node - inner
    slopes = np.bincount(leaf, slope, inner + 1)
    curves = np.bincount(leaf, curve, inner + 1)
    return Tree(features, cuts, slopes / (curves + SMOOTHING))


def boost(
    rows: np.ndarray, labels: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2
) -> Boosted:
    """Trees that add up to the log odds of label 1."""
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    borders = [_borders(rows[:, n]) for n in range(rows.shape[1])]
    binned = np.column_stack(
        [np.searchsorted(edges, rows[:, n], side="left") for n, edges in enumerate(borders)]
    )
    total, trees = np.full(len(rows), start), []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        tree = _tree(binned, borders, labels - chance, chance * (1 - chance), depth)
        tree.values *= rate
        trees.append(tree)
        total += tree.value(rows)
    return Boosted(start, trees)
