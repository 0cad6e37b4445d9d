"""Tries as level-order unary degree sequences (LOUDS) in numpy, and sums over their subtrees."""

from __future__ import annotations

import numpy as np


def parents_of(keys: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """For each row of ``parents`` (n x 2) the row of ``keys`` (n x 2, distinct) that equals it, or -1."""
    n = len(keys)
    both = np.concatenate([keys, parents])
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.ones(len(both), bool)
    new[1:] = (both[order[1:]] != both[order[:-1]]).any(1)
    group = np.empty(len(both), np.int64)
    group[order] = np.cumsum(new) - 1
    at = np.full(int(new.sum()), -1, np.int64)
    at[group[:n]] = np.arange(n)
    return at[group[n:]]


class Louds:
    """A forest under one added root, node 0; the others are numbered level by level, children in the order of their labels.

    ``bits`` has for each node a one for each child and then a zero, so nodes take about two bits each. ``rows[i]`` is the
    input's row of node i + 1; ``levels`` are the bounds of the levels in the numbering.
    """

    def __init__(self, parent: np.ndarray, level: np.ndarray, labels: np.ndarray):
        """parent: each row's parent row, or -1 for a top; level: 0 for tops; labels: n x 2, distinct among siblings."""
        n = len(parent)
        by_level = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2 if n else 1))
        number = np.zeros(n, np.int64)
        rows, self.levels = np.empty(n, np.int64), [1]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            here = by_level[a:b]
            above = np.where(parent[here] < 0, 0, number[parent[here]])
            here = here[np.lexsort((labels[here, 1], labels[here, 0], above))]
            rows[a:b] = here
            number[here] = np.arange(a + 1, b + 1)
            self.levels.append(b + 1)
        self.rows = rows
        above = np.where(parent[rows] < 0, 0, number[parent[rows]])
        degree = np.bincount(above, minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def __len__(self) -> int:
        return len(self.rows) + 1

    def parents(self) -> np.ndarray:
        """The parents of nodes 1 and on: the zeros before a node's one say whose child it is."""
        return np.flatnonzero(self.bits) - np.arange(len(self.rows))

    def degrees(self) -> np.ndarray:
        """How many children each node has, the added root included."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (one for each input row) over each input row's subtree, itself included."""
        total = np.concatenate([np.zeros(1, np.int64), np.asarray(values, np.int64)[self.rows]])
        above = self.parents()
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            np.add.at(total, above[a - 1 : b - 1], total[a:b])
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = total[1:]
        return out

    def children(self) -> np.ndarray:
        """Each input row's number of children in the forest."""
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = self.degrees()[1:]
        return out
