"""Fitted tree ensembles as SQL expressions, so that a model scores inside generated code and any engine can repeat it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

_TREE = re.compile(r"\s*Tree \d+ \(weight ([^)]+)\):")
_IF = re.compile(r"\s*If \(feature (\d+) <= ([^)]+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Node:
    """Left where the feature is at most the threshold."""

    feature: int
    threshold: float
    left: Node | Leaf
    right: Node | Leaf


def _read(lines: Iterator[str]) -> Node | Leaf:
    line = next(lines)
    if m := _LEAF.match(line):
        return Leaf(float(m[1]))
    if not (m := _IF.match(line)):
        raise ValueError(f"only splits of numbers are known: {line.strip()}")
    left = _read(lines)
    next(lines)  # Else
    return Node(int(m[1]), float(m[2]), left, _read(lines))


def ensemble(debug: str, first: int | None = None) -> list[tuple[float, Node | Leaf]]:
    """(weight, tree) of an ML ensemble's ``toDebugString``; the ``first`` so many."""
    lines = iter(debug.splitlines()[1:])
    out = []
    for line in lines:
        if m := _TREE.match(line):
            out.append((float(m[1]), _read(lines)))
    return out[:first]


def single(debug: str) -> Node | Leaf:
    """The tree of a single model's ``toDebugString``."""
    return _read(iter(debug.splitlines()[1:]))


def tree_sql(tree: Node | Leaf, name: Callable[[int], str]) -> str:
    """A tree as nested CASE; ``name`` gives the SQL of a feature by its index. Doubles keep all digits."""
    if isinstance(tree, Leaf):
        return f"CAST({tree.value!r} AS DOUBLE)"
    return f"CASE WHEN {name(tree.feature)} <= CAST({tree.threshold!r} AS DOUBLE) THEN {tree_sql(tree.left, name)} ELSE {tree_sql(tree.right, name)} END"


def ensemble_sql(trees: list[tuple[float, Node | Leaf]], name: Callable[[int], str]) -> str:
    """The weighted sum of the trees, first to last."""
    return " + ".join(f"CAST({w!r} AS DOUBLE) * {tree_sql(t, name)}" for w, t in trees) or "CAST(0 AS DOUBLE)"


@dataclass(frozen=True)
class Flat:
    """A tree as arrays, one place per node; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


def flatten(tree: Node | Leaf) -> Flat:
    rows: list[list] = []

    def add(t: Node | Leaf) -> tuple[int, int]:
        at = len(rows)
        rows.append([0, np.inf, at, at, t.value if isinstance(t, Leaf) else 0.0])
        if isinstance(t, Leaf):
            return at, 0
        (left, deep), (right, deeper) = add(t.left), add(t.right)
        rows[at][:4] = t.feature, t.threshold, left, right
        return at, 1 + max(deep, deeper)

    depth = add(tree)[1]
    feature, threshold, left, right, value = zip(*rows, strict=True)
    return Flat(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float), depth)


def predict_batch(trees: list[tuple[float, Flat]], x: np.ndarray, base: float = 0.0) -> np.ndarray:
    """base and the weighted trees, first to last, for a batch of rows (rows, features): all rows go down a level at a time."""
    y, each = np.full(len(x), base), np.arange(len(x))
    for w, t in trees:
        at = np.zeros(len(x), int)
        for _ in range(t.depth):
            at = np.where(x[each, t.feature[at]] <= t.threshold[at], t.left[at], t.right[at])
        y += w * t.value[at]
    return y


def leaves(tree: Node | Leaf) -> int:
    return 1 if isinstance(tree, Leaf) else leaves(tree.left) + leaves(tree.right)


def predict(trees: list[tuple[float, Node | Leaf]], row: list[float]) -> float:
    """The same on the driver, for one row."""
    total = 0.0
    for w, t in trees:
        while isinstance(t, Node):
            t = t.left if row[t.feature] <= t.threshold else t.right
        total += w * t.value
    return total
