"""Likeness of HTML tables as trees: one less the edit distance over the larger tree's size.

A tree is read as its nodes in document order with their depths.  A node's place in post order and the place of its leftmost leaf
follow from its subtree's size, so that the distance works on arrays, a row of forest prefixes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.operators.sequences import edit_cost

#: Elements that make nodes, and how deep each may stand; an element closes all open ones that stand as deep or deeper.
RANK = {"table": 0, "thead": 1, "tbody": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3}
CELL = RANK["td"]


@dataclass
class Tree:
    """Nodes in document order: (element, row span, column span), depth, and the text of cells."""

    labels: list[tuple[str, str, str]] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def add(self, label: tuple[str, str, str], depth: int, text: str = "") -> None:
        self.labels.append(label)
        self.depths.append(depth)
        self.texts.append(text)


class _Reader(HTMLParser):
    """Collects the first table; a table inside a cell is a subtree of the cell."""

    def __init__(self) -> None:
        super().__init__()
        self.tree, self.open, self.done = Tree(), [], False  # open: (element, node)

    def handle_starttag(self, tag, attrs):
        if tag not in RANK or self.done or not (self.open or tag == "table"):
            return
        if tag != "table":  # rows and cells may be left unclosed, up to the table they belong to
            while self.open[-1][0] != "table" and RANK[self.open[-1][0]] >= RANK[tag]:
                self.open.pop()
        a = dict(attrs) if RANK[tag] == CELL else {}
        self.tree.add((tag, a.get("rowspan") or "1", a.get("colspan") or "1"), len(self.open))
        self.open.append((tag, len(self.tree.labels) - 1))

    def handle_endtag(self, tag):
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]
            self.done = not self.open

    def handle_data(self, data):
        if self.open and RANK[self.open[-1][0]] == CELL:
            self.tree.texts[self.open[-1][1]] += data


def table_tree(html: str) -> Tree:
    """The first table's tree; a lone table without rows if there is none."""
    r = _Reader()
    r.feed(html)
    if not r.tree.labels:
        r.tree.add(("table", "1", "1"), 0)
    return r.tree


def _post_order(depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(document place of each node in post order, post place of each one's leftmost leaf)."""
    n = len(depths)
    end, open_ = np.full(n, n), []
    for i, d in enumerate(depths):
        while open_ and depths[open_[-1]] >= d:
            end[open_.pop()] = i
        open_.append(i)
    size = end - np.arange(n)
    place = end - 1 - np.asarray(depths)
    order = np.argsort(place)
    return order, np.arange(n) - size[order] + 1


def _changes(a: Tree, b: Tree, at: np.ndarray, bt: np.ndarray, structure_only: bool) -> np.ndarray:
    """Cost of changing each node of one tree into each of the other: 1 for another label, the share of edited text for cells."""
    kinds = {x: k for k, x in enumerate({*a.labels, *b.labels})}
    ka, kb = (np.array([kinds[t.labels[i]] for i in order]) for t, order in ((a, at), (b, bt)))
    cost = (ka[:, None] != kb[None, :]).astype(float)
    if structure_only:
        return cost
    ta, tb = ([" ".join(t.texts[i].split()) if RANK[t.labels[i][0]] == CELL else "" for i in order] for t, order in ((a, at), (b, bt)))
    seen: dict[tuple[str, str], float] = {}
    for u, v in zip(*np.nonzero(cost == 0), strict=True):
        x, y = ta[u], tb[v]
        if x != y:
            if (x, y) not in seen:
                seen[x, y] = edit_cost(x, y) / max(len(x), len(y))
            cost[u, v] = seen[x, y]
    return cost


def _last_of_each(first: np.ndarray) -> np.ndarray:
    """The last node of each leftmost leaf: all subtrees' distances come up inside these nodes' forests."""
    return len(first) - 1 - np.unique(first[::-1], return_index=True)[1][::-1] if len(first) else first


def tree_distance(a: Tree, b: Tree, structure_only: bool = False) -> float:
    """Least cost of inserting and deleting (1 each) and changing nodes of ordered trees (the published key-root method)."""
    at, fa = _post_order(a.depths)
    bt, fb = _post_order(b.depths)
    change = _changes(a, b, at, bt, structure_only)
    whole = np.zeros_like(change)  # distances of subtrees, filled from small to large
    for i in np.sort(_last_of_each(fa)):
        for j in np.sort(_last_of_each(fb)):
            p, q = fa[i], fb[j]
            cols = np.arange(q, j + 1)
            along, steps = fb[cols] == q, np.arange(1, len(cols) + 1)
            forest = np.empty((i - p + 2, len(cols) + 1))
            forest[0] = np.arange(len(cols) + 1)
            for k, u in enumerate(range(p, i + 1), 1):
                # Keep u and v as roots of whole subtrees: what stands left of these, and the subtrees themselves.
                kept = forest[fa[u] - p, fb[cols] - q] + whole[u, cols]
                if fa[u] == p:
                    kept = np.where(along, forest[k - 1, :-1] + change[u, cols], kept)
                best = np.minimum(forest[k - 1, 1:] + 1, kept)
                forest[k, 0] = k
                forest[k, 1:] = np.minimum(np.minimum.accumulate(best - steps), k) + steps
                if fa[u] == p:
                    whole[u, cols[along]] = forest[k, 1:][along]
    return float(whole[-1, -1])


def table_likeness(got: str, truth: str, structure_only: bool = False) -> float:
    a, b = table_tree(got), table_tree(truth)
    return 1 - tree_distance(a, b, structure_only) / max(len(a.labels), len(b.labels))


def likeness(got: Column, truth: Column, structure_only: bool = False) -> Column:
    """Likeness of two columns of HTML, 0 to 1; null with a null side."""

    @F.pandas_udf("double")
    def run(g: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else table_likeness(x, y, structure_only) for x, y in zip(g, t, strict=True)], dtype=float)

    return run(got, truth)
