"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other.  A later model sees, besides the text, the probabilities of the earlier
categories; for training these come from models that did not see the row (out of fold), in use from the model over all rows.

Features of a text are its distinct lower-cased words and their beginnings of 3 to 8 letters.  For each category those are kept
whose presence differs between the classes beyond chance; a logistic model with a ridge penalty weighs them.  Fitting takes a
bounded sample of labelled rows (``max_rows``, those with the least hash of the id); everything else reads all rows.

Defined results: a null text is empty; a null label counts as "not known" and leaves that row out of that category's fit; a
category without both classes in the sample gets its base rate as a constant; a score needs no label; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
STEMS = range(3, 9)
#: Distinct words that a worker remembers the weights of.
REMEMBERED = 400_000
MAX_WORD = 64
#: Places in which training counts features by hash.
SPACE = 1 << 22


def words_of(text: str | None) -> set[str]:
    return {w[:MAX_WORD] for w in WORD.findall((text or "").lower())}


def parts(word: str) -> list[str]:
    """A word's features: the word itself (closed by a mark) and its beginnings."""
    return [f"{word}$", *(word[:n] for n in STEMS if n <= len(word))]


def place_of(feature: str) -> int:
    """Where training counts a feature."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SPACE


class _Parts(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED // 4:
            self.clear()
        out = self[word] = [place_of(p) for p in parts(word)]
        return out


def features_of(text: str | None, known: _Parts) -> np.ndarray:
    return np.unique(np.fromiter((p for w in words_of(text) for p in known[w]), np.int32))


@dataclass
class Linear:
    """Weights by feature, of the earlier probabilities, and the constant."""

    weight: dict
    chained: np.ndarray
    constant: float

    def score(self, features: Iterable, earlier: np.ndarray) -> float:
        z = self.constant + float(self.chained @ earlier) + math.fsum(self.weight.get(f, 0.0) for f in features)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]


def _select(rows: list[np.ndarray], y: np.ndarray, least: int, z: float, most: int) -> np.ndarray:
    """Features in ``least`` rows or more whose shares in the two classes differ by ``z`` standard errors; the ``most`` clearest."""
    df, pos = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)
    for r, t in zip(rows, y, strict=True):
        df[r] += 1
        if t:
            pos[r] += 1
    n, n1 = len(y), int(y.sum())
    at = np.flatnonzero(df >= least)
    p, n0 = df[at] / n, n - n1
    gap = pos[at] / n1 - (df[at] - pos[at]) / n0
    far = np.abs(gap) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    best = np.argsort(-far, kind="stable")[:most]
    return np.sort(at[best[far[best] > z]])


def fit_linear(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, ridge: float = 0.1, least: int = 4, z: float = 5.0, most: int = 600, steps: int = 150) -> Linear:
    """Ridge logistic regression by accelerated gradient steps over the selected features and the earlier probabilities."""
    n, k = len(y), earlier.shape[1]
    rate = (y.sum() + 0.5) / (n + 1)
    flat = Linear({}, np.zeros(k), math.log(rate / (1 - rate)))
    if not n or y.min() == y.max():
        return flat
    names = _select(rows, y, least, z, most)
    place, m = np.full(SPACE, -1, np.int32), len(names)
    place[names] = np.arange(m)
    cols = [c[c >= 0] for c in (place[r] for r in rows)]
    row = np.repeat(np.arange(n), [len(c) for c in cols])
    col = np.concatenate(cols)

    def times(w, c, b):
        return b + earlier @ c + np.bincount(row, weights=w[col], minlength=n)

    def back(e):
        return np.bincount(col, weights=e[row], minlength=m), earlier.T @ e, e.sum()

    v = (np.ones(m), np.ones(k), 1.0)
    for _ in range(20):  # the design's largest singular value, for the length of the steps
        u = back(times(*v))
        size = math.sqrt(float(u[0] @ u[0] + u[1] @ u[1] + u[2] ** 2))
        v = tuple(x / size for x in u)
    step = 1 / (0.25 * 1.2 * size + ridge)
    w, c, b = np.zeros(m), np.zeros(k), flat.constant
    old = (w, c, b)
    for t in range(1, steps + 1):
        pull = (t - 1) / (t + 2)
        vw, vc, vb = w + pull * (w - old[0]), c + pull * (c - old[1]), b + pull * (b - old[2])
        gw, gc, gb = back(1 / (1 + np.exp(-np.clip(times(vw, vc, vb), -40, 40))) - y)
        old = (w, c, b)
        w, c, b = vw - step * (gw + ridge * vw), vc - step * (gc + ridge * vc), vb - step * gb
    return Linear({int(f): float(x) for f, x in zip(names, w, strict=True)}, c, float(b))


def fit_chain(texts: list[str | None], labels: dict[str, list[int | None]], folds: int = 5, fold_of: list[int] | None = None) -> Chain:
    """labels: category -> 0, 1 or None per text, in the order of the chain."""
    cache = _Parts()
    rows = [features_of(t, cache) for t in texts]
    fold = np.array(fold_of if fold_of is not None else [i % folds for i in range(len(rows))])
    earlier, out = np.zeros((len(rows), 0)), Chain(list(labels), [], [])
    for name in labels:
        y = np.array([-1 if v is None else int(v) for v in labels[name]])
        known = np.flatnonzero(y >= 0)
        oof = np.zeros(len(rows))
        for k in range(folds):
            train = known[fold[known] != k]
            model = fit_linear([rows[i] for i in train], y[train].astype(float), earlier[train])
            for i in np.flatnonzero(fold == k):
                oof[i] = model.score(rows[i].tolist(), earlier[i])
        out.models.append(fit_linear([rows[i] for i in known], y[known].astype(float), earlier[known]))
        out.thresholds.append(_threshold(oof[known], y[known]))
        earlier = np.column_stack([earlier, oof])
    used = set().union(*(m.weight for m in out.models)) if out.models else set()
    names = {p: i for w in {w for t in texts for w in words_of(t)} for p, i in zip(parts(w), cache[w], strict=True) if i in used}
    for m in out.models:  # from places back to the features met there
        m.weight = {p: m.weight[i] for p, i in names.items() if i in m.weight}
    return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at which out-of-fold F1 is best, within 0.3 to 0.7.

    Above every probability, so that nothing is rejected, where the known labels do not hold both classes.
    """
    grid = np.linspace(0.3, 0.7, 41)
    if not len(y) or y.min() == y.max():
        return 2.0
    f1 = np.array([2 * ((p >= g) & (y == 1)).sum() / max(1, (p >= g).sum() + (y == 1).sum()) for g in grid])
    best = grid[f1 >= f1.max() - 1e-12]
    return float(best[np.argmin(np.abs(best - 0.5))])


class _Weights(dict):
    """Word -> its features that carry weight in some model: most words have none."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.useful = set().union(*(m.weight for m in chain.models)) if chain.models else set()
        self.heads = {p.rstrip("$")[:3] for p in self.useful}

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        useful = self.useful
        out = self[word] = tuple(p for p in parts(word) if p in useful) if word[:3] in self.heads else ()
        return out


def chain_scores(text: str | None, chain: Chain, weights: _Weights) -> list[float]:
    features = {p for w in words_of(text) for p in weights[w]}
    out: list[float] = []
    for m in chain.models:
        out.append(m.score(features, np.array(out)))
    return out


def train(
    docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 6_000, max_chars: int = 16_000_000, max_text: int = 21_000, folds: int = 5, text: str = "text", doc_id: str = "doc_id"
) -> Chain:
    """Fit on at most ``max_rows`` labelled rows and ``max_chars`` of text, by least hash of the id, no text longer than ``max_text``.

    These three bounds are the only sampling; they hold what comes to the driver, whatever the size of the tables, and nothing
    else: scores are given to all rows and whole texts.  Of documents that share a labelled id, the one with the least digest is
    the training row; of labels that share an id, all are.  A category without labels of both classes among these rows, an empty
    table of labels for one, rejects no document.
    """
    ys_of = [f"y{i}" for i in range(len(categories))]
    known = labels.select(F.col(doc_id).alias("id"), *[F.col(c).cast("int").alias(y) for c, y in zip(categories, ys_of, strict=True)])
    known = known.filter("id is not null").orderBy(F.xxhash64("id"), *known.columns).limit(max_rows).select("*", F.monotonically_increasing_id().alias("label"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.coalesce(F.length(text), F.lit(0)).alias("n")).filter(F.col("n") <= max_text)
    # One row a label, chosen before anything comes to the driver, and of these as many as the bound of characters lets in.
    one = rows.join(F.broadcast(known), "id").groupBy("label", "id", *ys_of).agg(F.min(F.struct(F.md5("t").alias("digest"), "t", "n")).alias("least"))
    order = Window.orderBy(F.xxhash64("id", F.lit(1)), "id", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # max_rows rows at most
    one = one.withColumn("used", F.sum("least.n").over(order)).filter(F.col("used") <= max_chars)
    got = one.select("id", F.col("least.t").alias("t"), *ys_of).collect()
    got.sort(key=lambda r: (uuid.uuid5(uuid.NAMESPACE_OID, str(r["id"])).int, *[-1 if r[y] is None else r[y] for y in ys_of]))
    ys = {c: [r[y] for r in got] for c, y in zip(categories, ys_of, strict=True)}
    return fit_chain([r["t"] for r in got], ys, folds, [uuid.uuid5(uuid.NAMESPACE_URL, str(r["id"])).int % folds for r in got])


def score(docs: DataFrame, chain: Chain, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, p_<category>..., <last category> flag as ``rejected``): every row of docs, whole texts."""
    names = [f"p_{c}" for c in chain.categories]
    bound = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bound.value
        weights = _Weights(c)
        for b in batches:
            p = np.array([chain_scores(t.as_py(), c, weights) for t in b.column(1)]).reshape(b.num_rows, len(names))
            flag = p[:, -1] >= c.thresholds[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in p.T), pa.array(flag)], ["doc_id", *names, "rejected"])

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, {', '.join(f'{n} double' for n in names)}, rejected boolean"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs without the rows that the chain rejects; columns and order of columns stay, nothing is shuffled."""
    at = docs.columns.index(text)
    bound = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bound.value
        weights = _Weights(c)
        for b in batches:
            keep = [chain_scores(t.as_py(), c, weights)[-1] < c.thresholds[-1] for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
