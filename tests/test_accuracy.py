"""Scores without SQL twins against plain versions, and quantiles and ranks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import accuracy, ranks
from tests.test_operators import _brute


def test_word_accuracy(spark):
    rows = [(1, "a b c", "A x c d"), (1, None, "one two"), (1, "", "z"), (2, "same words", "same words"), (2, "x", None), (2, "x", " ")]
    df = spark.createDataFrame(rows, "k int, got string, truth string")
    got = {r.k: r for r in accuracy.word_accuracy(df, ["k"]).collect()}
    assert _brute("abc", "axcd") == 2
    assert got[1].n_pages == 3 and got[1].mean_acc == pytest.approx((0.5 + 0 + 0) / 3) and got[1].pooled_acc == pytest.approx(1 - 5 / 7)
    assert got[2].n_pages == 1 and got[2].mean_acc == 1
    c = {r.k: r.mean_acc for r in accuracy.char_accuracy(df.filter("k = 2 and truth = 'same words'"), ["k"]).collect()}
    assert c == {2: 1.0}


def test_paired_bootstrap_by_its_moments(spark):
    r = np.random.default_rng(1)
    d = r.normal(0.3, 2.0, 300)
    df = spark.createDataFrame([(k, 1.0, 1.0 + float(x)) for k, x in enumerate(d)] + [(999, None, 1.0)], "page int, a double, b double")
    b = accuracy.paired_bootstrap(df, "a", "b", "page", draws=400, seed=3).first()
    half = 1.96 * d.std() / 300**0.5
    assert b.n == 300 and b.mean == pytest.approx(d.mean())
    assert b.low == pytest.approx(d.mean() - half, abs=half / 3) and b.high == pytest.approx(d.mean() + half, abs=half / 3)
    assert tuple(accuracy.paired_bootstrap(df.repartition(5), "a", "b", "page", draws=400, seed=3).first()) == pytest.approx(tuple(b))


def test_quantiles_and_ranks(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(r.integers(0, 3, 3000), np.round(r.normal(size=3000), 2), strict=True)] + [(3, 1.0), (3, 4.0), (4, 7.0), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {x.k: x.quantile for x in ranks.exact_quantile(df, ["k"], "v", q).collect()}
        want = {k: float(np.quantile([v for a, v in rows if a == k], q)) for k in range(5)}
        assert got == pytest.approx(want)
    assert ranks.exact_quantile(df, [], "v", 0.5).first()[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    scored = [(k, v, int(r.random() < 1 / (1 + np.exp(-v)))) for k, v in rows[:3000]]
    auc = {x.k: x.auc for x in ranks.rank_auc(spark.createDataFrame(scored, "k int, v double, y int"), ["k"], "v", "y").collect()}
    for k in range(3):
        pos, neg = (np.array([v for a, v, y in scored if a == k and y == z]) for z in (1, 0))
        assert auc[k] == pytest.approx(((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2))
    top = ranks.top_ranked(spark.range(500).withColumn("g", F.col("id") % 2), ["g"], [F.desc("id")], 5, ["id"])
    assert [(x.g, x.id, x["rank"]) for x in top.orderBy("g", "rank").collect()] == [(g, 499 - (1 - g) - 2 * k, k + 1) for g in (0, 1) for k in range(5)]
