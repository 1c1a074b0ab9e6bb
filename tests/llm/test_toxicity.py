import random

import numpy as np

from leafmill.llm import toxicity as T


def made(n, seed):
    r = random.Random(seed)
    texts, sad, bad = [], [], []
    for _ in range(n):
        w = ["".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(r.randint(5, 60))]
        s, b = r.random() < 0.4, r.random() < 0.3
        for flag, stem in ((s, "grimm"), (b, "zonk")):
            if flag:
                w += [stem + r.choice(["ex", "il", "ort"]) for _ in range(3)]
        r.shuffle(w)
        texts.append(" ".join(w))
        sad.append(int(s))
        bad.append(int(b))
    return texts, {"sad": sad, "bad": bad}


def test_held_out_accuracy():
    texts, labels = made(900, 1)
    chain = T.fit_chain(texts, labels)
    other, truth = made(300, 2)
    w = T._Weights(chain)
    p = np.array([T.chain_scores(t, chain, w) for t in other])
    for k, name in enumerate(labels):
        assert np.mean((p[:, k] >= chain.thresholds[k]) == np.array(truth[name])) > 0.98
    assert len(chain.models[1].chained) == 1 and len(chain.models[0].chained) == 0


def test_later_category_uses_the_earlier_one():
    texts, labels = made(900, 3)
    labels["copy"] = labels.pop("sad"), labels.pop("bad")
    labels = {"first": labels["copy"][0], "second": labels["copy"][0]}
    chain = T.fit_chain(texts, labels)
    assert chain.models[1].chained[0] > 0.5


def test_one_class_and_nothing():
    for texts, y in ((["a b", "c"], [0, 0]), ([], []), ([None, ""], [1, 1]), (["a"], [None])):
        chain = T.fit_chain(texts, {"t": y})
        p = T.chain_scores("a b c", chain, T._Weights(chain))[0]
        assert 0 < p < 1 and (p <= 0.5) == (1 not in y)


def test_tables(spark):
    texts, labels = made(400, 5)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, "", 1), (None, "zonkex zonkil zonkort", 1), (1002, "ab " * 30000 + "zonkex zonkil zonkort", 1), (0, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rejected int")
    lab = spark.createDataFrame([(i, labels["sad"][i], labels["bad"][i]) for i in range(400)] + [(None, 1, 1), (5000, 0, 1), (7, None, None)], "doc_id long, sad int, bad int")
    chain = T.train(docs, lab, ["sad", "bad"])
    got = {}
    scored = T.score(docs, chain).collect()
    for r in scored:
        got[r.doc_id] = r.rejected
    assert len(scored) == len(rows) and got[None] and got[1002] and not got[1000] and not got[1001]
    assert sum(got[i] == bool(labels["bad"][i]) for i in range(400)) > 395
    kept = T.drop_toxic(docs, chain)
    assert kept.schema == docs.schema
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in scored if not r.rejected)
    assert T.drop_toxic(docs.limit(0), chain).count() == 0
    assert T.train(docs.limit(0), lab, ["sad", "bad"]).categories == ["sad", "bad"]
    assert len(T.train(docs, lab, ["sad", "bad"], max_rows=50).models) == 2


def test_without_both_classes_nothing_is_dropped(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "zonk " * 9000), (3, None)], "doc_id long, text string")
    for rows in ([], [(1, 0, None)], [(2, 1, 1)], [(1, 1, 1), (3, 1, 1)], [(1, 0, 0)]):
        chain = T.train(docs, spark.createDataFrame(rows, "doc_id long, sad int, bad int"), ["sad", "bad"])
        assert T.drop_toxic(docs, chain).count() == 3
        assert not any(r.rejected for r in T.score(docs, chain).collect())


def test_a_repeated_label_or_document_brings_one_row(spark, monkeypatch):
    texts, labels = made(60, 8)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, f"other {i}") for i in range(500)] + [(1, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, labels["sad"][i], labels["bad"][i]) for i in range(60)] + [(3, 1, 0)], "doc_id long, sad int, bad int")
    seen = []
    monkeypatch.setattr(T, "fit_chain", lambda t, y, *a: seen.append((t, y)))
    T.train(docs, lab, ["sad", "bad"])
    T.train(docs.repartition(5), lab.repartition(3), ["sad", "bad"])
    assert len(seen[0][0]) == 61 and seen[0] == seen[1] and max(map(len, seen[0][0])) < 21_000
    T.train(docs, lab, ["sad", "bad"], max_chars=1000)
    assert 0 < sum(map(len, seen[2][0])) <= 1000


def test_fit_against_newton():
    """The accelerated steps reach the minimum that Newton's method finds on the dense design."""
    r = np.random.default_rng(6)
    n, y = 300, r.integers(0, 2, 300).astype(float)
    rows = [np.unique(np.concatenate(([t for t in range(8) if r.random() < (0.7 if y[i] and t < 4 else 0.25)], [9])).astype(np.int32)) for i in range(n)]
    earlier = r.random((n, 1)) * 0.5 + 0.3 * y[:, None]
    got = T.fit_linear(rows, y, earlier, ridge=1.0, least=1, z=1.0, steps=5000)
    names = sorted(got.weight)
    x = np.column_stack([[[1.0 if f in set(row.tolist()) else 0.0 for f in names] for row in rows], earlier, np.ones(n)])
    ridge = np.diag([1.0] * (len(names) + 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    mine = np.array([got.weight[f] for f in names] + [got.chained[0], got.constant])
    assert len(names) >= 4 and np.abs(mine - w).max() < 1e-3
