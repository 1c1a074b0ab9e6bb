"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import spelling as S


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words_of(rows, every=97):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows, every=97):
    vocab = words_of(rows, every)
    best, count = {}, {}
    for w in vocab:
        others = [v for v in vocab if near(w, v)]
        count[w] = len(others)
        top = min(others, key=lambda v: (-vocab[v], v), default=None)
        best[w] = top if top is not None and vocab[top] >= 2 * vocab[w] else None
    out = []
    for w, n in vocab.items():
        end = w
        while best[end] is not None:
            end = best[end]
        out.append((w, best[w], end, n, count[w], vocab[best[w]] if best[w] else None))
    return sorted(map(repr, out))


def made(seed, letters="abÀé", n=400):
    r = random.Random(seed)
    stem = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randint(0, 30)):
            w = r.choice(stem[: r.randint(1, 40)])
            k = r.randrange(len(w))
            w = r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])
            out.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "1", "\n", "ſ"]).join(out)))
    return rows


@pytest.mark.parametrize("seed,every", [(1, 97), (2, 3), (3, 10**9)])
def test_against_all_pairs(spark, seed, every):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.variants(docs, every=every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(repr(tuple(x)) for x in got.collect()) == brute(rows, every)


def test_long_words_go_as_digests_and_give_the_same(spark, monkeypatch):
    r = random.Random(9)
    long = "".join(r.choice("xyz") for _ in range(300))
    texts = [long] * 9 + [long[:100] + "é" + long[101:]] * 4 + [long[:-1]] * 3 + [long + "a"] * 3 + ["q" * 70] * 3 + ["q" * 71] * 7
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, ""), (4, "ab 12 ..."), (5, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(repr(tuple(x)) for x in S.variants(docs).collect()) == want and len(want) == 6
    monkeypatch.setattr(S, "LONG", 3)
    rows = made(4)
    assert sorted(repr(tuple(x)) for x in S.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_chains_ties_and_repeats(spark):
    """Each word of a chain is twice as frequent as the one before; equal counts go by code points."""
    chain = ["abcdefgh", "bbcdefgh", "bccdefgh", "bcddefgh", "bcdeefgh", "bcdeffgh"]
    texts = [w for k, w in enumerate(chain) for _ in range(3 * 2**k)] + ["mmmmm"] * 3 + ["mmmmz"] * 6 + ["mmmma"] * 6 + ["mmmé" + "m"] * 6
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = {x.word: x for x in S.variants(docs, every=10**9).collect()}
    assert got["abcdefgh"].root == "bcdeffgh" and got["abcdefgh"].form == "bbcdefgh"
    assert got["mmmmm"].form == "mmmma" and got["mmmmm"].n_near == 3 and got["mmmmz"].form is None
    assert sorted(repr(tuple(x)) for x in got.values()) == brute([(1, t) for t in texts], 10**9)


def test_empty_table_null_ids_and_clashing_names(spark):
    rows = [(None, "abcde abcdf abcde abcde abcdf abcdf abcde abcde abcde")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.withColumns({"word": F.lit(1), "n": F.lit(2), "id": F.lit(3), "run": F.lit(4), "h": F.lit(5)})
    assert S.variants(docs.limit(0)).count() == 0
    assert sorted(repr(tuple(x)) for x in S.variants(odd).collect()) == brute(rows)
