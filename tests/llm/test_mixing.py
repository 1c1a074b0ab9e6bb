import random
import re
from collections import Counter, defaultdict

import pytest

from leafmill.llm import mixing as M


def targets(size, weights, share, bound):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got = {s: 0.0 for s in size}
    left, free = share * sum(size.values()), set(size)
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        for s in list(free):
            got[s] += left * w[s] / total
        left = 0.0
        for s in list(free):
            if got[s] >= bound * size[s]:
                left += got[s] - bound * size[s]
                got[s] = bound * size[s]
                free.discard(s)
    return got


def made(n, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(int(r.lognormvariate(3, 1)))), r.choice(["hot"] * 6 + ["a", "b", "Ä", "", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, " \t", "a"), (None, "one two", "b"), (None, "one two", "b"), (7, rows[7][1], rows[7][2]), (n + 2, None, "empty"), (n + 3, "x " * 50000, "hot")]


@pytest.mark.parametrize("block", [5])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = made(1500, 1)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int")
    got = M.mix(docs.repartition(7)).collect()
    assert Counter((x.doc_id, x.source, x.size) for x in got) == Counter((i, s, len(re.findall(M.WORD, t or ""))) for i, t, s in rows)
    size, taken, largest = Counter(), Counter(), defaultdict(int)
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
        assert x.taken == x.copies * x.size <= 2 * x.size
    want = targets(size, [3, 1, 2], 1.5, 2.0)
    for x in got:
        assert x.source_size == size[x.source] and abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * min(largest[s], 50000) + 0.02 * want[s]
    again = M.mix(docs.repartition(3)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_every_document_keeps_its_chance(spark):
    """The pairing itself, over many draws at once: each unit's share of copies is its fraction."""
    from pyspark.sql import functions as F

    units = F.array(*[F.struct(F.lit(k).cast("long").alias("size"), (F.col("id") * 7 + k).alias("tie"), F.lit(k).cast("long").alias("doc_id"), F.lit(p).alias("p")) for k, p in enumerate([0.2, 0.5, 0.3, 0.75, 0.75, 0.5])])
    played = spark.range(4000).select(M._play(units, "bigint", 5).alias("o"))
    done = played.select(F.explode("o.done").alias("u")).groupBy("u.doc_id").agg(F.sum("u.copy").alias("n"))
    left = {r.doc_id: r.n for r in played.select("o.left.*").groupBy("doc_id").agg(F.sum("p").alias("n")).collect()}
    for r in done.collect():
        assert abs((r.n + left.get(r.doc_id, 0)) / 4000 - [0.2, 0.5, 0.3, 0.75, 0.75, 0.5][r.doc_id]) < 0.03


def test_empty_and_taken(spark):
    docs = spark.createDataFrame(made(300, 2), "doc_id long, text string, source string")
    assert M.mix(docs.limit(0)).count() == 0
    want = Counter()
    for x in M.mix(docs).collect():
        want[x.doc_id, x.source] += x.copies
    got = Counter((x.doc_id, x.source) for x in M.taken_documents(docs).collect())
    assert got == +want
    assert M.taken_documents(docs.limit(0)).columns == docs.columns


def _replay(units, seed):
    """The pairing of a block in plain Python: what is settled, and what is left open; draws come from the given function."""
    left, done = None, []
    for u in units:
        if left is None:
            left = u
            continue
        total = left["p"] + u["p"]
        low = total < 1
        chance = left["p"] / max(total, 1e-300) if low else (1 - u["p"]) / max(2 - total, 1e-300)
        hit = seed(left, u) < chance
        carries, settles = (left, u) if hit == low else (u, left)
        done.append((settles["doc_id"], 0 if low else 1))
        left = {**carries, "p": total if low else total - 1}
    return left, done


def test_pairing_against_a_replay(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    units = [{"size": r.randint(0, 9), "tie": r.getrandbits(60), "doc_id": k, "p": r.choice([0.0, 0.25, r.random(), 0.75])} for k in range(40)]
    pairs = [(a["doc_id"], a["tie"], b["doc_id"], b["tie"], a["size"], b["size"]) for a in units for b in units]
    table = spark.createDataFrame(pairs, "a long, s long, b long, t long, c long, d long")
    draws = {(x.a, x.b): x.u for x in table.select("a", "b", M._uniform(5, *[F.col(c) for c in "asbtcd"]).alias("u")).collect()}
    kind = "array<struct<size:bigint,tie:bigint,doc_id:bigint,p:double>>"
    one = spark.createDataFrame([([tuple(u[k] for k in ("size", "tie", "doc_id", "p")) for u in units],)], f"units {kind}")
    got = one.select(M._play(F.col("units"), "bigint", 5).alias("o")).first().o
    left, done = _replay(units, lambda a, b: draws[a["doc_id"], b["doc_id"]])
    assert [(x.doc_id, x.copy) for x in got.done] == done and got.left.doc_id == left["doc_id"] and abs(got.left.p - left["p"]) < 1e-12


def test_equal_rows_are_one_player(spark, monkeypatch):
    """Thousands of equal rows, with an id or without, fill no block, and take the copies that their number is worth."""
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr(M, "CHUNK", 100)
    rows = [(1, "a b c", "s")] * 1000 + [(None, "d e", "s")] * 500 + [(k, "x y z", "t") for k in range(50)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, row_copies int, _size int").repartition(3)
    assert M.sizes(docs).count() == 52
    got = Counter((x.doc_id, x.source, x.copies) for x in M.mix(docs).collect())
    assert sum(got.values()) == len(rows)
    for key, n in (((1, "s"), 1000), ((None, "s"), 500)):
        rate = (1.5 * 4150 - 2 * 150) / 4000  # the small source is held at twice its size
        want = min(2.0, rate) * n
        assert abs(sum(k[2] * v for k, v in got.items() if k[:2] == key) - want) <= 1
    taken = M.taken_documents(docs)
    assert taken.columns == docs.columns
    copies = Counter((x.doc_id, x.source) for x in taken.collect())
    want = Counter()
    for k, v in got.items():
        want[k[:2]] += k[2] * v
    assert copies == +want
