import random
from collections import defaultdict

import pytest

import __spark_entry__  # noqa: F401
from leafmill.queries import catalog


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """Pairs that differ behind their 60th character, in letters beyond ASCII, and wholly."""
    r = random.Random(2)
    rows = []
    for c in range(6):
        base = "".join(r.choice("abcé ü漢😀") for _ in range(150))
        for t in range(4):
            rows.append((c, t, "user", base[: 70 + 20 * t] + "".join(r.choice("xyñ") for _ in range(t * c))))
    rows += [(7, 0, "user", ""), (7, 1, "user", "né"), (7, 2, "user", ""), (8, 0, "user", None), (8, 1, "user", "x"), (9, 0, "user", "alone")]
    at = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    pairs = [(c, t, a, b) for (c, t, _, a), (d, _, _, b) in zip(rows, rows[1:], strict=False) if c == d and a is not None and b is not None]
    return at, pairs


def test_steps_of_whole_turns(spark, turns):
    at, pairs = turns
    got = {(r.conv_id, r.turn, r.cost) for r in catalog.QUERIES["edit_steps"](spark, at).collect()}
    assert got == {(c, t, distance(a, b)) for c, t, a, b in pairs}


def test_accuracy_of_whole_turns(spark, turns):
    at, pairs = turns
    by = defaultdict(list)
    for c, _, a, b in pairs:
        if b:
            by[c].append((distance(a, b), len(b)))
    want = {c: (sum(1 - d / n for d, n in v) / len(v), 1 - sum(d for d, _ in v) / sum(n for _, n in v), len(v)) for c, v in by.items()}
    got = {r.conv_id: (r.mean_acc, r.pooled_acc, r.n) for r in catalog.QUERIES["edit_accuracy"](spark, at).collect()}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], abs=2e-6) for c in want)
