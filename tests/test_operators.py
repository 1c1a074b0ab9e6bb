import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import cuts, sequences, tabletrees
from leafmill.plans import profile, runner, stages


def _brute(got, truth):
    d = list(range(len(truth) + 1))
    for i, a in enumerate(got, 1):
        e = [i]
        for j, b in enumerate(truth, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (a != b)))
        d = e
    return d[-1]


def test_edit_script_is_least_and_replays():
    rng = np.random.default_rng(1)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("same", "same")] + [("".join(rng.choice(list("abc"), rng.integers(0, 9))), "".join(rng.choice(list("abc"), rng.integers(0, 9)))) for _ in range(200)]
    for got, truth in pairs:
        s = sequences.edit_script(got, truth)
        assert sum(c != "=" for c in s) == _brute(got, truth)
        g, t = iter(got), iter(truth)
        for c in s:
            a, b = next(g) if c != "-" else None, next(t) if c != "+" else None
            assert (a == b) == (c == "=")
        assert next(g, None) is None and next(t, None) is None


def test_alignment_places(spark):
    pairs = spark.createDataFrame([(1, "cat", "cart"), (2, None, "x"), (3, "", "")], "k int, got string, truth string")
    rows = [tuple(r) for r in sequences.alignment(pairs, "k").orderBy("k", "step").collect()]
    assert rows == [(1, 0, "=", 0, 0), (1, 1, "=", 1, 1), (1, 2, "-", 2, 2), (1, 3, "=", 2, 3)]


def _paths(logp):
    mass = {}
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        labels = tuple(c for c, _ in itertools.groupby(path) if c)
        mass[labels] = mass.get(labels, 0.0) + math.exp(sum(logp[i, c] for i, c in enumerate(path)))
    return mass


def test_ctc_equals_sum_over_paths(spark):
    rng = np.random.default_rng(2)
    for _ in range(20):
        p = rng.random((4, 3)) + 0.05
        logp = np.log(p / p.sum(1, keepdims=True))
        mass = _paths(logp)
        for labels, m in mass.items():
            assert sequences.ctc_cost(logp, list(labels)) == pytest.approx(-math.log(m))
        assert sequences.ctc_cost(logp, [1, 1, 1, 1]) == math.inf
        best, score = sequences.prefix_beam(logp, 100)
        assert tuple(best) == max(mass, key=mass.get) and score == pytest.approx(math.log(max(mass.values())))
    df = spark.createDataFrame([(logp.tolist(), [1]), (None, [1]), ([], [])], "p array<array<double>>, y array<int>")
    rows = df.select(sequences.ctc_costs("p", "y").alias("c"), sequences.beam_labels(F.col("p"), 100).alias("b")).collect()
    assert rows[0].c == pytest.approx(-math.log(mass[(1,)])) and rows[0].b == best and rows[1].b is None and rows[2].c == 0 and rows[2].b == []


def test_reading_order_by_columns_and_rows(spark):
    boxes = [(1, 1, 0, 0, 10, 10), (1, 2, 20, 0, 30, 10), (1, 3, 0, 15, 10, 25), (1, 4, 20, 15, 30, 25), (2, 1, 0, 0, 5, 5), (2, 2, None, 0, 1, 1)]
    df = spark.createDataFrame(boxes, "page int, item int, x0 int, y0 int, x1 int, y1 int")
    by = lambda prefer: [(r.page, r.item) for r in cuts.reading_order(df, "page", "item", prefer).orderBy("page", "place").collect()]
    assert by("v") == [(1, 1), (1, 3), (1, 2), (1, 4), (2, 1)]
    assert by("h") == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    assert cuts.cut_order([]) == [] and cuts.cut_order([(0, 5, 9, 9), (1, 0, 8, 6)]) == [1, 0]


def test_detection(spark):
    kind = "page int, id int, box struct<x0:double,y0:double,x1:double,y1:double>"
    found = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0)), (1, 2, (0.0, 0.0, 10.0, 9.0)), (2, 3, (0.0, 0.0, 1.0, 1.0))], kind)
    truth = spark.createDataFrame([(1, 7, (0.0, 0.0, 10.0, 10.0)), (1, 8, (50.0, 0.0, 60.0, 9.0))], kind)
    r = cuts.detection_scores(found, truth, "page").first()
    assert (r.n_found, r.n_truth, r.n_matched) == (3, 2, 1) and r.f1 == pytest.approx(0.4)
    assert cuts.detection_scores(found.limit(0), truth.limit(0), "page").first().f1 == 0


def test_table_likeness(spark):
    t = "<table><tr><td>a</td><td>bc</td></tr><tr><td colspan='2'>d</td></tr></table>"
    assert tabletrees.table_likeness(t, t) == 1
    assert tabletrees.table_likeness(t.replace("bc", "bx"), t) == pytest.approx(1 - 0.5 / 6)
    assert tabletrees.table_likeness(t.replace("bc", "bx"), t, structure_only=True) == 1
    assert tabletrees.table_likeness(t.replace("<td>bc</td>", ""), t) == pytest.approx(1 - 1 / 6)
    assert tabletrees.table_likeness(t.replace(" colspan='2'", ""), t) == pytest.approx(1 - 1 / 6)
    assert tabletrees.table_likeness("no table", t) == pytest.approx(1 - 5 / 6)
    df = spark.createDataFrame([(t, t), (None, t)], "g string, t string")
    assert [r[0] for r in df.select(tabletrees.likeness(F.col("g"), F.col("t"))).collect()] == [1.0, None]


def _mappings(a, b, structure_only=False):
    """Least cost over all pairings of nodes that keep ancestors and left to right, tried one by one."""
    def related(t):
        order, first = tabletrees._post_order(t.depths)
        return order, [[("up" if first[j] <= i < j else "left" if i < first[j] else "down" if first[i] <= j < i else "right") for j in range(len(order))] for i in range(len(order))]

    (oa, ra), (ob, rb) = related(a), related(b)
    change = tabletrees._changes(a, b, oa, ob, structure_only)
    best = [float(len(oa) + len(ob))]

    def grow(i, pairs, cost):
        if i == len(oa):
            best[0] = min(best[0], cost + (len(oa) - len(pairs)) + (len(ob) - len(pairs)))
            return
        grow(i + 1, pairs, cost)
        for j in range(len(ob)):
            if all(j != y and ra[i][x] == rb[j][y] for x, y in pairs):
                grow(i + 1, [*pairs, (i, j)], cost + change[i, j])

    grow(0, [], 0.0)
    return best[0]


def test_tree_distance_against_all_pairings():
    rng = np.random.default_rng(5)

    def tree():
        t, depth = tabletrees.Tree(), 0
        t.add(("table", "1", "1"), 0)
        for _ in range(rng.integers(0, 5)):
            depth = int(rng.integers(1, depth + 2))
            t.add((str(rng.choice(["tr", "td"])), "1", str(rng.integers(1, 3))), depth, str(rng.choice(["a", "ab", "xyz"])))
        return t

    for _ in range(150):
        a, b = tree(), tree()
        for only in (False, True):
            assert tabletrees.tree_distance(a, b, only) == pytest.approx(_mappings(a, b, only))


def test_edit_cost_of_lists():
    assert sequences.edit_cost([], []) == 0 and sequences.edit_cost(["a"], []) == 1 and sequences.edit_cost([], ["a", "b"]) == 2
    assert sequences.edit_cost(["aa", "b", "cc"], ["aa", "x", "b", "dd"]) == 2


TOML = '[pipeline]\nstages = ["keep", "mark"]\n[stage.keep]\nimpl = "least"\nparams = {least = 2}\n[stage.mark]\nimpl = "with"\n'


@stages.stage("keep", "least", least=0)
def _keep(df, least):
    return df.filter(F.col("id") >= least)


@stages.stage("mark", "with", text="x")
def _mark(df, text):
    return df.withColumn("mark", F.lit(text))


def test_profile_and_runner(spark, tmp_path):
    steps = profile.parse(TOML, ["keep.least=3", "mark.text=on the way"])
    df = spark.range(5)
    assert [tuple(r) for r in runner.run(df, steps).orderBy("id").collect()] == [(3, "on the way"), (4, "on the way")]
    out, manifest = runner.run_kept(df, profile.parse(TOML), f"file://{tmp_path}")
    assert out.count() == 3 and [(r.slot, r.n_rows) for r in manifest.orderBy("step").collect()] == [("keep", 3), ("mark", 3)]
    again, m = runner.rerun_from(1, profile.parse(TOML, ["mark.text=z"]), f"file://{tmp_path}", df)
    assert {r.mark for r in again.collect()} == {"z"} and m.count() == 1
    assert {(r.slot, r.impl) for r in stages.listing(spark).collect()} >= {("keep", "least"), ("mark", "with")}


def test_profile_errors(spark):
    with pytest.raises(ValueError, match="no implementation"):
        profile.parse('[pipeline]\nstages = ["other"]\n')
    with pytest.raises(ValueError, match="SLOT.KEY=VALUE"):
        profile.parse(TOML, ["keep"])
    with pytest.raises(ValueError, match="no parameter"):
        runner.run(spark.range(1), profile.parse(TOML, ["keep.most=3"]))
    with pytest.raises(KeyError, match="keep has least"):
        runner.run(spark.range(1), profile.parse(TOML, ["keep.impl=none"]))
    with pytest.raises(ValueError, match="twice"):
        stages.stage("keep", "least")(_keep)
