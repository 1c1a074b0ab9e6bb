"""Pixel operators and fitted models against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import blocks, decoding, grids, learning, pixels, tables, wordtables


def plain_components(ink, steps):
    label = np.zeros(ink.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(ink), strict=True):
        if label[y, x]:
            continue
        n += 1
        open_ = [(y, x)]
        label[y, x] = n
        while open_:
            a, b = open_.pop()
            for dy, dx in steps:
                u, v = a + dy, b + dx
                if 0 <= u < ink.shape[0] and 0 <= v < ink.shape[1] and ink[u, v] and not label[u, v]:
                    label[u, v] = n
                    open_.append((u, v))
    return n, label


EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def test_components_against_flood_fill():
    r = np.random.default_rng(0)
    for share in (0.1, 0.4, 0.55, 0.7):
        for _ in range(15):
            ink = r.random((r.integers(1, 30), r.integers(1, 30))) < share
            n, label = plain_components(ink, EIGHT)
            of, c = pixels.components(ink)
            assert len(c["area"]) == n and sorted(c["area"]) == sorted(np.bincount(label.ravel())[1:])
            row, start, stop = pixels.runs_of(ink)
            mine = np.zeros(ink.shape, int)
            for k, (a, b, e) in enumerate(zip(row, start, stop, strict=True)):
                mine[a, b:e] = of[k] + 1
            assert len({(a, b) for a, b in zip(mine[ink], label[ink], strict=True)}) == n
            outside, _ = plain_components(~np.pad(ink, 1), FOUR)
            assert pixels.hole_count(ink) == outside - 1
    assert len(pixels.components(np.zeros((3, 3), bool))[1]["area"]) == 0


def test_thresholds_and_filters():
    r = np.random.default_rng(1)
    g = r.random((20, 23))
    p = np.pad(g, 3, mode="edge")
    want = np.array([[p[y : y + 7, x : x + 7].mean() for x in range(23)] for y in range(20)])
    assert np.allclose(pixels.box_mean(g, 7), want)
    med = np.array([[np.median(p[y : y + 7, x : x + 7]) for x in range(23)] for y in range(20)])
    assert np.allclose(pixels.median_filter(g, 7), med)
    m, s = want, np.array([[p[y : y + 7, x : x + 7].std() for x in range(23)] for y in range(20)])
    assert np.allclose(pixels.sauvola(g, 6, 0.3, 0.5), m * (1 + 0.3 * (s / 0.5 - 1)))
    two = np.where(r.random((40, 40)) < 0.3, r.normal(0.2, 0.03, (40, 40)), r.normal(0.8, 0.03, (40, 40)))
    assert 0.3 < pixels.otsu(two) < 0.7
    flat = pixels.flattened(np.linspace(1, 0.5, 160)[None, :] * np.ones((90, 1)))
    assert flat.min() > 0.9
    assert pixels.resized(g, 1.0) == pytest.approx(g) and pixels.resized(g, 2).shape == (40, 46)


def test_skew_turns_and_rules():
    text = "word " * 200
    ink = np.pad(pixels.block_page(text), 60)
    for angle in (-3.0, 0.0, 1.5):
        page = pixels.turned(np.where(ink, 0.0, 1.0), angle) < 0.5
        assert abs(pixels.skew_by_projection(page) + angle) < 0.2 or abs(pixels.skew_by_projection(page) - angle) < 0.2
        assert abs(abs(pixels.skew_by_votes(pixels.components(page)[1])) - abs(angle)) <= 0.5
    assert pixels.best_turn({0: (2, 50), 1: (30, 50), 3: (1, 50)}) == 1 and pixels.best_turn({0: (20, 50), 2: (25, 50)}) == 0 and pixels.best_turn({}) == 0
    a = np.zeros((50, 300), bool)
    a[10:12, 5:250] = True
    a[30, 5:250] = True
    a[30, 50:54] = False
    a[0:50, 280:282] = True
    assert [(r[0], r[1], r[2], r[4]) for r in pixels.rulings(a, least=40)] == [(5, 10, 250, True), (5, 30, 250, True), (280, 0, 282, False)]


def test_skeletons_features_and_strips():
    ring = np.ones((9, 9), bool)
    ring[3:6, 3:6] = False
    assert pixels.skeleton_graph(ring)["loops"] == 1 and pixels.hole_count(np.ones((4, 4), bool)) == 0
    cross = np.zeros((21, 21), bool)
    cross[9:12], cross[:, 9:12] = True, True
    g = pixels.skeleton_graph(cross)
    assert g["ends"] == 4 and g["junctions"] == 1 and g["strokes"] == 4 and g["loops"] == 0
    bar = np.zeros((30, 8), bool)
    bar[2:28, 3:5] = True
    assert pixels.skeleton_graph(bar)["ends"] == 2
    lean = np.zeros((30, 40), bool)
    for y in range(30):
        lean[y, 5 + y // 2 : 8 + y // 2] = True
    assert np.ptp(np.nonzero(pixels.deslanted(lean))[1]) < np.ptp(np.nonzero(lean)[1]) / 2
    f = pixels.glyph_features(cross)
    assert len(f) == len(pixels.glyph_features(np.zeros((5, 5), bool))) and np.allclose(pixels.glyph_features(np.pad(cross, 4)), f)
    line = np.ones((60, 80))
    line[20:40] = 0.0
    s = pixels.line_strip(line, x_height=20, baseline=40)
    assert s.shape[0] == 32 and s[10:21].max() < 0.1 and s[24:].min() > 0.9
    d = pixels.degraded(line, 1.0, 0.3, 1, 0.2, 7)
    assert np.array_equal(d, pixels.degraded(line, 1.0, 0.3, 1, 0.2, 7)) and 0 <= d.min() and d.max() <= 1


def test_logistic_against_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (r.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1] + 4 * x[:, 2] - 2)))).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y int")
    m = learning.fit_logistic(df, ["a", "b", "c"], "y", ridge=1e-3)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(400)])
    w = np.zeros(4)
    pull = np.array([0.4, 0.4, 0.4, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pull), z.T @ (p - y) + pull * w)
    assert np.allclose([*m["weights"], m["constant"]], w, atol=1e-6)
    got = df.select(learning.logistic(m, ["a", "b", "c"]).alias("p"), "y")
    want = 1 / (1 + np.exp(-z @ w))
    assert np.allclose([q.p for q in got.collect()], want, atol=1e-6)
    assert learning.brier(got, "p", "y").first().brier == pytest.approx(((want - y) ** 2).mean(), abs=1e-6)
    assert learning.fit_logistic(df.filter("y = 1"), ["a"], "y")["weights"] == [0.0]


def test_assignment_and_graphs():
    r = np.random.default_rng(3)
    for n in range(1, 7):
        for _ in range(10):
            c = r.random((n, n))
            want = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert learning.assigned(c) == pytest.approx(want)
    a = [(0.0, 0.0, 1), (1.0, 0.0, 2), (1.0, 1.0, 1)]
    assert learning.graph_distance(a, a, (1, 1), ([1.0, 1.0], [1.0, 1.0])) == 0
    assert learning.graph_distance(a, a[:2]) == pytest.approx(1.05) and learning.graph_distance([], [], (1, 0)) == pytest.approx(1.2)
    for _ in range(40):  # against every way to pair some nodes and leave the others alone
        n, m = r.integers(0, 5, 2)
        one, two = ([(*r.random(2), int(r.integers(1, 4))) for _ in range(k)] for k in (n, m))
        lonely = lambda v: 0.9 + 0.15 * v[2]
        pair = lambda v, w: np.hypot(v[0] - w[0], v[1] - w[1]) + 0.35 * abs(v[2] - w[2])
        ways = [(p, q) for k in range(min(n, m) + 1) for p in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k)]
        cost = lambda p, q: sum(pair(one[i], two[j]) for i, j in zip(p, q, strict=True)) + sum(lonely(v) for i, v in enumerate(one) if i not in p) + sum(lonely(v) for j, v in enumerate(two) if j not in q)  # noqa: B023, E731
        assert learning.graph_distance(one, two, (1, 0), ([1.0], [0.5, 1.0])) == pytest.approx(min(cost(*w) for w in ways) + 1.2 + 0.25 + 0.8 * 0.5)


def test_prototypes_clusters_and_networks(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    centres, near = learning.kmeans(x, 3)
    assert len(set(near[:30])) == len(set(near[30:60])) == 1 and sorted(np.round(centres).astype(int).tolist()) == [[0, 0], [0, 5], [5, 0]]
    assert learning.quotas({"a": 100, "b": 1, "c": 25}, 9) == {"a": 5, "b": 1, "c": 3} and learning.quotas({"a": 2, "b": 1}, 9) == {"a": 2, "b": 1}
    assert len(learning.kmeans(np.zeros((5, 2)), 3)[0]) == 1
    label = learning.average_link(x, 2.0)
    assert len(set(label)) == 3 and label[0] == 0 and learning.average_link(np.zeros((0, 2)), 1.0) == []
    g = spark.createDataFrame([(1, k, [float(v) for v in x[k]], "a" if k < 28 else "b" if k < 60 else "?", 0.9) for k in range(90)], "page int, glyph int, vec array<double>, char string, conf double")
    got = {q.glyph: q for q in learning.refitted(g, 2.0).collect()}
    assert {got[k].pinned for k in range(30)} == {"a"} and {got[k].pinned for k in range(30, 60)} == {"b"} and {got[k].pinned for k in range(60, 90)} == {None}
    names = ["p"] * 30 + ["q"] * 30 + ["r"] * 30
    net = learning.Network(hidden=16, epochs=40).fit(x, names)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(90)], "id int, v array<double>")
    assert sum(q.label == names[q.id] for q in learning.classified(df, net, "id", "v").collect()) == 90
    assert np.allclose(learning.averaged([net.w, net.w])[0], net.w[0])
    protos = spark.createDataFrame([(n, [float(v) for v in p], "t" if k % 3 else "u") for k, (n, p) in enumerate(zip(names, x, strict=True))], "label string, vec array<double>, tag string")
    c = learning.condensed(protos, 4, by_tag=True).groupBy("label").count().collect()
    assert {q["count"] for q in c} == {4}


def test_word_features(spark):
    w = spark.createDataFrame([(1, 0, "House", 0.9, 0.0, 50.0, 0.0, 20.0), (1, 1, "h0use", 0.4, 60.0, 110.0, 0.0, 20.0)], "page int, word int, text string, conf double, x0 double, x1 double, y0 double, y1 double")
    lex = spark.createDataFrame([("house", -6.0)], "word string, logf double")
    rows = learning.word_features(w, lex).orderBy("word").collect()
    assert set(learning.WORD_FEATURES) <= set(rows[0].asDict()) and [r.known for r in rows] == [1, 0] and [r.mixed for r in rows] == [0, 1] and rows[0].plain == 1


def test_reading_helpers(spark):
    pages = {1: [2, 2, 3, 2, 10, 11, 2], 2: [2, 2, 3], 3: [5] * 9, 4: [0, 0, 0, 0, 1, 1], 5: [4, 5, 4, 5, 6, 7, 6]}
    bands = decoding.gap_bands(spark.createDataFrame([(k, float(g)) for k, v in pages.items() for g in v], "page int, gap double"))
    assert {b.page: (round(b.low, 6), round(b.high, 6)) for b in bands.collect()} == {1: (0.8 * 6.35, round(1.25 * 6.35, 6))}
    r = np.random.default_rng(11)
    rows = [(k, float(v)) for k in range(60) for v in r.integers(0, 9, int(r.integers(1, 12)))]
    for g in decoding.two_groups(spark.createDataFrame(rows, "page int, v double"), ["page"], "v").collect():  # against every cut
        v = np.sort([x for k, x in rows if k == g.page])
        cuts = [k for k in range(1, len(v)) if v[k] > v[k - 1]]
        error = lambda a: ((a - a.mean()) ** 2).sum()
        if not cuts:
            assert g.low is None and g.n == len(v)
        else:
            k = min(cuts, key=lambda k: (round(error(v[:k]) + error(v[k:]), 6), k))
            assert (g.low, g.high) == (pytest.approx(v[:k].mean()), pytest.approx(v[k:].mean()))
    costs = {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0, (0, 2): 1.5, (1, 3): 3.5}
    assert decoding.merge_paths(costs, 3, 2) == [(2.5, [(0, 2), (2, 3)]), (3.0, [(0, 1), (1, 2), (2, 3)])]
    known = {"the", "cat", "at", "he"}
    assert decoding.fewest_words("thecat", known) == ["the", "cat"] and decoding.fewest_words("xyz", known) is None
    line = lambda s: spark.createDataFrame([(s,)], "t string").select(decoding.join_spaced(F.col("t"), known)).first()[0]
    assert line("see t h e c a t run") == "see the cat run" and line("a b") == "a b" and line("x y z q") == "x y z q" and line(None) is None
    both = spark.createDataFrame([("5 30", "5 $30"), ("cost 30C", "cost 30°C"), ("ab", "xy"), ("runtogether ok", "run together ok"), ("abc", "ab"), (None, "x")], "b string, o string")
    assert [r[0] for r in both.select(decoding.reconciled(F.col("b"), F.col("o"))).collect()] == ["5 $30", "cost 30°C", "ab", "run together ok", "abc", None]
    words = spark.createDataFrame([("HOuSE",), ("hOuse",), ("cvs",), ("",)], "w string")
    assert [r[0] for r in words.select(decoding.coherent_case(F.col("w"))).collect()] == ["HOUSE", "house", "cvs", ""]
    g = spark.createDataFrame([(1, 0, 0, "c", -0.1), (1, 0, 0, "e", -0.2), (1, 0, 1, "a", -0.1), (1, 0, 2, "t", -0.1), (1, 0, 2, "T", 0.0), (1, 1, 0, "?", 0.0)], "page int, word int, place int, char string, logp double")
    got = {r.word: r.text for r in decoding.best_readings(g, {}, known).collect()}
    assert got == {0: "cat", 1: "?"}
    d = spark.createDataFrame([(1, "1", False), (1, "2", False), (2, "a", True), (2, "1", True), (3, "7", False)], "w int, char string, endorsed boolean")
    assert {r.w: r.digits for r in decoding.digit_mode(d, ["w"]).collect()} == {1: True, 2: False, 3: False}
    strokes = spark.createDataFrame([(1, 0, "figure", 0.0, 0.0, 10.0, 20.0), (1, 1, "stroke", 0.0, 0.0, 12.0, 3.0), (1, 2, "stroke", 0.0, 0.0, 90.0, 3.0), (1, 3, "stroke", 0.0, 0.0, 12.0, 9.0)], "page int, item int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert [r.item for r in decoding.nil_dashes(strokes).collect()] == [1]


def _w(rows):
    return [(1, k, t, float(x0), float(y), float(x1), float(y + 20)) for k, (t, x0, y, x1) in enumerate(rows)]


WORDS = "page int, word int, text string, x0 double, y0 double, x1 double, y1 double"


def test_a_table_with_spans_leaders_and_signs(spark):
    rows = [("Year", 330, 0, 380), ("Ended", 390, 0, 450), ("December", 460, 0, 560), ("2007", 300, 40, 350), ("2006", 450, 40, 500), ("2005", 600, 40, 650)]
    rows += [("Net", 0, 80, 40), ("income", 50, 80, 120), (".....", 130, 80, 250), ("$", 280, 80, 290), ("164", 320, 80, 350), ("189", 450, 80, 500), ("138", 600, 80, 650)]
    rows += [("Other", 0, 120, 60), ("6", 330, 120, 350), ("8", 480, 120, 500), ("1", 630, 120, 650)]
    got = {(r.row, r.col): (r.colspan, r.text) for r in wordtables.whitespace_table(spark.createDataFrame(_w(rows), WORDS)).collect()}
    assert got[0, 1] == (3, "Year Ended December") and got[2, 0] == (1, "Net income") and got[2, 1] == (1, "$ 164") and got[3, 3] == (1, "1") and len(got) == 12


def test_header_wraps_and_body_wraps(spark):
    rows = [("Gross", 100, 0, 150), ("Net", 300, 0, 330), ("pay", 100, 22, 130), ("pay", 300, 22, 330), ("Anna", 0, 60, 40), ("10", 110, 60, 130), ("9", 310, 60, 320)]
    rows += [("Berta", 0, 100, 50), ("20", 110, 100, 130), ("18", 310, 100, 330), ("Maria", 0, 122, 50)]
    t = wordtables.whitespace_table(spark.createDataFrame(_w(rows), WORDS), aligned=False)
    got = {(r.row, r.col): r.text for r in t.collect()}
    assert got[0, 1] == "Gross pay" and got[0, 2] == "Net pay" and got[2, 0] == "Berta Maria" and got[1, 0] == "Anna"
    assert wordtables.header_span(0, 10, [(0, 20), (30, 50)], 0, set()) == (0, 0)


def test_span_cells_and_levels():
    hs = [(0, 0, 300, 0), (0, 100, 300, 100), (0, 200, 300, 200)]
    vs = [(0, 0, 0, 200), (300, 0, 300, 200), (200, 0, 200, 200), (100, 100, 100, 200)]
    assert grids.melted_cells([0, 100, 200], [0, 100, 200, 300], hs, vs, 5) == [(0, 0, 1, 2), (0, 2, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1)]
    bent = [(0, 0, 300, 0), (0, 200, 300, 200), (100, 100, 300, 100)]
    assert (0, 0, 1, 2) in grids.melted_cells([0, 100, 200], [0, 100, 200, 300], bent, vs, 5) and (1, 0, 1, 1) in grids.melted_cells([0, 100, 200], [0, 100, 200, 300], bent, vs, 5)
    assert grids.levels([1, 2, 9, 3, 10], 1.5) == [2, 9.5]
    assert grids.border_shares([0, 10, 20], [5, 9], [(0, 5, 4, 5), (3, 5, 6, 5), (8, 9, 12, 9)], 0, 1).round(6).tolist() == [[0.6, 0.0], [0.2, 0.2]]
    r = np.random.default_rng(7)
    for _ in range(60):  # against a flood fill over slots
        n, m = r.integers(1, 5, 2)
        open_v, open_h = r.random((n, max(m - 1, 0))) < 0.4, r.random((max(n - 1, 0), m)) < 0.4
        vs = [(10 * c + 10, 10 * y, 10 * c + 10, 10 * y + 10) for y in range(n) for c in range(m - 1) if not open_v[y, c]]
        hs = [(10 * c, 10 * y + 10, 10 * c + 10, 10 * y + 10) for y in range(n - 1) for c in range(m) if not open_h[y, c]]
        got = grids.melted_cells([10 * k for k in range(n + 1)], [10 * k for k in range(m + 1)], hs, vs, 1)
        seen, want = {}, []
        for s in itertools.product(range(n), range(m)):
            part, todo = set(), [s] if s not in seen else []
            while todo:
                y, x = todo.pop()
                if (y, x) not in part:
                    part.add((y, x))
                    todo += [(y, x + 1)] * int(x + 1 < m and open_v[y, x]) + [(y, x - 1)] * int(x > 0 and open_v[y, x - 1]) + [(y + 1, x)] * int(y + 1 < n and open_h[y, x]) + [(y - 1, x)] * int(y > 0 and open_h[y - 1, x])
            seen |= dict.fromkeys(part, 1)
            if part:
                y0, x0, y1, x1 = min(p[0] for p in part), min(p[1] for p in part), max(p[0] for p in part), max(p[1] for p in part)
                if len(part) == (y1 - y0 + 1) * (x1 - x0 + 1):
                    want.append((y0, x0, y1 - y0 + 1, x1 - x0 + 1))
                else:
                    for y in range(y0, y1 + 1):
                        own = sorted(x for a, x in part if a == y)
                        begins = [x for x in own if x == 0 or x - 1 not in own or not open_v[y, x - 1]]
                        want += [(y, x, 1, sum(1 for q in own if x <= q < min([b for b in begins if b > x], default=m))) for x in begins]
        assert got == sorted(want)


def test_blocks_of_a_page(spark):
    r = np.random.default_rng(6)
    for _ in range(30):
        n = int(r.integers(1, 9))
        links = [(int(a), int(b)) for a, b in r.integers(0, n, (int(r.integers(0, 16)), 2))]
        reach = np.eye(n, dtype=bool)
        for a, b in links:
            reach[a, b] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k]]
        both = reach & reach.T
        assert blocks.strong_components(n, links) == [int(np.flatnonzero(both[i])[0]) for i in range(n)]
    assert blocks.melted([(0, 0, 5, 5), (10, 0, 15, 5), (4, 4, 11, 9), (50, 50, 51, 51)]) == [0, 0, 0, 3]
    assert blocks._continued([(0, 0, 100, 50), (120, 0, 220, 200), (0, 60, 100, 200)], 20, 0.9, 0.6) == [0, 2, 1]
    box = [(40, 0, 60, 100)]
    assert set(blocks.largest_rectangles(box, (0, 0, 100, 100), 10, 10)) == {(0, 0, 40, 100), (60, 0, 100, 100)}
    for _ in range(80):  # against all rectangles between the obstacles' edges
        k = int(r.integers(0, 5))
        obs = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(*r.integers(-1, 9, (2, k)), *r.integers(1, 5, (2, k)), strict=True)]
        xs, ys = ({0, 9} | {e for o in obs for e in (o[i], o[i + 2]) if 0 <= e <= 9} for i in (0, 1))
        empty = [(a, c, b, d) for a in xs for b in xs for c in ys for d in ys if a < b and c < d and not any(o[0] < b and o[2] > a and o[1] < d and o[3] > c for o in obs)]
        holds = lambda p, q: p != q and p[0] <= q[0] and p[1] <= q[1] and p[2] >= q[2] and p[3] >= q[3]
        want = [p for p in empty if p[2] - p[0] >= 2 and p[3] - p[1] >= 2 and not any(holds(q, p) for q in empty)]
        assert blocks.empty_rectangles(obs, (0, 0, 9, 9), 2, 2) == sorted(want)
    items = spark.createDataFrame([(1, 0.0, float(y), 40.0, y + 8.0) for y in range(0, 200, 10)] + [(1, 60.0, float(y), 100.0, y + 8.0) for y in range(0, 200, 10)], "page int, x0 double, y0 double, x1 double, y1 double")
    bounds = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 200.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert [(g.x0, g.x1) for g in blocks.gutters(items, bounds, 10.0).collect()] == [(40.0, 60.0)]
    levels = spark.createDataFrame([(1, i, 0, i, 10.0 * i, 0.0, 10.0 * i + 5, 10.0) for i in range(4)] + [(1, i, 1, i // 2, 10.0 * i, 0.0, 10.0 * i + 5, 10.0) for i in range(4)] + [(1, i, 2, 0, 10.0 * i, 0.0, 10.0 * i + 5, 10.0) for i in range(4)], "page int, item int, level int, `group` int, x0 double, y0 double, x1 double, y1 double")
    lane = spark.createDataFrame([(1, 16.0, 0.0, 19.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert {(q.item, q.level, q.group) for q in blocks.level_choice(levels, lane).collect()} == {(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1)}
    cand = spark.createDataFrame([(1, "n", "cuts", 2.0), (1, "n", "links", 1.0), (2, "n", "links", 9.0)], "page int, context string, candidate string, f double")
    best = {q.page: (q.candidate, q.score) for q in blocks.judged(cand, {"n cuts": [1.0, 0.0], "n links": [0.5, 2.0]}, ["f"]).collect()}
    assert best == {1: ("links", 2.5), 2: ("links", 6.5)}


def test_tokens_and_slots():
    assert tables.cells_of_tokens("fcel lcel nl ucel xcel nl".split()) == [(0, 0, 2, 2, True)]
    assert tables.cells_of_tokens("fcel fcel nl lcel nl".split()) == [(0, 0, 1, 1, True), (0, 1, 1, 1, True), (1, 0, 1, 1, False), (1, 1, 1, 1, False)]
    assert tables.cells_of_tokens("fcel lcel nl ucel fcel nl".split()) == [(0, 0, 1, 2, True), (1, 0, 1, 1, False), (1, 1, 1, 1, True)]
    assert tables.cells_of_tokens([]) == []
    assert tables.place_cells([[(2, 1), (1, 2)], [(1, 1), (1, 1)], [(1, 3)]]) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0)]
