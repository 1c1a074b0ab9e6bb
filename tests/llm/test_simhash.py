import random

import numpy as np
import pytest
import xxhash

from leafmill.llm import simhash as S


def plain(text, width=3):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "  \t\n", "One", "A b", "A b c", "É a B c d e É a b", "x " * 500 + "y", "\x1fa b\x0bc d"])
def test_fingerprint(text):
    assert S.simhash(text) == plain(text)


def test_long_text_in_chunks(monkeypatch):
    t = " ".join(str(i % 977) for i in range(5000))
    want = S.simhash(t)
    monkeypatch.setattr(S, "CHUNK", 64)
    assert S.simhash(t) == want == plain(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_sliced_pairs(radius, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 50)
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    f = base[r.integers(0, 12, 400)]
    for _ in range(4):
        f = f ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)) * r.integers(0, 2, 400).astype(np.uint64)
    g = np.sort(r.integers(0, 5, 400))
    got = {(int(i), int(j)) for a, b in S.sliced_pairs(f, g, radius) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if g[i] == g[j] and bin(int(f[i]) ^ int(f[j])).count("1") <= radius}
    assert got == want


@pytest.mark.parametrize(("large", "tile"), [(1024, 2048), (8, 16)])
def test_links_give_the_components(spark, large, tile):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(20)]
    fps = set(seeds)
    for s in seeds[:6]:
        for _ in range(60):
            x = s
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(20, 40)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5)
    from leafmill.operators.components import connected_components

    got = {x.node: x.component for x in connected_components(S.fingerprint_links(nodes, 2, large, tile)).collect()}
    want = roots(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert {x: got.get(x, x) for x in fps} == want


def test_near_duplicates(spark):
    texts = ["a b c d e f", "A b c d e f", None, "", "one", "one", "b c d", " ".join(map(str, range(300))), " ".join(map(str, range(299)))]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x"), (4, "A b c d e f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(map(str, (x[:2] for x in got))) == sorted(str((i, f"{plain(t):016x}")) for i, t, _ in rows)
    by = roots(list(range(len(rows))), lambda a, b: bin(plain(rows[a][1]) ^ plain(rows[b][1])).count("1") <= 2)
    least = {}
    for k, root in by.items():
        if rows[k][0] is not None:
            least[root] = min(least.get(root, 99), rows[k][0])
    assert sorted(map(str, ((i, c) for i, _, c in got))) == sorted(str((rows[k][0], least[by[k]])) for k in by)
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d e f", "a b c d e a b c d e " * 90])
def test_wide_fingerprint(text):
    words = (text or "").lower().split()
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    h = [int(S._remixed(np.array([xxhash.xxh64_intdigest(s, 42)], np.uint64), 3)[0]) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = S.wide_simhash(text, n_words=5)
    assert len(got) == 40 and int.from_bytes(got[24:32], "little") == want


def _mutants(r, base, n, most):
    out = []
    for _ in range(n):
        f = base.copy()
        for b in r.choice(512, r.integers(0, most + 1), replace=False):
            f[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        out.append(f)
    return out


def test_thinned_tile_connects_what_all_pairs_connect(monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 700)
    r = np.random.default_rng(3)
    for pivots in (0, 1, 7, 400):
        monkeypatch.setattr(S, "PIVOTS", pivots)
        bases = r.integers(0, 2**63, (4, 8), dtype=np.uint64)
        f = np.stack([x for b in bases for x in _mutants(r, b, 80, 70)])[r.permutation(320)]
        near = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= 60
        want = roots(range(320), lambda a, b: near[a, b])
        assert S._spanning(320, S._thinned(f, 60)).tolist() == [want[i] for i in range(320)]


@pytest.mark.parametrize(("tile", "dense"), [(16384, 256), (20, 256), (20, 5)])
def test_copy_links_give_the_components(spark, tile, dense, monkeypatch):
    monkeypatch.setattr(S, "DENSE", dense)
    r = np.random.default_rng(9)
    bases = r.integers(0, 2**63, (30, 8), dtype=np.uint64)
    f = [x.tobytes() for k, b in enumerate(bases) for x in _mutants(r, b, 90 if k == 0 else 3, 40)]
    f = sorted(set(f))
    from leafmill.operators.components import connected_components

    nodes = spark.createDataFrame([(x,) for x in f], "fp binary").repartition(4)
    got = {bytes(x.node): bytes(x.component) for x in connected_components(S.copy_links(nodes, 90, tile)).collect()}
    bits = [int.from_bytes(x, "little") for x in f]
    want = roots(range(len(f)), lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 90)
    assert [got.get(x, x) for x in f] == [f[want[i]] for i in range(len(f))]


def test_drop_near_duplicates(spark):
    base = [f"w{i}" for i in range(400)]
    edited = base.copy()
    edited[7], edited[300] = "x", "y"
    texts = [" ".join(base), " ".join(edited), " ".join(base), " ".join(base[:200]), None, " ", "", "one", "One", "one two"]
    docs = spark.createDataFrame([(i + 2, t, i) for i, t in enumerate(texts)] + [(2, texts[0], 77), (None, texts[0], 78)], "doc_id long, text string, fp int")
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [2, 5, 6, 9, 11]
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0


def _pair(n, common, tag):
    """Texts of n and n distinct five-word shingles with so many in common: the second one's end is its own."""
    a = [f"{tag}{i}" for i in range(n + 4)]
    return " ".join(a), " ".join(a[: common + 4] + [f"{tag}x{i}" for i in range(n - common)])


def test_links_are_checked_on_the_shingle_sets(spark):
    """Likeness c / (2 n - c): 0.8 and more goes, all below stays, for few shingles and many."""
    cases = [(9, 8, True), (9, 7, False), (45, 40, True), (45, 39, False), (90, 80, True), (90, 79, False), (450, 400, True), (450, 394, False)]
    rows, want = [], []
    for k, (n, c, like) in enumerate([x for x in cases for _ in range(25)]):
        assert (c / (2 * n - c) >= 0.8) == like
        rows += [(2 * k, _pair(n, c, f"t{k}w")[0]), (2 * k + 1, _pair(n, c, f"t{k}w")[1])]
        want += [2 * k] if like else [2 * k, 2 * k + 1]
    rows += [(9001, "a b c d e f g h"), (9002, "a b c d e f g h i")]  # four of five shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in S.drop_near_duplicates(docs).collect()) == [*want, 9001]


def test_like_sets_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 900)
    r = random.Random(4)
    texts = []
    for k in range(6):
        base = [f"b{k}x{i}" for i in range(r.choice([20, 60, 120]))]
        for _ in range(15):
            t = base.copy()
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = f"y{r.randrange(10**6)}"
            texts.append(" ".join(t))
    sets = [set(S.shingle_set(t).tolist()) for t in texts]
    want = roots(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in S.near_copies(docs).collect()}
    assert got == want


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(100)) for k in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (1, a), (None, a), (None, b)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text[0]) for r in S.drop_near_duplicates(docs).collect())
    assert got == [(1, "a"), (1, "b")]


def test_rows_without_an_id_and_clashing_names(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    rows = [(None, a, 1, 1, "p"), (None, a, 1, 1, "p"), (None, b, 2, 2, "q"), (None, c, 3, 3, "r"), (5, c, 4, 4, "s"), (5, c, 9, 9, "t"), (5, c, 4, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, TIE int, component_id string").repartition(3)
    got = S.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 3 and {rows[0], rows[2]} <= set(kept) and {k[0] for k in kept} == {None, 5}
    again = [tuple(r) for r in S.drop_near_duplicates(docs.repartition(7)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, kept))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in S.near_copies(docs).collect()) == [("5", "5")] * 3 + [("None", "5")] + [("None", "None")] * 3


def test_keys_grow_with_the_texts():
    """The texts of a key stay bounded on average, and a pair shares as many keys at every size."""
    for n in (0, 1, 10**5, 10**7, 10**9, 10**11):
        bits, ways = S.key_plan(n)
        assert n / 2**bits <= S.MEETING and ways * 0.85**bits >= 9.6 and ways << bits < 1 << 62
    assert S.key_plan(10**6) == (13, 80)


def test_hot_keys_beyond_the_broadcast(spark, monkeypatch):
    r = np.random.default_rng(2)
    f = sorted({x.tobytes() for x in _mutants(r, r.integers(0, 2**63, 8, dtype=np.uint64), 60, 20)})
    nodes = spark.createDataFrame([(x,) for x in f], "fp binary")
    from leafmill.operators.components import connected_components

    for most in (S.HOT_KEYS, 0):
        monkeypatch.setattr(S, "HOT_KEYS", most)
        assert {bytes(x.component) for x in connected_components(S.copy_links(nodes, 90, 20)).collect()} == {f[0]}


def test_a_group_has_few_links_whatever_keys_it_shares(spark, monkeypatch):
    """Each of 80 keys gave every fingerprint of a group a link of its own, and a key cut into tiles gave one for each part."""
    r = np.random.default_rng(5)
    f = sorted({x.tobytes() for x in _mutants(r, r.integers(0, 2**63, 8, dtype=np.uint64), 400, 12)})
    seen, real = [], S.connected_components

    def counted(links):
        seen.append(links.distinct().count())
        return real(links)

    monkeypatch.setattr(S, "connected_components", counted)
    found = S.copy_groups(spark.createDataFrame([(x,) for x in f], "fp binary"), 90, 50).collect()
    assert len(found) == len(f) and len({x.component for x in found}) == 1
    assert len(seen) == 2 and seen[0] <= S.FIRST * len(f) and seen[1] < len(f) / 10
