import random

import numpy as np
import xxhash

from leafmill.llm import spans as S
from leafmill.llm.rows import row_hash


def test_sentences_cover_the_text():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("ab .!?\n\"…é") for _ in range(r.randint(0, 60)))
        assert "".join(S.sentences(t)) == (t if t.split() else "")
    assert S.sentences("A b. C d!\nE") == ["A b. ", "C d!\n", "E"]
    assert S.sentences(" (He said: “No…” ) Yes.No") == [" (He said: “No…” ", ") Yes.No"]
    assert S.sentences(None) == S.sentences(" \n ") == []
    assert len(S.spans(None)) == len(S.spans("")) == len(S.spans("One.")) == 0


def words_of(t):
    return (t or "").encode().lower().split()


def plain_sentences(t):
    """Sentences as lists of words, one word and one pair at a time."""
    import re

    words = words_of(t)
    ends = {len(words_of(t[: m.end()])) for m in re.finditer("[.!?…]+[\"'”’»)\\]]*[ \t-\r]+|[ \t-\r]*\n[ \t-\r]*", t or "")}
    bounds = sorted(({0, len(words)} | ends) & set(range(len(words) + 1)))
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        cuts = [a]
        if b - a > S.LONG:
            pair = [int(S._mixed(np.array([xxhash.xxh64_intdigest(x) * S.BASES[0] + xxhash.xxh64_intdigest(y) & 2**64 - 1], np.uint64), 1)[0]) for x, y in zip(words[a:b], words[a + 1 : b], strict=False)]
            for i in range(S.APART, len(pair) - S.APART):
                if all(pair[i] < x for x in pair[i - S.APART : i]) and all(pair[i] <= x for x in pair[i + 1 : i + S.APART + 1]):
                    cuts.append(a + i + 1)
        out += [words[x:y] for x, y in zip(cuts, [*cuts[1:], b], strict=True)]
    return out


def plain_runs(t, several=2, least=12):
    """(first sentence, sentences, words) of each run."""
    cut, out = plain_sentences(t), []
    for i in range(len(cut) - several + 1):
        j = i + several
        while sum(map(len, cut[i:j])) < least and j < len(cut):
            j += 1
        if sum(map(len, cut[i:j])) >= least:
            out.append((i, j - i, b" ".join(sum(cut[i:j], []))))
    return out


def test_arrays_against_plain_words():
    """Cuts and runs of random texts, and that runs hash alike exactly where their words are the same."""
    r = random.Random(5)
    seen = {}
    for _ in range(250):
        t = "".join(r.choice(["a", "B", "cd", "É", "x" * 80]) + r.choice([" ", " ", " ", "\t", ". ", "? ", "\n", "!” ", "… ", "\xa0"]) for _ in range(r.randint(0, 120)))
        assert [words_of(u) for u in S.sentences(t)] == plain_sentences(t)
        got = S.spans(t).tolist()
        want = plain_runs(t)
        assert [(i, n) for i, n, *_ in got] == [(i, n) for i, n, _ in want]
        for (_, _, hi, lo), (_, _, words) in zip(got, want, strict=True):
            assert seen.setdefault(words, (hi, lo)) == (hi, lo)
    assert len(set(seen.values())) == len({lo for _, lo in seen.values()}) == len(seen) > 500


def brute(rows):
    """(row, doc_id, hash of the row, text) -> row: kept text, by comparing every run with every other."""
    runs = [(words, (i is None, i or 0, tie, k, at), n) for k, i, tie, t in rows for at, n, words in plain_runs(t)]
    least = {}
    for words, where, _ in runs:
        least[words] = min(least.get(words, where), where)
    drop = {}
    for words, where, n in runs:
        if least[words] != where:
            drop.setdefault(where[3], set()).update(range(where[4], where[4] + n))
    return {k: t and "".join(u for j, u in enumerate(S.sentences(t)) if j not in drop[k]) if k in drop else t for k, _, _, t in rows}


def hashed(docs):
    return {r.k: r.h for r in docs.select("k", row_hash(docs).alias("h")).collect()}


def test_against_brute_force(spark):
    r = random.Random(7)
    pool = [" ".join(r.choice(["ab", "cd", "ef", "gh"]) + str(r.randint(0, 40)) for _ in range(r.randint(3, 18))) + r.choice([". ", "! ", ".\n"]) for _ in range(120)]
    passages = [pool[k : k + 5] for k in (0, 10, 20)]
    rows = []
    for i in range(60):
        t = [r.choice(pool[40:]) for _ in range(r.randint(0, 6))]
        if r.random() < 0.6:
            t[r.randint(0, len(t)) : 0] = r.choice(passages)
        rows.append((i, "".join(t)))
    rows += [(100, None), (101, ""), (None, "".join(passages[0])), (102, "".join(passages[1]) + "x " * 100000)]
    rows += [(None, rows[3][1]), (None, "".join(passages[0])), (7, "".join(passages[2])), (7, rows[7][1]), (None, None)]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, k int").repartition(4)
    got = S.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "k", "n_sentences", "n_removed"]
    tie = hashed(docs)
    assert {x.k: x.text for x in got.collect()} == brute([(k, i, tie[k], t) for k, (i, t) in enumerate(rows)])
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    t = "The first one has words enough here. The second one has some as well. And a third to close it."
    for key in (1, None):
        docs = spark.createDataFrame([(key, t), (key, t), (2, "Intro is new. " + t)], "doc_id long, text string").repartition(2)
        got = sorted((str(x.doc_id), x.text) for x in S.remove_repeats(docs).collect())
        first = ("1", t) if key else ("2", "Intro is new. " + t)
        assert got == sorted([first, (str(key), ""), ("2", "Intro is new. ") if key else ("None", "")])


def test_clashing_names(spark):
    t = "The first one has words enough here. The second one has some as well."
    docs = spark.createDataFrame([(1, t, 7, 8, 9), (2, t, 7, 8, 9)], "doc_id long, text string, n_removed int, GONE int, row int")
    got = S.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_sentences", "n_removed_1"]
    assert sorted(map(tuple, got.collect())) == [(1, t, 7, 8, 9, 2, 0), (2, "", 7, 8, 9, 2, 2)]


def _words(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def test_passages_inside_long_sentences_and_short_runs(spark):
    """Fifty words of one long sentence go from inside another one, and two sentences of 14 words as well."""
    passage = " ".join(_words("p", 60))
    rows = [(1, " ".join(_words("a", 30)) + " " + passage + " " + " ".join(_words("b", 9)) + "."), (2, " ".join(_words("c", 11)) + " " + passage + " " + " ".join(_words("d", 40)) + ".")]
    rows += [(3, "So it goes on with us here. It is so and stays so now. Own three."), (4, "Own four. So it goes on with us here. It is so and stays so now.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in S.remove_repeats(docs).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[4] == "Own four. "
    left = set(got[2].split())
    assert len(left & set(_words("p", 60))) <= 30 and set(_words("c", 11)) | set(_words("d", 39)) <= left


def test_rows_are_told_apart_by_text(spark):
    t = "The first one has words enough here. The second one has some as well. "
    rows = [(None, t + "Own a. Own b."), (None, t + "Own c. Own d."), (None, "Clean one here. Clean two here. Clean three."), (7, "Clean e. Clean f. Clean g."), (7, "Clean h. " + t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x.text for x in S.remove_repeats(docs).collect())
    # The row with an id comes first; both rows without one lose the passage and nothing else.
    assert got == sorted(["Own a. Own b.", "Own c. Own d.", rows[2][1], rows[3][1], rows[4][1]])
