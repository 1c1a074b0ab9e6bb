"""Corrections against all scripts of edits, tried one by one."""

import math
import random

import pytest

from leafmill.operators import channel as C


def scripts(got, edits, most):
    """{(what comes out): best log probability} of up to ``most`` edits undone at separate places, left to right."""
    out = {}

    def go(at, done, lp, n):
        if n:
            whole = done + got[at:]
            out[whole] = max(out.get(whole, -1e9), lp)
        if n == most:
            return
        for i in range(at, len(got) + 1):
            for (alpha, beta), cost in edits.items():
                if got[i : i + len(beta)] == beta and i + len(beta) <= len(got):
                    go(i + len(beta), done + got[at:i] + alpha, lp + cost, n + 1)

    go(0, "", 0.0, 0)
    return out


def made(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("aemnrtc") for _ in range(r.randint(2, 7))) for _ in range(400)})
    lex = {w: -r.uniform(1, 14) for w in words}
    edits = {("e", "c"): -0.7, ("rn", "m"): -1.1, ("m", "rn"): -0.9, ("a", ""): -2.0, ("", "t"): -1.4, ("ee", "c"): -2.5, ("n", "r"): -1.0}
    bad = {"".join(r.choice("aemnrtc") for _ in range(r.randint(3, 6))) for _ in range(60)} - set(words)
    return lex, edits, sorted(bad)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_candidates_against_all_scripts(spark, most):
    lex, edits, bad = made(most)
    f = spark.createDataFrame
    got = C.candidates(f([("x", b) for b in bad], "lang string, got string"), f([(a, b, p) for (a, b), p in edits.items()], "alpha string, beta string, lp double"),
                       f([("x", w, p) for w, p in lex.items()], "lang string, word string, logf double"), max_edits=most, beam=10**6, floor=-18.0)
    have = {(x.got, x.cand): round(x.score, 6) for x in got.collect()}
    want = {(b, c): round(lp + lex[c] + 18.0, 6) for b in bad for c, lp in scripts(b, edits, most).items() if c in lex and c != b}
    assert have == want and len(want) > 3 ** most


def test_the_beam_keeps_the_likeliest(spark):
    f = spark.createDataFrame
    lex = f([("x", "aacc", -3.0), ("x", "bbcc", -1.0)], "lang string, word string, logf double")
    edits = f([("aa", "q", -1.0), ("bb", "q", -2.0)], "alpha string, beta string, lp double")
    bad = f([("x", "qcc")], "lang string, got string")
    assert {x.cand for x in C.candidates(bad, edits, lex, beam=1).collect()} == {"aacc"}
    assert {x.cand for x in C.candidates(bad, edits, lex, beam=2).collect()} == {"aacc", "bbcc"}


def test_margin_gain_and_case(spark):
    rows = [("x", "one", "aa", 2.0), ("x", "one", "bb", 1.5), ("x", "two", "Aa", 2.0), ("x", "two", "aa", 1.9), ("x", "two", "cc", 0.5), ("x", "low", "dd", -1.5), ("x", "tie", "ee", 1.0), ("x", "tie", "ff", 1.0), ("x", "own", "gg", -0.5)]
    got = {x.got: (x.cand, x.lead) for x in C.corrections(spark.createDataFrame(rows, "lang string, got string, cand string, score double")).collect()}
    assert got == {"two": ("Aa", 1.5), "own": ("gg", None)}


def test_channel_counts(spark):
    pairs = [("then", "tlen", 3), ("corn", "com", 2), ("corn", "corn", 9), ("sea", "seaa", 2), ("rare", "nare", 1)]
    e = C.single_edits(spark.createDataFrame(pairs, "truth string, got string, n long"))
    got = {(x.alpha, x.beta): x.n for x in e.collect()}
    assert got == {("h", "l"): 3, ("rn", "m"): 2, ("", ""): 9, ("", "a"): 2, ("r", "n"): 1}
    grams = C.gram_counts(spark.createDataFrame([("then", 5), ("corn", 2)], "word string, n long"))
    uses = {x.alpha: x.n for x in grams.collect()}
    assert uses["h"] == 5 and uses["rn"] == 2 and uses[""] == 35 and uses["n"] == 7
    ch = {(x.alpha, x.beta): x.lp for x in C.channel(e.select("alpha", "beta", "n"), grams).collect()}
    assert set(ch) == {("h", "l"), ("rn", "m"), ("", "a")} and abs(ch["rn", "m"] - math.log(2.5 / 3.5)) < 1e-9


def test_words_keep_their_marks_and_pages_vouch(spark):
    f = spark.createDataFrame
    words = f([(1, "x", '"thc,"'), (2, "x", "thc"), (1, "x", "fine"), (1, "x", "--"), (1, "y", "thc")], "page long, lang string, text string")
    fixes = f([("x", "thc", "the", 3.0, None)], "lang string, got string, cand string, score double, lead double")
    got = sorted((x.page, x.text, x.corrected_from) for x in C.corrected(words, fixes, vouched=f([(2, "thc")], "page long, word string")).collect())
    assert got == [(1, '"the,"', '"thc,"'), (1, "--", None), (1, "fine", None), (1, "thc", None), (2, "thc", None)]


def test_what_may_be_wrong_and_empty_tables(spark):
    f = spark.createDataFrame
    known = f([("x", "known")], "lang string, word string")
    words = f([("x", w) for w in ("known", "knowm", "knowm", "abc", "12345a", "----", "a1b2", "ümlaut")], "lang string, word string")
    assert sorted(x.got for x in C.misread(words, known).collect()) == ["a1b2", "knowm", "ümlaut"]
    lex = f([], "lang string, word string, logf double")
    none = C.candidates(f([], "lang string, got string"), f([], "alpha string, beta string, lp double"), lex)
    assert C.corrections(none).count() == 0
