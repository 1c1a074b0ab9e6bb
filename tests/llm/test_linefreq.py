"""Line frequencies against plain loops, and the awkward tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from leafmill.llm import linefreq as L

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def lines_of(t):
    even = re.sub("[1-9]", "0", lower(t))
    return [x for x in (" ".join(w for w in WORD.findall(line)) for line in even.split("\n")) if x]


def base(t):
    words = WORD.findall(t)
    held = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(held) - len(set(held)), len(cover), n < 10 or 100 * len(cover) > 20 * n


def verdicts(rows, share, least):
    """rows: (id, text, host), each a document."""
    texts, counts = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        texts[h].add(t)
        for x in lines_of(t or ""):
            counts[h, x].add(t)
    above = {k for k, v in counts.items() if len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for i, t, h in rows:
        b = base(t or "")
        gone = [x for x in lines_of(t or "") if (h, x) in above]
        words = sum(len(x.split(" ")) for x in gone)
        kept = not b[5] and not (gone and (b[0] - words < 10 or words > 0.5 * b[0]))
        out.append((i, *b, len(gone), words, kept))
    return sorted(map(repr, out)), above


def made(seed=3, n=160):
    r = random.Random(seed)
    some = ["".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(some) for _ in range(k))
    common = ["Page 12 of 99", "  All\trights\x0breserved #1 ", say(14), "é ß 🙂 &c"]
    rows = []
    for i in range(n):
        host = r.choice(["a", "a", "b", None, ""])
        lines = [say(r.randint(1, 12)) for _ in range(r.randint(0, 6))] + [x.replace("12", str(r.randint(10, 99))) for x in common if r.random() < 0.3]
        if r.random() < 0.2:
            lines += [lines[0]] * 2 if lines else []
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), host))
    whole = (900, "\n".join(say(6) for _ in range(4)), "a")
    return rows + [whole] * 40 + [(None, None, "a"), (None, None, None), (5, "", "b"), (6, " \n\t\n", "b"), (7, "x " * 30000, "b"), (8, "\n".join(common * 3), "a")]


@pytest.mark.parametrize("share,least", [(0.05, 10), (0.2, 3), (0.0, 0)])
def test_against_loops(spark, share, least):
    rows = made()
    want, above = verdicts(rows, share, least)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = L.judge(docs, share, least)
    names = ["doc_id", *L.BASE, "n_lines_removed", "n_words_removed", "kept"]
    assert got.columns == names
    assert sorted(repr(tuple(x)) for x in got.collect()) == want
    assert L.frequent_lines(docs, share, least).count() == len(above) and above


def test_join_by_key_gives_the_same(spark, monkeypatch):
    rows = made(4)
    monkeypatch.setattr(L, "SMALL", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(repr(tuple(x)) for x in L.judge(docs).collect()) == verdicts(rows, 0.05, 10)[0]


def test_copies_of_a_document_are_no_boilerplate(spark):
    text = "\n".join(f"one two three four {chr(97 + k)}" for k in range(5))
    rows = [(i, text, "h") for i in range(50)] + [(100 + i, f"{text} x{chr(97 + i)}", "h") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(x.kept and not x.n_lines_removed for x in L.judge(docs, least=8).collect())


def test_clean_takes_the_lines_out(spark):
    rows = made(5)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _row int, line int")
    _, above = verdicts(rows, 0.05, 10)
    kept = Counter()
    for i, t, h in rows:
        b, gone = base(t or ""), [x for x in lines_of(t or "") if (h, x) in above]
        words = sum(len(x.split(" ")) for x in gone)
        if not b[5] and not (gone and (b[0] - words < 10 or words > 0.5 * b[0])):
            left = [x for x in t.split("\n") if not (lines_of(x) and (h, lines_of(x)[0]) in above)]
            kept[i, "\n".join(left), h] += 1
    got = L.clean(docs)
    assert got.columns == docs.columns
    assert Counter((x.doc_id, x.text, x.source) for x in got.collect()) == kept and len(kept) > 20


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame(made(6), "doc_id long, text string, source string")
    none = docs.limit(0)
    assert L.judge(none).count() == 0 and L.clean(none).count() == 0
    odd = docs.selectExpr("doc_id", "text", "source", "1 as host", "2 as n_words", "3 as _w", "4 as line", "5 as words")
    assert sorted(map(repr, L.judge(odd).collect())) == sorted(map(repr, L.judge(docs).collect()))
