"""Fill-in-the-middle against plain loops; exact round trips."""

import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from leafmill.llm import fim as M


def plain_way(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, s = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, sha(text), text, sha(text))
    spm = h[3] % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, "spm" if spm else "psm", len(pre), len(mid), out, sha(out), text, sha(text))


def texts():
    r = random.Random(1)
    own = [None, "", " ", "a", "A1", "\n\r\x0b", "é🙂ſK z", "x<P>y", "<S>", "a <M> b", "<P", "<<S", "P>x<", "word " * 60000, "q" * 200000]
    return own + ["".join(r.choice("ab Z<>PSM\n9é🙂") for _ in range(r.randint(1, 60))) for _ in range(250)]


def test_against_plain_loops(spark):
    rows = [(k - 3 if k != 7 else None, t) for k, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = M.restore(M.fill_in_middle(docs)).drop("text")
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored", "restored_sha256"]
    assert sorted(repr(tuple(x)) for x in got.collect()) == sorted(repr(plain_way(*r)) for r in rows)
    assert {x.form for x in got.collect()} == {"plain", "psm", "spm"}


@given(st.text(alphabet="aZ<>PSM \n🙂", max_size=40), st.integers(0, 10**6))
def test_round_trip(text, doc_id):
    _, form, _, _, out = M.rearranged(text, str(doc_id), 1)
    assert M.restored(out, form) == text


def test_small_parts_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts()[:13] + texts()[15:])), "doc_id long, text string")
    want = sorted(map(repr, M.fill_in_middle(docs).collect()))
    import pandas as pd

    monkeypatch.setattr(M, "CHARS", 30)
    parts = list(M._parts(pd.Series(["a" * 20, None, "b" * 20, "c", ""])))
    assert [(p.start, p.stop) for p in parts] == [(0, 3), (3, 5)]
    assert sorted(map(repr, M.fill_in_middle(docs).collect())) == want


def test_empty_table_clashing_names_and_text_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "x")], "doc_id long, text string, N int, form string")
    assert M.restore(M.fill_in_middle(docs.limit(0))).count() == 0
    got = M.restore(M.fill_in_middle(docs)).first()
    assert got.n == 7 and got.restored == "a b c d" and got.doc_id == 1
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert M.fill_in_middle(named).first().output == got.output
