import random

from leafmill.llm import wordpiece as W


def greedy(word, vocab, mark=""):
    s, n = mark + word, 0
    while s:
        k = next((k for k in range(len(s), 0, -1) if s[:k] in vocab), 0)
        if not k:
            return None
        s, n = s[k:], n + 1
    return n


def test_counts_equal_greedy_matching():
    r = random.Random(1)
    for trial in range(60):
        vocab = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 25))}
        c = W.PieceCounter(sorted(vocab), "▁")
        for _ in range(200):
            w = "".join(r.choice("abcd") for _ in range(r.randint(0, 14)))
            assert c.count(w) == greedy(w, vocab, "▁"), (vocab, w)


def test_text_counts_and_memory(monkeypatch):
    monkeypatch.setattr(W, "REMEMBERED", 2)
    counts = W.WordCounts(W.PieceCounter(["a", "ab", "b", "▁"], "▁"))
    assert W.text_counts("ab  aab\nz ab\x0b", counts) == (4, 2 + 3 + 1 + 2, 1)
    assert W.text_counts(None, counts) == W.text_counts(" \t", counts) == (0, 0, 0)
    assert len(counts) <= 2


def test_table(spark):
    rows = [(1, "ab b", 9), (1, "ab b", 9), (None, "a", 9), (2, None, 9), (3, "", 9), (4, "ab " * 50000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in W.token_counts(docs, ["a", "b", "ab"]).collect())))
    assert got == sorted(map(str, [(1, 2, 2, 0), (1, 2, 2, 0), (None, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 50000, 50000, 0)]))
    assert W.token_counts(docs.limit(0), ["a"]).count() == 0
    assert {r.n_unknown for r in W.token_counts(docs.filter("doc_id = 1"), []).collect()} == {2}
