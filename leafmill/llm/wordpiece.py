"""Greedy word-piece counts in one pass over each word.

The vocabulary trie gets failure links and, per node, how many pieces are popped when the link is taken.  Walking a word
then follows child edges where they exist and failure links where not, adding the stored counts; each character moves the
automaton at most once forward and pops are amortised, so a word costs time linear in its length and no piece is ever built.

A word is a run of bytes outside ASCII blanks, matched with the word mark in front.  A word that greedy matching cannot cover
counts as one unknown token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


class PieceCounter:
    """Trie with failure links; ``count`` gives the greedy longest-match length of a word, or None if it cannot be covered."""

    def __init__(self, pieces: Iterable[str], mark: str = ""):
        self.mark = mark
        kids: list[dict[str, int]] = [{}]
        ends: list[bool] = [False]
        self.widest = 0
        for p in pieces:
            if not p:
                continue
            self.widest = max(self.widest, len(p))
            at = 0
            for c in p:
                nxt = kids[at].get(c)
                if nxt is None:
                    nxt = kids[at][c] = len(kids)
                    kids.append({})
                    ends.append(False)
                at = nxt
            ends[at] = True
        # fail[v]: where v's text stands once its longest match is popped; pops[v]: how many pieces that pops.
        fail, pops = [-1] * len(kids), [0] * len(kids)
        rows = [(0, c, v) for c, v in kids[0].items()]
        while rows:
            below = []
            for u, c, v in rows:
                if ends[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in kids[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = kids[z][c], n
                below += [(v, d, w) for d, w in kids[v].items()]
            rows = below
        self.kids, self.fail, self.pops = kids, fail, pops

    def count(self, word: str) -> int | None:
        kids, fail, pops = self.kids, self.fail, self.pops
        at, n = 0, 0
        for c in self.mark + word:
            nxt = kids[at].get(c)
            while nxt is None:
                if fail[at] < 0:
                    return None
                n += pops[at]
                at = fail[at]
                nxt = kids[at].get(c)
            at = nxt
        while at:  # what is left must pop down to the root
            if fail[at] < 0:
                return None
            n += pops[at]
            at = fail[at]
        return n


class WordCounts(dict):
    """Word bytes -> (tokens, unknown words), worked out once for each distinct word."""

    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.counter.count(word.decode("utf-8", "surrogatepass"))
        out = self[word] = -1 if n is None else n
        return out


def text_counts(text: str | None, counts: WordCounts) -> tuple[int, int, int]:
    """(words, tokens, unknown words); a null text is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    each = [counts[w] for w in words]
    unknown = each.count(-1)
    return len(each), sum(each) + 2 * unknown, unknown


def token_counts(docs: DataFrame, pieces: Iterable[str], mark: str = "", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of docs, repeated rows and null ids included.

    pieces: the vocabulary, shipped to the workers once per task (some megabytes); an empty vocabulary makes every word unknown.
    """
    vocabulary, name = docs.sparkSession.sparkContext.broadcast(list(pieces)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(_counter(name, vocabulary, mark))
        for b in batches:
            rows = [text_counts(t.as_py(), counts) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


_BUILT: dict[str, PieceCounter] = {}


def _counter(name: str, vocabulary, mark: str) -> PieceCounter:
    """One automaton per worker process and vocabulary."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = PieceCounter(vocabulary.value, mark)
    return _BUILT[name]
