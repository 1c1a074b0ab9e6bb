"""Substring dedup over sliding spans of sentences.

Every sentence starts a span: the run of two consecutive sentences from it, or more until they hold ``least`` words.  Spans are
hashed to 128 bits, written as a table and joined over all documents; a span's first occurrence is the one with the least doc_id,
then the least hash of the row, row number and position.  Sentences that some non-first occurrence covers go; everything else,
blanks included, stays byte for byte.

A sentence ends behind ``.``, ``!``, ``?`` or ``…`` (closing quotes and brackets included) before white space, and at a line
break.  One of more than ``LONG`` words is cut further, before each word whose pair with the word before it has the least hash
among its ``APART`` neighbours on both sides, and each piece counts as a sentence: a passage inside it is cut the same way
wherever it stands.  Words are what stands between ASCII blanks, A-Z lower-cased.

A text is worked on as arrays: hashes of its words, cuts by number of the word, and run hashes from running sums of the words'
hashes times powers of a base, so that no run's text is built.  Spans meet twice: first by 64 bits and nothing else, which finds
the few that occur again, then these with all 128.

Defined results: a null text stays null and has no sentence; a text without words has none either; a text of fewer sentences than
a run stays; a null doc_id comes last in the order of occurrences; every row is a document of its own, so of rows that repeat each
other, with an id or without, the first keeps its sentences; rows of one doc_id with different texts are different documents; of
columns named like an added one, the added one gets a number behind its name; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from leafmill.llm.rows import free_names, numbered, place
from leafmill.staging import materialize, release

#: Last bytes of words that end a sentence, and of words that may, with what these then end in (UTF-8).
ENDS, MAYBE = np.zeros(256, bool), np.zeros(256, bool)
ENDS[list(b".!?")] = True
MAYBE[list("\"')]".encode()) + [c.encode()[-1] for c in "”’»…"]] = True
TAIL = re.compile("(?:[.!?]|…)(?:[\"')\\]]|”|’|»)*$".encode())
#: Words of a sentence that is not cut further, and the words between its cuts at least.
LONG, APART = 20, 4
#: Words whose hash a worker remembers, and the longest of them.
REMEMBERED, MAX_WORD = 200_000, 64
#: Bases of the two halves of a run's hash: odd, one below a multiple of four.
BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MAX_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its first n powers and their inverses, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        _POWERS.clear()
        for b in BASES:
            both = []
            for x in (b, pow(b, -1, 1 << 64)):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            _POWERS.append((both[0], both[1]))
    return [(p[:n], q[:n]) for p, q in _POWERS]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, word that each sentence or piece begins with, byte that it begins with) of a text in UTF-8."""
    words = data.lower().split()
    n = len(words)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    a = np.frombuffer(data, np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    at = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    stop = np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(a))[:n]
    last = a[stop - 1]
    ended = np.flatnonzero(ENDS[last])
    tails = [k for k in np.flatnonzero(MAYBE[last]).tolist() if TAIL.search(words[k])]
    lines = np.searchsorted(at, np.flatnonzero(a == 10))
    bounds = np.unique(np.concatenate(([0, n], ended + 1, np.array(tails, np.int64) + 1, lines)))
    first = bounds[:-1]
    if n > LONG and (np.diff(bounds) > LONG).any():
        pair = _mixed(h[:-1] * np.uint64(BASES[0]) + h[1:], 1)  # of words i and i + 1
        near = np.lib.stride_tricks.sliding_window_view(pair, 2 * APART + 1)
        mid = near[:, APART]
        i = np.flatnonzero((mid < near[:, :APART].min(axis=1)) & (mid <= near[:, APART + 1 :].min(axis=1))) + APART
        own = np.searchsorted(bounds, i, "right") - 1
        lo, hi = bounds[own], bounds[own + 1]
        i = i[(hi - lo > LONG) & (i - APART >= lo) & (i + APART + 1 < hi)]
        first = np.union1d(first, i + 1)
    start = at[first]
    start[0] = 0
    return h, first, start


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def sentences(text: str | None) -> list[str]:
    """The sentences and pieces of a text; the white space behind one belongs to it, so that they make up the text."""
    data = _bytes(text or "")
    _, _, start = _units(data)
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start, np.append(start[1:], len(data)), strict=True)] if len(start) else []


def spans(text: str | None, several: int = 2, least: int = 12) -> np.ndarray:
    """(runs, 4): first sentence, sentences in the run, upper and lower half of the hash (signed)."""
    h, first, _ = _units(_bytes(text or ""))
    m, n = len(first), len(h)
    if m < several:
        return np.empty((0, 4), np.int64)
    ends = np.append(first, n)
    i = np.arange(m - several + 1)
    j = np.maximum(i + several, np.searchsorted(ends, first[i] + least))
    i, j = i[j <= m], j[j <= m]
    a, b = first[i], ends[j]
    out = np.empty((len(i), 4), np.int64)
    out[:, 0], out[:, 1] = i, j - i
    for k, (power, inverse) in enumerate(_powers(n)):
        upto = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * power)))
        out[:, 2 + k] = _mixed((upto[b] - upto[a]) * inverse[a], k + 2).view(np.int64)
    return out


def span_table(rows: DataFrame, **run) -> DataFrame:
    """(row, at, n, hi, lo): every run of every text; rows: (row, text)."""
    names = ["row", "at", "n", "hi", "lo"]

    def batch(ids, found):
        m = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        row = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(m[:, 0].astype(np.int32)), pa.array(m[:, 1].astype(np.int32)), pa.array(m[:, 2]), pa.array(m[:, 3])], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, held = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                mine = spans(t.as_py(), **run)
                if len(mine):
                    ids.append(k)
                    found.append(mine)
                    held += len(mine)
                if held > 200_000:
                    yield batch(ids, found)
                    ids, found, held = [], [], 0
            yield batch(ids, found)

    return rows.select("row", "text").mapInArrow(work, "row long, at int, n int, hi long, lo long")


def covered(rows: DataFrame, **run) -> DataFrame:
    """(row, gone): the sentence numbers that non-first spans cover, for the rows that have any; rows: (id, tie, row, text)."""
    table = materialize(span_table(rows, **run), "spans")
    again = materialize(table.groupBy("lo").agg(F.count("*").alias("c")).filter("c > 1").select("lo"), "again")
    hits = materialize(table.join(again, "lo"), "hits")
    release(table), release(again)
    hits_at = hits.join(rows.select("row", "id", "tie"), "row")
    where = place("id", "tie", "row", "at")
    shared = hits_at.groupBy("hi", "lo").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last")
    # A table of its own, so that a hot span's side of the join can be split.
    shared = materialize(shared.select("hi", "lo", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")), "shared")
    later = hits.join(shared, ["hi", "lo"]).filter((F.col("row") != F.col("first_row")) | (F.col("at") != F.col("first_at")))
    each = later.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("s"))
    gone = materialize(each.groupBy("row").agg(F.collect_set("s").alias("gone")), "gone")
    release(hits), release(shared)
    return gone


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **run) -> DataFrame:
    """docs with the repeated sentences cut out of the text, plus ``n_sentences`` and ``n_removed``."""
    names = docs.columns
    total, lost, row, tie, cut = free_names(names, "n_sentences", "n_removed", "row", "tie", "gone")
    table = numbered(docs, row, tie)
    gone = covered(table.select(F.col(doc_id).alias("id"), F.col(tie).alias("tie"), F.col(row).alias("row"), F.col(text).alias("text")), **run)
    both = table.join(gone.select(F.col("row").alias(row), F.col("gone").alias(cut)), row, "left").select(*[F.col(f"`{c}`") for c in names], cut)
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, cuts = [], [], []
            for t, g in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                data = _bytes(t or "")
                _, _, start = _units(data)
                drop = set(g or ())
                if drop:
                    stop = np.append(start[1:], len(data)).tolist()
                    t = b"".join(data[a:z] for k, (a, z) in enumerate(zip(start.tolist(), stop, strict=True)) if k not in drop).decode("utf-8", "surrogatepass")
                texts.append(t)
                counts.append(len(start))
                cuts.append(len(drop))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32()), pa.array(cuts, pa.int32())], [*names, total, lost])

    schema = StructType(list(docs.schema.fields)).add(total, IntegerType()).add(lost, IntegerType())
    return both.mapInArrow(work, schema)
