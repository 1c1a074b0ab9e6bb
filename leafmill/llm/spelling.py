"""Spelling variants: words one code point apart, grouped under the more frequent ones, without making pairs.

Replacements: a word stands in one group for each of its places, the group of all words with its (place, prefix, suffix), named by
the word with a wildcard in that place.  Two words that differ by one replaced code point share exactly one group, so a word's near
words are the sizes of its groups less one each, and its best one there is the group's first word, or the second where the
word itself is first.  Insertions and deletions: each word less one code point (runs of one character once) meets the
vocabulary; a hit counts for both sides.  The contributions are summed by word.

Words that hold the form ``form`` stand under a near word at least ``ratio`` times as frequent; ``root`` follows forms to the end.
Frequencies grow along the way, so there are no circles and a chain has at most log2(largest / least) links; the roots come by
doubling the reach of each link, in as many rounds as that number has binary digits.

Plan: one shuffle of the words' occurrences (counted before it), one of the vocabulary's wildcards, one of its deletions; a group
has as many words as the alphabet has characters at most.  Wildcards of words longer than ``LONG`` go as digests.

Defined results: null texts have no words; a null id counts as the empty string in the check sum; repeated rows count each; an
empty table gives an empty table; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.staging import materialize, release

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The wildcard, which no word holds, and the length beyond which wildcards go as digests.
HOLE, LONG = "*", 48


def runs_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: str = LETTERS, every: int = 97) -> DataFrame:
    """(word): every run of letters, A-Z lower-cased; where ``every`` divides the CRC-32 of "<id>:<run>", one code point is left out."""
    found = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(letters), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n), as a written table."""
    counts = runs.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(counts.filter(F.col("n") >= min_count), "vocabulary")


def _less(word: Column, i: Column, put: str = "") -> Column:
    return F.concat(F.substring(word, F.lit(1), i), F.lit(put), F.substring(word, i + 2, F.length(word)))


def _rank(n: Column, word: Column) -> Column:
    """Least for the best word: most frequent, then first by code points."""
    return F.struct((-n).alias("less"), word.alias("word"))


def _replaced(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best) of each word in each group of more than one."""
    place = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    cards = vocab.select("word", "n", place.alias("i")).withColumn("card", _less(F.col("word"), F.col("i"), HOLE))
    cards = cards.select("word", "n", F.when(F.length("word") <= LONG, F.col("card")).otherwise(F.sha2("card", 256)).alias("card"))
    w = Window.partitionBy("card").orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.nth_value(_rank(F.col("n"), F.col("word")), 2).over(w)
    first = F.first(_rank(F.col("n"), F.col("word"))).over(w)
    held = cards.select("word", F.count("*").over(w).alias("size"), first.alias("one"), top.alias("two")).filter("size > 1")
    best = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    return held.select("word", (F.col("size") - 1).alias("near"), best.alias("best"))


def _indels(vocab: DataFrame, min_chars: int) -> DataFrame:
    """(word, near, best) of both sides of each deletion that is a word."""
    place = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    cut = vocab.filter(F.length("word") > min_chars).select("word", "n", place.alias("i"))
    # Of a run of one character the last one is left out, so that no deletion comes twice.
    cut = cut.filter(F.substring(F.col("word"), F.col("i") + 1, F.lit(1)) != F.substring(F.col("word"), F.col("i") + 2, F.lit(1)))
    cut = cut.select(F.col("word").alias("long"), F.col("n").alias("n_long"), _less(F.col("word"), F.col("i")).alias("word"))
    hit = cut.join(vocab, "word")
    sides = F.explode(
        F.array(
            F.struct(F.col("long").alias("word"), _rank(F.col("n"), F.col("word")).alias("best")),
            F.struct(F.col("word").alias("word"), _rank(F.col("n_long"), F.col("long")).alias("best")),
        )
    )
    return hit.select(sides.alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")


def near_words(vocab: DataFrame, min_chars: int = 5) -> DataFrame:
    """(word, n_near, best): for words that have near words, their number and the best one (less: its count negated; word)."""
    both = _replaced(vocab).unionByName(_indels(vocab, min_chars))
    return both.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: (word, form) with its links followed to the end."""
    reach = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if reach.join(on, "root", "left_semi").isEmpty():
            return reach
        further = materialize(reach.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
        release(reach)
        reach = further


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocab = vocabulary(runs_of(docs, text, doc_id, every=every), min_chars, min_count)
    seen = vocab.join(near_words(vocab, min_chars), "word", "left")
    form_n = -F.col("best.less")
    far = form_n >= ratio * F.col("n")
    seen = seen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.word")).alias("form"), F.when(far, form_n).alias("form_n"))
    seen = materialize(seen, "forms")
    ends = roots(seen.filter("form is not null").select("word", "form"))
    return seen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
