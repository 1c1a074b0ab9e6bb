"""Quality rules over lines that many documents of a host share, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, digits as 0, runs of blanks as one, ends trimmed) and hashed; a line's frequency is the
number of distinct documents of its host that hold it.  A line is above the limit if more than ``share`` of the host's documents
hold it, and more than ``least`` of them.  Such lines go.  A document is depleted, and rejected, if lines went and fewer than
``min_words`` words or less than half of them are left.  The limit follows a host's size, so it means the same at every scale.

Documents of one host are told apart by their texts: exact copies count once, for a document is not boilerplate because it was
copied as a whole (that is the dedup's business).

Plan: the lines of all documents go, as hashes, through one distinct (which combines before it shuffles) and one count; only
lines in more than ``least`` documents are kept as a table.  What is above the limit is broadcast while it has at most
``SMALL`` rows, and joined by key beyond, where AQE splits hot lines.  Texts are not shuffled by ``judge``.

Base rules (``base_quality``): words are runs of characters outside ASCII blanks; a document fails with fewer than ten words, or
with more than a fifth of its words in five-word windows that occur twice or more in it.

Defined results: a null text is empty, has no words and fails; a null host is a host of its own; rows stay as they are, repeated
ones and null ids included; an empty table gives an empty table; further columns do not matter, whatever their
names.  Lines and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.rows import free_names, numbered
from leafmill.staging import materialize

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window that is looked for twice.
WINDOW = 5
#: Lines above the limit that are broadcast at most (three small columns each).
SMALL = 200_000


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    The arrays stand in projections of their own and are named more than once, so that the optimizer works each out once.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    # A line without a word is empty once its ends are trimmed of blanks.
    lines = F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    df = docs.withColumns({"_w": F.transform(F.filter(F.split(own, BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w)), "_l": lines})
    windows = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, WINDOW)]))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(_without(own, BLANK_CHARS)).cast("long"),
            "n_symbols": (F.length(own) - F.length(_without(own, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_g": windows,
        }
    ).drop("_w", "_l")
    # Most texts repeat no window; only the others are sorted by (hash, place).
    placed = F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(placed))).drop("_g")
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_s")
    # Each window covers its words up to where the next one begins.
    covered = F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - x, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """The normalised form of each line, empty ones included, in the text's order."""
    even = F.translate(F.coalesce(text, F.lit("")), UPPER + "123456789" + "\t\x0b\x0c\r", LOWER + "0" * 9 + " " * 4)
    return F.transform(F.split(F.regexp_replace(even, " {2,}", " "), "\n"), lambda x: F.trim(x))


def _hashed(text: Column) -> Column:
    """(line, words) of each line that holds a word."""
    held = F.filter(normal_lines(text), lambda x: x != "")
    return F.transform(held, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))


def frequent_lines(docs: DataFrame, share: float = 0.05, least: int = 10, text: str = "text", host: str = "source") -> DataFrame:
    """(host, line, n_docs, host_docs): lines above the limit, as a written table."""
    own = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    held = F.array_distinct(F.transform(_hashed(F.col("text")), lambda x: x["line"]))
    # The empty line stands for the document itself, so that one pass counts a host's documents as well.
    each = own.select("host", F.xxhash64("text").alias("doc"), F.explode_outer(F.concat(F.array(F.lit(None).cast("long")), held)).alias("line"))
    counts = each.distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    counts = materialize(counts.filter(F.col("line").isNull() | (F.col("n_docs") > least)), "lines")
    sizes = counts.filter("line is null").select(F.col("host").alias("_host"), F.col("n_docs").alias("host_docs"))
    found = counts.filter("line is not null").join(sizes, F.col("host").eqNullSafe(F.col("_host")))
    return materialize(found.filter(F.col("n_docs") > share * F.col("host_docs")).select("host", "line", "n_docs", "host_docs"), "above")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _judged(docs: DataFrame, above: DataFrame, keys: list[str], min_words: int, max_removed: float) -> DataFrame:
    """keys, BASE, n_lines_removed, n_words_removed, kept of every row of docs, which has text, host and the keys."""
    # The number of a row also keeps the optimizer from pushing a later filter, with all the arrays behind it, below this point.
    rows = base_quality(docs, "text").select("host", *keys, *BASE, _hashed(F.col("text")).alias("_lines"), F.monotonically_increasing_id().alias("_id"))
    lines = rows.select("host", "_id", *keys, *BASE, F.explode_outer("_lines").alias("_x")).select("*", F.col("_x.line").alias("line"), F.col("_x.words").alias("words")).drop("_x")
    over = above.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    if above.count() <= SMALL:
        over = F.broadcast(over)
    hit = lines.join(over, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")), "left")
    out = hit.groupBy("_id", *keys, *BASE).agg(
        F.count("_line").alias("n_lines_removed"),
        F.coalesce(F.sum(F.when(F.col("_line").isNotNull(), F.col("words"))), F.lit(0)).alias("n_words_removed"),
    )
    left = F.col("n_words") - F.col("n_words_removed")
    depleted = (F.col("n_lines_removed") > 0) & ((left < min_words) | (F.col("n_words_removed") > max_removed * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_id")


def judge(docs: DataFrame, share: float = 0.05, least: int = 10, min_words: int = 10, max_removed: float = 0.5, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, the base columns, n_lines_removed, n_words_removed, kept) of every row."""
    above = frequent_lines(docs, share, least, text, host)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    return _judged(own, above, ["doc_id"], min_words, max_removed)


def clean(docs: DataFrame, share: float = 0.05, least: int = 10, min_words: int = 10, max_removed: float = 0.5, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their columns; their lines above the limit are gone from the text.

    Rows are numbered in a table written once; the texts of kept documents meet the hosts' lines only where a line goes.
    """
    above = frequent_lines(docs, share, least, text, host)
    row, tie, out = free_names(docs.columns, "_row", "_tie", "_gone")
    rows = numbered(docs, row, tie, "quality")
    whole, where = F.col(f"`{text}`"), F.col(f"`{host}`")
    own = rows.select(F.col(row).alias("_row"), whole.alias("text"), where.alias("host"))
    kept = materialize(_judged(own, above, ["_row"], min_words, max_removed).filter("kept").select(F.col("_row").alias(row), "n_lines_removed"), "kept")
    same = rows.join(kept.filter("n_lines_removed = 0").select(row), row, "left_semi").select(docs.columns)
    cut = rows.join(kept.filter("n_lines_removed > 0").select(row), row, "left_semi")
    # Lines of the texts to cut meet those above the limit, by place.
    at = cut.select(F.col(row).alias("_at"), where.alias("host"), F.posexplode(normal_lines(whole)).alias("place", "line")).filter("line <> ''")
    gone = at.join(above.select(F.col("host").alias("_host"), F.col("line").alias("_line")), F.col("host").eqNullSafe(F.col("_host")) & (F.xxhash64("line") == F.col("_line")))
    gone = gone.groupBy(F.col("_at").alias(row)).agg(F.collect_set("place").alias(out))
    left = F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains(out, i))
    done = cut.join(gone, row).withColumn(text, F.array_join(left, "\n")).select(docs.columns)
    return same.unionByName(done)
