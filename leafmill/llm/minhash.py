"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles are hashed once.  The upper bits of a hash choose its bin, the rest is its value, and a bin keeps its least
value.  One sorted array does the binning: with a sentinel behind every bin's possible values, the first element of each run of
equal bins is the bin's minimum, or the sentinel where the bin is empty.  An empty bin borrows by optimal densification: it
walks its own fixed random sequence of bins until a filled one.  Of each bin's value the low ``BITS`` bits are stored, eight
bins in a 64-bit word; the likeness of two fingerprints is the share of equal bins, corrected for bins equal by chance.

Words are runs of characters outside ASCII blanks, A-Z lower-cased; shingles are of five words, or all words of a shorter text.

Defined results: a null text is empty; a text without words has the all-zero fingerprint, like only to its own kind (likeness 1)
and 0 to any other; equal texts have equal fingerprints; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins, bits kept of each, and where a hash's value ends and its bin begins.
BINS, BITS = 256, 8
SHIFT = 63 - 8
#: Steps that an empty bin walks with replacement, some at first and more if those find nothing, before the last resort, its
#: order over all bins.
FIRST, PROBES = 3, 15
BLANKS = "[\\x20\\x09-\\x0D]+"


def _mixed(a: int, b: int) -> int:
    """A fixed 64-bit mix of two small numbers."""
    x = (a * 0x9E3779B97F4A7C15 + (b + 1) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * m & (1 << 64) - 1
    return x ^ x >> 33


def _constant(value: str, kind: str) -> Column:
    """A literal of a nested type (folded by the optimizer)."""
    return F.from_json(F.lit(value), kind)


def words_of(text: Column) -> Column:
    even = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(even, BLANKS), lambda w: w != "")


def with_bins(df: DataFrame, text: str, out: str, width: int = 5) -> DataFrame:
    """Adds ``out``: the array of BINS low-order values, densified; null for a text without words.

    The steps stand in projections of their own, so that each array is worked out once.
    """
    h, s, d = f"_{out}_words", f"_{out}_sorted", f"_{out}_dense"
    df = df.withColumn(h, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    # A shingle's hash is the hash of its words' hashes; behind the end there are no words, and the last shingle is the first.
    one = F.transform(
        F.slice(F.col(h), 1, F.greatest(F.size(h) - F.lit(width - 1), F.least(F.size(h), F.lit(1)))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, width)]).bitwiseAND(F.lit(2**63 - 1)),
    )
    sentinels = F.array(*[F.lit((b << SHIFT) | (1 << SHIFT) - 1) for b in range(BINS)])
    df = df.withColumn(s, F.when(F.size(h) > 0, F.sort_array(F.concat(one, sentinels))))
    first = F.filter(
        F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get(F.col(s), i - 1), SHIFT))
    )
    df = df.withColumn(d, F.transform(first, lambda x: x.bitwiseAND(F.lit((1 << SHIFT) - 1))))
    empty = F.lit((1 << SHIFT) - 1)
    probes = _constant(json.dumps([[_mixed(b, a) % BINS for a in range(PROBES)] for b in range(BINS)]), "array<array<int>>")
    salts = _constant(json.dumps([_mixed(b, 99) >> 2 for b in range(BINS)]), "array<bigint>")
    dense, f = F.col(d), f"_{out}_filled"
    df = df.withColumn(f, F.filter(F.transform(dense, lambda v, j: F.struct(v.alias("v"), j.alias("j"))), lambda x: x["v"] != empty))

    def walk(steps: Column) -> Column:
        return F.get(F.filter(F.transform(steps, lambda j: F.get(dense, j)), lambda v: v != empty), F.lit(0))

    def borrow(b: Column) -> Column:
        mine = F.get(probes, b)
        # Last resort: the filled bin that comes first in this bin's own order.
        order = F.transform(F.col(f), lambda x: F.struct(F.xxhash64(F.get(salts, b), x["j"]).alias("rank"), x["v"].alias("v")))
        return F.coalesce(walk(F.slice(mine, 1, FIRST)), walk(F.slice(mine, FIRST + 1, PROBES - FIRST)), F.array_min(order)["v"])

    full = F.transform(dense, lambda v, b: F.when(v != empty, v).otherwise(borrow(b)).bitwiseAND(F.lit((1 << BITS) - 1)))
    # The filled bins are named twice, so that the optimizer does not work them out anew for every bin.
    return df.withColumn(out, F.when(F.size(f) > 0, full)).drop(h, s, d, f)


def packed(bins: Column) -> Column:
    """Eight bins of eight bits in each word; no words in the text: zeros."""
    groups = F.sequence(F.lit(0), F.lit(BINS - 8), F.lit(8))

    def word(g: Column) -> Column:
        out = F.get(bins, g)
        for k in range(1, 8):
            out = out.bitwiseOR(F.shiftleft(F.get(bins, g + k), 8 * k))
        return out

    return F.when(bins.isNotNull(), F.transform(groups, word)).otherwise(F.array_repeat(F.lit(0).cast("long"), BINS // 8))


def hex_of(words: Column) -> Column:
    return F.lower(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: equal bins, less those that would be equal by chance."""

    def equal(x: Column, y: Column) -> Column:  # fold each byte of x ^ y onto its lowest bit: set where the bytes differ
        d = x.bitwiseXOR(y)
        for step, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step)).bitwiseAND(F.lit(mask))
        return F.lit(8) - F.bit_count(d)

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x)
    chance = 1 / 2**BITS
    share = (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    none = lambda w: F.forall(w, lambda x: x == 0)
    return F.when(none(a) | none(b), F.when(none(a) & none(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def add_fingerprint(df: DataFrame, text: str, out: str, width: int = 5) -> DataFrame:
    """Adds ``out``: the packed fingerprint of the text column as array<bigint>."""
    bins = f"_{out}_bins"
    return with_bins(df, text, bins, width).withColumn(out, packed(F.col(bins))).drop(bins)


def _segments(docs: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
    """docs with ``_seg``: ascending segments of the key of about equal row counts, null keys in segment 0; and the bounds.

    The bounds are quantiles over all rows; their number follows the session's shuffle partitions, so they stay a small table.
    """
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n)).first()[0]
    bounds = sorted(set(got or []))
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = bounds[step - 1 :: step], [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    if len(fine) == len(coarse):
        fine.append([])
    c, f = _constant(str(coarse), "array<bigint>"), _constant(str(fine), "array<array<bigint>>")
    k = F.col(key)
    at = F.size(F.filter(c, lambda b: b < k))
    seg = F.lit(1) + at * step + F.size(F.filter(F.get(f, at), lambda b: b < k))
    return docs.withColumn("_seg", F.when(k.isNull(), 0).otherwise(seg)), bounds


def with_next(docs: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the next row by descending key (after the last: the first).

    Null keys come last; rows of one key are ordered by a hash of the carried columns.  No window spans the table: rows meet in
    segments of the key, and each segment gets, as a row of its own, the head of the segment that follows.
    """
    cut, _ = _segments(docs, key)
    heads = cut.groupBy("_seg").agg(F.max(key).alias("_head")).collect()  # a row per segment, by the number of partitions
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    order = sorted(heads, key=lambda r: r["_seg"])
    after = [(order[i]["_seg"], order[i - 1]["_head"], order[i - 1]["_seg"] == 0) for i in range(len(order))]
    kind = dict(docs.dtypes)[key]
    lead = docs.sparkSession.createDataFrame(after, f"_to int, _head {kind}, _none boolean")
    lead = F.broadcast(lead.withColumn("_head", F.when(~F.col("_none"), F.col("_head"))))
    tie = F.xxhash64(*[F.col(c) for c in carry])
    rows = cut.withColumn("_tie", tie).withColumn("_real", F.lit(True))
    extra = rows.join(lead, F.col(key).eqNullSafe(F.col("_head"))).drop("_seg", "_head", "_none").withColumnRenamed("_to", "_seg")
    extra = extra.withColumn("_real", F.lit(False)).select(rows.columns)
    w = Window.partitionBy("_seg").orderBy(F.col("_real").desc(), F.col(key).desc_nulls_last(), "_tie")
    both = rows.unionByName(extra)
    for c in carry:
        both = both.withColumn(f"next_{c}", F.lead(F.struct(c)).over(w)[c])
    return both.filter("_real").drop("_seg", "_tie", "_real")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5) -> DataFrame:
    """(doc_id, fp): packed fingerprints of all rows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return add_fingerprint(own, "text", "fp", width).select("doc_id", "fp")


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5) -> DataFrame:
    """Each text beside its edited text, whose last third is the beginning of the next document (descending doc_id).

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_next(add_fingerprint(own, "text", "fp", width), "doc_id", ["text", "fp"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    own = own.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - third), F.left("next_text", third)))
    own = own.select("doc_id", "n_chars", "edited", "fp", "next_fp")
    own = add_fingerprint(own, "edited", "edited_fp", width)
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
