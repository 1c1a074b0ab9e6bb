"""Word and character models built from a corpus, and what they say about words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import ranks

WORD = r"\p{L}+"


def words(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per word of letters, lower-cased."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return docs.select(*keep, F.explode(found).alias("word"))


def lexicon(docs: DataFrame, group: str = "lang", top: int = 30_000) -> DataFrame:
    """(group, word, n, rank, logf): the most frequent words of each group with their log share; ties by word."""
    counts = words(docs, group).groupBy(group, "word").agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("total"))
    best = ranks.top_ranked(counts, [group], [F.desc("n"), F.col("word")], top, ["word"])
    return best.join(total, group).select(group, "word", "n", F.col("rank").cast("long").alias("rank"), F.log(F.col("n") / F.col("total")).alias("logf"))


def endorsed(word, logf):
    """A word the lexicon vouches for: two letters when frequent, three when known at all; unseen words have -18."""
    f, n = F.coalesce(logf, F.lit(-18.0)), F.length(word)
    return ((n >= 2) & (f > -12.0)) | ((n >= 3) & (f > -15.5))


def ngram_counts(docs: DataFrame, size: int, group: str = "lang") -> DataFrame:
    """(group, gram, n): character n-grams inside words that are closed by marks on both sides; counted per word first."""
    per = words(docs, group).groupBy(group, "word").agg(F.count("*").alias("m"))
    pad = F.concat(F.lit("^" * (size - 1)), F.col("word"), F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i")
    grams = per.select(group, "m", pad.alias("p"), at).select(group, "m", F.substr("p", F.col("i"), F.lit(size)).alias("gram"))
    return grams.groupBy(group, "gram").agg(F.sum("m").alias("n"))


def ngram_model(docs: DataFrame, size: int, group: str = "lang") -> DataFrame:
    """(group, gram, n, logp): add-one smoothed log probability of the last character given those before."""
    counts = ngram_counts(docs, size, group).withColumn("head", F.left("gram", F.lit(size - 1)))
    alphabet = counts.groupBy(group).agg(F.countDistinct(F.right("gram", F.lit(1))).alias("v"))
    heads = counts.groupBy(group, "head").agg(F.sum("n").alias("total"))
    both = counts.join(heads, [group, "head"]).join(alphabet, group)
    return both.select(group, "gram", "n", F.log((F.col("n") + 1) / (F.col("total") + F.col("v"))).alias("logp"))
