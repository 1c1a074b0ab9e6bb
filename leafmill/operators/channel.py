"""Correction of misread words by a noisy channel: learned edits undone, scored with the words' frequencies.

An edit is (alpha, beta): what stood there and what was read.  Its cost comes from counts.  A word that the lexicon does not know is
rewritten from left to right: a state is a word, the place reached in it, what is written so far and its log probability; an
edit undone further on makes a new state.  Each round is a join of the states' spans with the edits on what was read; a state lives
on only if the lexicon has words that begin with what is written (a semi-join with the table of prefixes), and of a word's states the
``beam`` likeliest stay.  So a script of up to ``max_edits`` edits at separate places is tried once, and pruning loses none.

Everything is by (group, word), words once however often they occur; states are bounded by beam x words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.staging import materialize


def _common(a: Column, b: Column, most: Column, side) -> Column:
    """How many characters two words share at one side, ``most`` at best."""
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: side(a, i) == side(b, i)))


def single_edits(pairs: DataFrame, truth: str = "truth", got: str = "got") -> DataFrame:
    """pairs with alpha and beta: what is left of both words without their common beginning and, of the rest, their common end."""
    a, b = F.col(truth), F.col(got)
    p = pairs.withColumn("_p", _common(a, b, F.least(F.length(a), F.length(b)), F.left))
    s = p.withColumn("_s", _common(a, b, F.least(F.length(a), F.length(b)) - F.col("_p"), F.right))
    middle = lambda w: F.substring(w, F.col("_p") + 1, F.length(w) - F.col("_p") - F.col("_s"))
    return s.withColumn("alpha", middle(a)).withColumn("beta", middle(b)).drop("_p", "_s")


def gram_counts(words: DataFrame, n: str = "n", longest: int = 2) -> DataFrame:
    """(alpha, n): how often each run of up to ``longest`` characters, and each place between two, stands in the words."""
    place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")
    size = F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")
    g = words.select("word", n, place).select("word", n, "i", size).filter(F.col("i") + F.col("k") - 1 <= F.length("word"))
    grams = g.groupBy(F.substring(F.col("word"), F.col("i"), F.col("k")).alias("alpha")).agg(F.sum(n).alias("n"))
    gaps = words.agg(F.sum(F.col(n) * (F.length("word") + 1)).alias("n")).select(F.lit("").alias("alpha"), "n")
    return grams.unionByName(gaps)


def channel(edits: DataFrame, grams: DataFrame, min_count: int = 2, smooth: float = 0.5, per_site: int = 40, longest: int = 2) -> DataFrame:
    """(alpha, beta, lp): the likeliest ``per_site`` edits of each text read; edits (alpha, beta, n), grams (alpha, n)."""
    e = edits.filter((F.col("n") >= min_count) & (F.col("alpha") != F.col("beta")) & (F.length("alpha") <= longest) & (F.length("beta") <= longest))
    e = e.join(grams.withColumnRenamed("n", "uses"), "alpha", "left")
    e = e.withColumn("lp", F.log((F.col("n") + smooth) / (F.coalesce("uses", F.lit(0)) + smooth + 1.0)))
    by = Window.partitionBy("beta").orderBy(F.desc(F.round("lp", 9)), "alpha")
    return e.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= per_site).select("alpha", "beta", "lp")


def prefixes(lexicon: DataFrame, group: str = "lang") -> DataFrame:
    """(group, prefix): every beginning of every word, the empty one included."""
    return lexicon.select(group, F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"), "word").select(group, F.left("word", F.col("i")).alias("prefix")).distinct()


def misread(words: DataFrame, known: DataFrame, group: str = "lang", min_len: int = 4) -> DataFrame:
    """(group, got): the words, once each, that may be wrong: of ``min_len`` characters, not known, with letters, no more digits than letters."""
    own = words.select(group, F.col("word").alias("got")).distinct()
    digits, letters = F.length(F.regexp_replace("got", "[^0-9]", "")), F.length(F.regexp_replace("got", r"[^\p{L}]", ""))
    own = own.filter((F.length("got") >= min_len) & (letters > 0) & (digits <= letters))
    return own.join(known.select(group, F.col("word").alias("got")), [group, "got"], "left_anti")


def candidates(bad: DataFrame, edits: DataFrame, lexicon: DataFrame, group: str = "lang", max_edits: int = 3, beam: int = 400, weight: float = 1.0, floor: float = 0.0, longest: int = 2) -> DataFrame:
    """(group, got, cand, score): every lexicon word that up to ``max_edits`` undone edits make of each bad word.

    bad (group, got), edits (alpha, beta, lp), lexicon (group, word, logf).  score: the best script's log probability, and ``weight``
    times how much more frequent the candidate is than the word read (``floor`` where the lexicon lacks that).
    """
    lex = lexicon.select(group, "word", "logf")
    begins, edits = materialize(prefixes(lex, group), "prefixes"), materialize(edits.select("alpha", "beta", "lp"), "channel")
    base = bad.join(lex.select(group, F.col("word").alias("got"), F.col("logf").alias("base")), [group, "got"], "left")
    state = base.select(group, "got", F.coalesce("base", F.lit(floor)).alias("base"), F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0.0).alias("lp"))
    scored = []
    for _ in range(max_edits):
        spans = state.select("*", F.explode(F.sequence(F.col("at"), F.length("got"))).alias("i"))
        spans = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("k")).filter(F.col("i") + F.col("k") <= F.length("got"))
        spans = spans.withColumn("beta", F.substring(F.col("got"), F.col("i") + 1, F.col("k")))
        met = spans.join(edits.withColumnRenamed("lp", "cost"), "beta")
        out = F.concat("out", F.substring(F.col("got"), F.col("at") + 1, F.col("i") - F.col("at")), "alpha")
        new = met.select(group, "got", "base", (F.col("i") + F.col("k")).alias("at"), out.alias("out"), (F.col("lp") + F.col("cost")).alias("lp"))
        new = new.join(begins.withColumnRenamed("prefix", "out"), [group, "out"], "left_semi")
        new = new.groupBy(group, "got", "base", "at", "out").agg(F.max("lp").alias("lp"))
        by = Window.partitionBy(group, "got").orderBy(F.desc(F.round("lp", 9)), "out", "at")
        state = materialize(new.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= beam).drop("_k"), "states")
        ends = state.withColumn("cand", F.concat("out", F.substring(F.col("got"), F.col("at") + 1, F.length("got"))))
        hit = ends.join(lex.withColumnRenamed("word", "cand"), [group, "cand"]).filter("cand <> got")
        scored.append(hit.select(group, "got", "cand", (F.col("lp") + weight * (F.col("logf") - F.col("base"))).alias("score")))
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    return every.groupBy(group, "got", "cand").agg(F.max("score").alias("score"))


def corrections(cands: DataFrame, group: str = "lang", min_gain: float = -1.0, margin: float = 1.0) -> DataFrame:
    """(group, got, cand, score, lead): each word's best candidate, if it gains ``min_gain`` and leads the next other word by ``margin``.

    Candidates that differ from the best in letter case only are no rivals; lead is null without a rival.
    """
    word = Window.partitionBy(group, "got")
    r = cands.withColumn("_s", F.round("score", 6)).withColumn("_k", F.row_number().over(word.orderBy(F.desc("_s"), "cand")))
    r = r.withColumn("_top", F.first("cand").over(word.orderBy(F.desc("_s"), "cand")))
    rival = F.max(F.when(F.lower("cand") != F.lower("_top"), F.col("_s"))).over(word)
    r = r.withColumn("lead", F.round(F.col("_s") - rival, 6)).filter("_k = 1").filter((F.col("_s") >= min_gain) & (F.col("lead").isNull() | (F.col("lead") >= margin)))
    return r.select(group, "got", "cand", F.col("_s").alias("score"), "lead")


def corrected(words: DataFrame, fixes: DataFrame, group: str = "lang", text: str = "text", vouched: DataFrame | None = None) -> DataFrame:
    """words with the text put right and ``corrected_from`` where it changed; marks around the word stay.

    fixes: as ``corrections`` gives them.  vouched (page, word): words that their page vouches for stay.
    """
    ends = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    own = words.withColumn("got", F.regexp_extract(text, ends, 2))
    both = own.join(fixes.select(group, "got", "cand"), [group, "got"], "left")
    if vouched is not None:
        both = both.join(vouched.select("page", F.col("word").alias("got"), F.lit(True).alias("_stays")), ["page", "got"], "left").withColumn("cand", F.when(F.col("_stays").isNull(), F.col("cand"))).drop("_stays")
    new = F.when(F.col("cand").isNotNull(), F.concat(F.regexp_extract(text, ends, 1), F.col("cand"), F.regexp_extract(text, ends, 3)))
    return both.withColumn("corrected_from", F.when(new.isNotNull(), F.col(text))).withColumn(text, F.coalesce(new, F.col(text))).drop("got", "cand")
