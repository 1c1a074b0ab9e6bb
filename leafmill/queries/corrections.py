"""Misread words put right by edits that were counted on other words.

Known words of an even length teach: each is misread in one place, in five ways.  Known words of an odd length are misread in up to
three places at once and put right with what was counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import channel, lexicon
from leafmill.queries.catalog import query
from leafmill.queries.standard import _LEX, _r, _t
from leafmill.staging import materialize

#: What stands there and what is read: how words are misread here; the operators do not see this list.
NOISE = [("e", "c"), ("n", "ri"), ("th", "m"), ("o", "c"), ("s", "")]


def _first(word: F.Column, a: str, b: str) -> F.Column:
    return F.regexp_replace(word, f"^(.*?){a}", f"$1{b}")


def _known(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(lexicon, its words of three uses and more)."""
    lex = materialize(lexicon.lexicon(_t(spark, sf_dir, "documents")), "lexicon")
    return lex, lex.filter("n >= 3")


def learned(known: DataFrame) -> DataFrame:
    """The channel of what the words of an even length were misread as."""
    even = known.filter("length(word) % 2 = 0")
    pair = F.explode(F.array(*[F.when(F.contains("word", F.lit(a)), _first(F.col("word"), a, b)) for a, b in NOISE])).alias("got")
    pairs = even.select("n", F.col("word").alias("truth"), pair).filter("got is not null")
    counts = channel.single_edits(pairs).groupBy("alpha", "beta").agg(F.sum("n").alias("n"))
    return channel.channel(counts, channel.gram_counts(even))


def misread(known: DataFrame) -> DataFrame:
    """(lang, truth, got) of the words of an odd length; those that are misread as a known word are left out."""
    got = F.col("word")
    for a, b in NOISE:
        got = _first(got, a, b)
    odd = known.filter("length(word) % 2 = 1 and length(word) >= 5").select("lang", F.col("word").alias("truth"), got.alias("got")).filter("got <> truth")
    return odd.join(known.select("lang", F.col("word").alias("got")), ["lang", "got"], "left_anti")


def _lcp(a: str, b: str, side: str, most: str) -> str:
    return f"len(list_filter(range(1, {most} + 1), lambda i: {side}({a}, i) = {side}({b}, i)))"


_SQL_NOISE = ", ".join(f"('{a}', '{b}')" for a, b in NOISE)
_ALL = "word"
for _a, _b in NOISE:
    _ALL = f"regexp_replace({_ALL}, '{_a}', '{_b}')"
_STATE = """s{k} as (select lang, got, pos, out, max(lp) lp from (
    select lang, got, i + k pos, out || substr(got, pos + 1, i - pos) || alpha out, p.lp + ch.lp lp
    from (select *, unnest(range(pos, length(got) + 1)) i from s{p}) p, unnest([0, 1, 2]) t(k), ch where i + k <= length(got) and substr(got, i + 1, k) = beta) group by all)"""
#: ch: the channel; bad: misread words; sc: candidates with scores, each script tried without any pruning.
CORRECTED = f"""{_LEX}, known as (select * from lex where n >= 3), ev as (select * from known where length(word) % 2 = 0),
  pr as (select n, word truth, regexp_replace(word, a, b) got from ev, (values {_SQL_NOISE}) t(a, b) where contains(word, a)),
  p1 as (select *, {_lcp('truth', 'got', 'left', 'least(length(truth), length(got))')} p from pr),
  p2 as (select *, {_lcp('truth', 'got', 'right', '(least(length(truth), length(got)) - p)')} s from p1),
  ed as (select substr(truth, p + 1, length(truth) - p - s) alpha, substr(got, p + 1, length(got) - p - s) beta, sum(n)::bigint n from p2 group by all),
  gr as (select substr(word, i, k) alpha, sum(n) uses from (select *, unnest(range(1, length(word) + 1)) i from ev), unnest([1, 2]) t(k) where i + k - 1 <= length(word) group by all
    union all select '', sum(n * (length(word) + 1)) from ev),
  ch as (select alpha, beta, ln((n + 0.5e0) / (coalesce(uses, 0) + 1.5e0)) lp from ed left join gr using (alpha) where n >= 2 and alpha <> beta and length(alpha) <= 2 and length(beta) <= 2),
  bad as (select * from (select lang, word truth, {_ALL} got from known where length(word) % 2 = 1 and length(word) >= 5) b where got <> truth and not exists (select 1 from known k where k.lang = b.lang and k.word = b.got)),
  s0 as (select distinct bad.lang, got, 0 pos, '' out, 0.0e0 lp from bad where length(got) >= 4), {", ".join(_STATE.format(k=k, p=k - 1) for k in (1, 2, 3))},
  sc as (select e.lang, got, word cand, round(max(e.lp + lex.logf - coalesce(g.logf, -18.0e0)), 6) score from (select *, out || substr(got, pos + 1) cand from (select * from s1 union all select * from s2 union all select * from s3)) e
    join lex on lex.lang = e.lang and lex.word = e.cand left join (select lang gl, word gw, logf from lex) g on gl = e.lang and gw = e.got where cand <> got group by all),
  k as (select *, row_number() over w r, round(score - lead(score) over w, 6) lead from sc window w as (partition by lang, got order by score desc, cand)),
  fx as (select * from k where r = 1 and score >= -1 and (lead is null or lead >= 1))"""


@query("noisy_corrections", f"with {CORRECTED} select lang, got, cand, score, lead from fx")
def noisy_corrections(spark, sf_dir):
    """Best word up to three counted edits away, where it leads the next one."""
    return _fixes(spark, sf_dir)[1]


def _fixes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lex, known = _known(spark, sf_dir)
    bad = misread(known)
    found = channel.candidates(channel.misread(bad.select("lang", F.col("got").alias("word")), known), learned(known), lex, floor=-18.0)
    return bad, channel.corrections(found)


@query(
    "noisy_audit",
    f"""with {CORRECTED} select b.lang, count(*)::bigint n, (count(*) filter (where cand = truth))::bigint n_right, (count(*) filter (where cand <> truth))::bigint n_wrong, (count(*) filter (where cand is null))::bigint n_left,
  (count(*) filter (where score is not null and lead is null))::bigint n_alone from bad b left join fx on fx.lang = b.lang and fx.got = b.got group by b.lang""",
)
def noisy_audit(spark, sf_dir):
    """Corrections of words misread in up to three places: right, wrong, left as they are, and without a rival."""
    bad, fixes = _fixes(spark, sf_dir)
    j = bad.join(fixes, ["lang", "got"], "left")
    n = lambda c: F.count(F.when(c, 1))
    return j.groupBy("lang").agg(
        F.count("*").alias("n"), n(F.col("cand") == F.col("truth")).alias("n_right"), n(F.col("cand") != F.col("truth")).alias("n_wrong"),
        n(F.col("cand").isNull()).alias("n_left"), n(F.col("score").isNotNull() & F.col("lead").isNull()).alias("n_alone"),
    )


@query("learned_edits", f"with {CORRECTED} select alpha, beta, round(lp, 6) lp from ch")
def learned_edits(spark, sf_dir):
    """Log probabilities of the edits that the misread words of an even length teach."""
    return learned(_known(spark, sf_dir)[1]).select("alpha", "beta", _r("lp").alias("lp"))
