"""Queries over the standard tables; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import evidence, islands, lexicon, ranks, rows, vectors
from leafmill.queries.catalog import query

#: Date and time columns carry no zone; seconds since 1970 on both engines.
_WORDS = "unnest(regexp_extract_all(lower(text), '\\p{L}+'))"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(c: str = "*") -> Column:
    return F.count(c)


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _nearest_second(c: Column | str) -> Column:
    """Seconds since 1970, rounded to the nearest (halves to even) as the SQL's cast of epoch() does."""
    at = F.col(c) if isinstance(c, str) else c
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1000000).cast("long")


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


_LEX = f"""lex as (select lang, word, n, logf from (select lang, word, n, ln(n * 1.0e0 / sum(n) over (partition by lang)) logf,
  row_number() over (partition by lang order by n desc, word) r from
  (select lang, word, count(*) n from (select lang, {_WORDS} word from documents) group by all)) where r <= 30000)"""
_ENDORSED = "((length(w.word) >= 2 and coalesce(logf, -18) > -12) or (length(w.word) >= 3 and coalesce(logf, -18) > -15.5))"


@query(
    "quality_rollup",
    f"""with {_LEX}, w as (select doc_id, lang, {_WORDS} word from documents),
  d as (select w.doc_id, w.lang, count(*) n, count(*) filter (where {_ENDORSED}) e from w left join lex on lex.lang = w.lang and lex.word = w.word group by all)
  select d.lang, count(*)::bigint docs, round(avg(e * 1.0e0 / n), 6) mean_share, round(sum(e) * 1.0e0 / sum(n), 6) pooled_share,
  count(quality)::bigint labelled, round(avg(case when quality = 1 then e * 1.0e0 / n end), 6) good_share
  from d left join labels l on l.doc_id = d.doc_id group by rollup(d.lang)""",
)
def quality_rollup(spark, sf_dir):
    """Share of endorsed words per document, by language and over all, beside the labels."""
    docs = _t(spark, sf_dir, "documents")
    lex = lexicon.lexicon(docs).select("lang", "word", "logf")
    # Words are counted per document before the lexicon is met.
    w = lexicon.words(docs, "doc_id", "lang").groupBy("doc_id", "lang", "word").agg(_count().alias("m"))
    hit = F.when(lexicon.endorsed(F.col("word"), F.col("logf")), F.col("m")).otherwise(0)
    d = w.join(lex, ["lang", "word"], "left").groupBy("doc_id", "lang").agg(F.sum("m").alias("n"), F.sum(hit).alias("e"))
    share = F.col("e") / F.col("n")
    d = d.join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.rollup("lang").agg(
        _count().alias("docs"),
        _r(F.avg(share)).alias("mean_share"),
        _r(F.sum("e") / F.sum("n")).alias("pooled_share"),
        _count("quality").alias("labelled"),
        _r(F.avg(F.when(F.col("quality") == 1, share))).alias("good_share"),
    )


@query(
    "tok_counts",
    """with t as (select doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w from documents)
  select doc_id, len(string_split(text, chr(10)))::bigint n_lines, len(w)::bigint n_tokens, len(list_distinct(w))::bigint n_distinct,
  round(list_sum(list_transform(w, lambda x: length(x))) * 1.0e0 / nullif(len(w), 0), 6) mean_len,
  len(list_filter(w, lambda x: regexp_matches(x, '^[-=_*~]{3,}$')))::bigint n_rules from t""",
)
def tok_counts(spark, sf_dir):
    """Lines, tokens, distinct tokens, mean token length and tokens made of rule characters."""
    w = T.tokens(F.col("text"))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), w.alias("w"))
    total = F.aggregate(F.transform("w", F.length), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(
        "doc_id",
        F.col("lines").cast("long").alias("n_lines"),
        F.size("w").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        _r(F.try_divide(total, F.size("w"))).alias("mean_len"),
        F.size(F.filter("w", lambda x: x.rlike("^[-=_*~]{3,}$"))).cast("long").alias("n_rules"),
    )


@query(
    "fold_typographic",
    "select doc_id, md5(translate(text, '‘’“”–—' || chr(160) || '•', '''''\"\"-- *')) folded_md5, length(regexp_replace(text, '[^‘’“”–—' || chr(160) || '•]', '', 'g'))::bigint n_folded from documents",
)
def fold_typographic(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.fold_typographic(F.col("text"))).alias("folded_md5"), F.length(F.regexp_replace("text", f"[^{T.CURLY}]", "")).cast("long").alias("n_folded")
    )


@query("lexicon_top", f"with {_LEX} select lang, word, n::bigint n, round(logf, 6) logf from lex")
def lexicon_top(spark, sf_dir):
    return lexicon.lexicon(_t(spark, sf_dir, "documents")).select("lang", "word", "n", _r("logf").alias("logf"))


def _ngram_sql(size: int) -> str:
    pad = "^" * (size - 1)
    return f"""with w as (select lang, word, count(*) m from (select lang, {_WORDS} word from documents) group by all),
  g as (select lang, substr('{pad}' || word || '$', i, {size}) gram, sum(m) n from (select *, unnest(range(1, length(word) + 2)) i from w) group by all),
  v as (select lang, count(distinct right(gram, 1)) v from g group by all), h as (select lang, left(gram, {size - 1}) head, sum(n) total from g group by all)
  select g.lang, gram, n::bigint n, round(ln((n + 1) * 1.0e0 / (total + v)), 6) logp from g join h on h.lang = g.lang and head = left(gram, {size - 1}) join v on v.lang = g.lang"""


@query("bigram_model", _ngram_sql(2))
def bigram_model(spark, sf_dir):
    return lexicon.ngram_model(_t(spark, sf_dir, "documents"), 2).withColumn("logp", _r("logp"))


@query("trigram_model", _ngram_sql(3))
def trigram_model(spark, sf_dir):
    return lexicon.ngram_model(_t(spark, sf_dir, "documents"), 3).withColumn("logp", _r("logp"))


@query(
    "lm_baseline",
    f"with m as ({_ngram_sql(3)}) select lang, round(sum(n * logp) / sum(n), 5) baseline, sum(n)::bigint n from m group by all",
)
def lm_baseline(spark, sf_dir):
    """Mean log probability per character that a language's own model gives its own text."""
    m = trigram_model(spark, sf_dir)
    return m.groupBy("lang").agg(_r(F.sum(F.col("n") * F.col("logp")) / F.sum("n"), 5).alias("baseline"), F.sum("n").alias("n"))


@query(
    "endorsed_words",
    f"""with {_LEX}, w as (select doc_id, lang, {_WORDS} word from documents) select doc_id, count(*)::bigint n_words, count(*) filter (where {_ENDORSED})::bigint n_endorsed
  from w left join lex on lex.lang = w.lang and lex.word = w.word group by all""",
)
def endorsed_words(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    w = lexicon.words(docs, "doc_id", "lang").groupBy("doc_id", "lang", "word").agg(_count().alias("m"))
    j = w.join(lexicon.lexicon(docs).select("lang", "word", "logf"), ["lang", "word"], "left")
    return j.groupBy("doc_id").agg(F.sum("m").alias("n_words"), F.sum(F.when(lexicon.endorsed(F.col("word"), F.col("logf")), F.col("m")).otherwise(0)).alias("n_endorsed"))


@query(
    "unendorsed_words",
    f"""with {_LEX}, w as (select lang, {_WORDS} word from documents), x as (select lang, word, count(*) n from w group by all)
  select x.lang, x.word, x.n::bigint n from x where not exists (select 1 from lex where lex.lang = 'en' and lex.word = x.word and n >= 3)""",
)
def unendorsed_words(spark, sf_dir):
    """Words that the English lexicon, words met three times and more, does not know."""
    docs = _t(spark, sf_dir, "documents")
    known = lexicon.lexicon(docs).filter("lang = 'en' and n >= 3").select("word")
    return lexicon.words(docs, "lang").groupBy("lang", "word").agg(_count().alias("n")).join(known, "word", "left_anti").select("lang", "word", "n")


@query(
    "inflections",
    f"""with w as (select distinct word from (select {_WORDS} word from documents where lang = 'en')), f as (select word, case when regexp_matches(word, '(?:s|x|z|ch|sh)$') then word || 'es'
  when regexp_matches(word, '[^aeiou]y$') and length(word) > 2 then left(word, length(word) - 1) || 'ies' else word || 's' end form from w
  union all select word, unnest(case when word like '%e' then [word || 'd', left(word, length(word) - 1) || 'ing'] when not regexp_matches(word, '(?:s|x|z|ch|sh|y)$') then [word || 'ed', word || 'ing'] else [] end) from w)
  select form, count(*)::bigint n_bases from f group by all""",
)
def inflections(spark, sf_dir):
    w = lexicon.words(_t(spark, sf_dir, "documents").filter("lang = 'en'")).distinct()
    return w.select(F.explode(T.inflections(F.col("word"))).alias("form")).groupBy("form").agg(_count().alias("n_bases"))


def _format_sql(col: str) -> str:
    bare = f"regexp_replace({col}, '^[().,;:]+|[().,;:]+$', '', 'g')"
    return "case " + " ".join(f"when regexp_matches({col}, '^(?:{p})$') or regexp_matches({bare}, '^(?:{p})$') then '{n}'" for n, p in T.NUMERIC_FORMATS) + " end"


@query(
    "numeric_formats",
    f"""with t as (select lang, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) w from documents)
  select lang, {_format_sql('w')} format, count(*)::bigint n, count(distinct w)::bigint n_distinct from t where regexp_matches(w, '[0-9]') group by all""",
)
def numeric_formats(spark, sf_dir):
    w = _t(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("w")).filter(F.col("w").rlike("[0-9]"))
    return w.groupBy("lang", T.numeric_format(F.col("w")).alias("format")).agg(_count().alias("n"), F.countDistinct("w").alias("n_distinct"))


@query(
    "caps_pages",
    """with t as (select conv_id, turn, text, length(regexp_replace(text, '[^A-Z]', '', 'g')) u, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) l from (select conv_id, turn, case when turn % 3 = 0 then upper(text) else text end text from conversations))
  select conv_id, turn, round(u * 1.0e0 / nullif(l, 0), 6) upper_share, (l >= 50 and u >= 0.9 * l) caps_page from t""",
)
def caps_pages(spark, sf_dir):
    """Share of capitals in each turn (every third one set in capitals), and the capitals-page rule."""
    c = _t(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, T.capitals(F.col("text"))).otherwise(F.col("text")))
    u, n = F.length(F.regexp_replace("text", "[^A-Z]", "")), F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return c.select("conv_id", "turn", _r(F.try_divide(u, n)).alias("upper_share"), ((n >= 50) & (u >= 0.9 * n)).alias("caps_page"))


@query(
    "sentence_initial_case",
    """with t as (select doc_id, regexp_extract_all(text, '[.?!]\\s+(\\p{L})', 1) s from documents)
  select doc_id, len(s)::bigint n_starts, len(list_filter(s, lambda x: x = lower(x)))::bigint n_lower from t""",
)
def sentence_initial_case(spark, sf_dir):
    s = F.regexp_extract_all("text", F.lit(r"[.?!]\s+(\p{L})"), F.lit(1))
    d = _t(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_starts"), F.size(F.filter("s", lambda x: x == F.lower(x))).cast("long").alias("n_lower"))


@query(
    "repeat_char_flood",
    """with l as (select doc_id, i, line from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents) where length(line) >= 4),
  c as (select doc_id, i, ch, count(*) n from (select doc_id, i, unnest(string_split(line, '')) ch from l) group by all)
  select doc_id, i::bigint line, round(max(n) * 1.0e0 / sum(n), 6) top_share, sum(n)::bigint n_chars from c group by doc_id, i having max(n) * 1.0e0 / sum(n) >= 0.3""",
)
def repeat_char_flood(spark, sf_dir):
    """Lines of which one character makes up three tenths and more."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).filter(F.length("t") >= 4)
    f = lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), T.commonest_share(F.col("t")).alias("s"), F.length("t").cast("long").alias("n_chars"))
    return f.filter("s >= 0.3").select("doc_id", "line", _r("s").alias("top_share"), "n_chars")


@query(
    "missing_tokens",
    f"""with a as (select doc_id, w, count(*) n from (select doc_id, {_WORDS} w from documents) group by all), p as (select * from a),
  q as (select doc_id - 1 doc_id, w, n from a where doc_id > 0)
  select doc_id, sum(greatest(coalesce(p.n, 0) - coalesce(q.n, 0), 0))::bigint n_missing, sum(least(coalesce(p.n, 0), coalesce(q.n, 0)))::bigint n_common,
  sum(greatest(coalesce(q.n, 0) - coalesce(p.n, 0), 0))::bigint n_surplus from p full join q using (doc_id, w) group by all""",
)
def missing_tokens(spark, sf_dir):
    """Multiset difference and overlap of each document's words and the next one's."""
    a = lexicon.words(_t(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id", "word").agg(_count().alias("n"))
    q = a.filter("doc_id > 0").select((F.col("doc_id") - 1).alias("doc_id"), "word", F.col("n").alias("k"))
    j = a.join(q, ["doc_id", "word"], "full").na.fill(0, ["n", "k"])
    return j.groupBy("doc_id").agg(F.sum(F.greatest(F.col("n") - F.col("k"), F.lit(0))).alias("n_missing"), F.sum(F.least("n", "k")).alias("n_common"), F.sum(F.greatest(F.col("k") - F.col("n"), F.lit(0))).alias("n_surplus"))


@query(
    "seeded_draw",
    "select lang, doc_id, r::bigint rank from (select lang, doc_id, row_number() over (partition by lang order by md5('7-' || doc_id), doc_id) r from documents) where r <= 20",
)
def seeded_draw(spark, sf_dir):
    """Twenty documents of each language in the order of a seeded hash."""
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string"))), "doc_id"))
    return _t(spark, sf_dir, "documents").select("lang", "doc_id", r.cast("long").alias("rank")).filter("rank <= 20")


@query(
    "coverage_curve",
    """with s as (select quality, d.n_chars * 1.0e0 / (d.n_chars + 800) p from labels l join documents d on d.doc_id = l.doc_id)
  select t::double threshold, round(avg((p >= t)::int), 6) kept, round(avg(case when p >= t then quality end), 6) accuracy, round(avg((p - quality) * (p - quality)), 6) brier
  from s, (select unnest([0.5, 0.7, 0.8, 0.9, 0.95, 0.98]) t) group by t""",
)
def coverage_curve(spark, sf_dir):
    """Share kept, accuracy among the kept, and mean squared error at fixed thresholds of a length score."""
    d = _t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 800)).alias("p"))
    s = _t(spark, sf_dir, "labels").join(d, "doc_id").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.7, 0.8, 0.9, 0.95, 0.98)])))
    hit = F.col("p") >= F.col("threshold")
    return s.groupBy("threshold").agg(
        _r(F.avg(hit.cast("int"))).alias("kept"), _r(F.avg(F.when(hit, F.col("quality")))).alias("accuracy"), _r(F.avg((F.col("p") - F.col("quality")) * (F.col("p") - F.col("quality")))).alias("brier")
    )


@query(
    "rank_auc",
    """with s as (select d.lang, l.quality q, n_chars x from labels l join documents d on d.doc_id = l.doc_id),
  r as (select lang, q, rank() over (partition by lang order by x) + (count(*) over (partition by lang, x) - 1) / 2.0e0 k from s)
  select lang, round((sum(case when q = 1 then k end) - sum(q) * (sum(q) + 1) / 2.0e0) / nullif(sum(q) * (count(*) - sum(q)), 0), 6) auc, count(*)::bigint n from r group by all""",
)
def rank_auc(spark, sf_dir):
    """Rank-sum AUC of length for quality, with mean ranks for ties."""
    s = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return ranks.rank_auc(s, ["lang"], "n_chars", "quality").select("lang", _r("auc").alias("auc"), "n")


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))"


def _split(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.filter("vec_id % 5 <> 0").select("label", F.col("embedding").alias("vec"))


@query(
    "knn_topk_class",
    f"""with d as (select a.vec_id query, b.label, {_DIST} d from embeddings a, embeddings b where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0),
  p as (select query, label, avg(d) dist, count(*) m from (select *, row_number() over (partition by query, label order by d) n from d) where n <= 3 group by all)
  select query, label, round(dist, 6) dist, r::bigint rank from (select *, row_number() over (partition by query order by dist, label) r from p where m >= 3) where r <= 3""",
)
def knn_topk_class(spark, sf_dir):
    """Three best classes of every fifth vector by the mean of their three nearest."""
    return vectors.nearest_classes(*_split(spark, sf_dir), k=3, q=3).withColumn("dist", _r("dist"))


@query(
    "class_geometry",
    "select label, dim::bigint dim, round(median(v), 6) med from (select label, unnest(embedding)::double v, unnest(range(0, len(embedding))) dim from embeddings) group by all",
)
def class_geometry(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(_r(F.percentile(F.col("v").cast("double"), 0.5)).alias("med"))


@query(
    "vote_label",
    f"""with d as (select a.vec_id query, b.label, {_DIST} d from embeddings a, embeddings b where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0),
  c as (select query, label, greatest(1 / (1 + min(d)), 0.05) m from d group by all), b as (select query, max(struct_pack(m := m, l := label)) b, sum(m) t from c group by all)
  select query, case when b.m / t >= 0.11 then b.l end voted, round(b.m / t, 6) share from b""",
)
def vote_label(spark, sf_dir):
    """Weighted majority over each class's nearest prototype, null below the purity."""
    near = vectors.nearest_classes(*_split(spark, sf_dir), k=None, q=1).select("query", "label", (1 / (1 + F.col("dist"))).alias("w"))
    return vectors.vote(near, ["query"], "label", "w", 0.11).withColumn("share", _r("share"))


@query(
    "softmax_candidates",
    f"""with d as (select a.vec_id query, b.label, min({_DIST}) d from embeddings a, embeddings b where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0 group by all),
  e as (select *, exp((min(d) over (partition by query) - d) / greatest(stddev_pop(d) over (partition by query), 1.0)) e from d)
  select query, label, round(ln(greatest(e / sum(e) over (partition by query), 1e-9)), 6) logp from e""",
)
def softmax_candidates(spark, sf_dir):
    near = vectors.nearest_classes(*_split(spark, sf_dir), k=None, q=1)
    return vectors.softmax_candidates(near, "query", "dist").select("query", "label", _r("logp").alias("logp"))


@query(
    "gap_levels",
    """with e as (select user_id, floor(epoch(ts))::bigint s from events), f as (select *, case when s - lag(s) over (partition by user_id order by s) > 21600 then 1 else 0 end b from e),
  g as (select *, sum(b) over (partition by user_id order by s) level from f) select user_id, level::bigint as level, round(avg(s), 3) mean, count(*)::bigint size from g group by all""",
)
def gap_levels(spark, sf_dir):
    """Each user's events in groups without a gap of over six hours."""
    e = _t(spark, sf_dir, "events").select("user_id", _seconds("ts").alias("s"))
    return islands.gap_levels(e, ["user_id"], "s", 21600).withColumn("mean", _r("mean", 3))


@query(
    "interval_union",
    """with i as (select o_custkey k, floor(epoch(o_orderdate))::bigint // 86400 a, floor(epoch(max(l_shipdate)))::bigint // 86400 b from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderdate),
  j as (select *, max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) p from i where b >= a)
  select k custkey, sum(greatest(0, b - greatest(a, coalesce(p, a))))::bigint covered, (max(b) - min(a))::bigint hull, count(*)::bigint n from j group by all""",
)
def interval_union(spark, sf_dir):
    """Days on which each customer had an order under way, and the hull of those days."""
    last = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("b"))
    i = _t(spark, sf_dir, "orders").join(last, "o_orderkey").select(F.col("o_custkey").alias("custkey"), F.floor(_seconds("o_orderdate") / 86400).alias("a"), F.floor(_seconds("b") / 86400).alias("b"))
    return islands.interval_union(i, ["custkey"], F.col("a"), F.col("b"))


@query(
    "point_in_band",
    """with b as (select p_size band, min(p_retailprice) lo, max(p_retailprice) hi from part group by all)
  select l_linenumber line, band, count(*)::bigint n from lineitem join b on l_extendedprice / l_quantity >= lo and l_extendedprice / l_quantity < hi group by all""",
)
def point_in_band(spark, sf_dir):
    """Unit prices of line items inside the price bands of part sizes."""
    b = _t(spark, sf_dir, "part").groupBy(F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return islands.band_join(p, b, "x", "lo", "hi", 100.0).groupBy("line", "band").agg(_count().alias("n"))



@query(
    "value_parse",
    """select l_orderkey, l_linenumber, t cell, case when t like '%(%)%' then -1 else 1 end * try_cast(replace(regexp_extract(t, '^[$€£]?\\s?[(]?[-+]?[$€£]?\\s?([0-9][0-9,]*(?:[.][0-9]+)?)[)]?%?$', 1), ',', '') as double) as parsed
  from (select *, case l_linenumber % 4 when 0 then '$1,' || (l_partkey % 900 + 100) || '.50' when 1 then '(' || l_partkey || ')' when 2 then l_partkey || '%' else 'n/a ' || l_partkey end t from lineitem)""",
)
def value_parse(spark, sf_dir):
    k = F.col("l_partkey").cast("string")
    mod = F.col("l_linenumber") % 4
    t = F.when(mod == 0, F.concat(F.lit("$1,"), (F.col("l_partkey") % 900 + 100).cast("string"), F.lit(".50"))).when(mod == 1, F.concat(F.lit("("), k, F.lit(")"))).when(mod == 2, F.concat(k, F.lit("%"))).otherwise(F.concat(F.lit("n/a "), k))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("cell"), T.figure_value(t).alias("parsed"))


@query(
    "lookalike_repair",
    f"""with c as (select p_partkey, translate(p_partkey::varchar || '.50', '018', 'OlB') t from part), r as (select *, translate(t, '{T.LOOKALIKE}', '{T.LOOKALIKE_TO}') f from c)
  select p_partkey, t read_as, case when f <> t and regexp_matches(f, '{T.FIGURE}') then f end repaired from r""",
)
def lookalike_repair(spark, sf_dir):
    """Figures with letters read for digits, and what they most likely were."""
    t = F.translate(F.concat(F.col("p_partkey").cast("string"), F.lit(".50")), "018", "OlB")
    return _t(spark, sf_dir, "part").select("p_partkey", t.alias("read_as"), T.lookalike_repair(t).alias("repaired"))


@query(
    "otsu_threshold",
    """with h as (select floor(l_quantity)::bigint b, count(*) n from lineitem group by all), c as (select b, sum(n) over (order by b) w0, sum(b * n) over (order by b) s0, sum(n) over () w, sum(b * n) over () s from h)
  select b threshold, round(w0 * 1.0e0 * (w - w0) * pow(s0 * 1.0e0 / w0 - (s - s0) * 1.0e0 / (w - w0), 2) / (w * 1.0e0 * w), 6) between_var from c where w > w0""",
)
def otsu_threshold(spark, sf_dir):
    """Between-class variance of every threshold over a histogram of bounded width."""
    h = _t(spark, sf_dir, "lineitem").groupBy(F.floor("l_quantity").alias("b")).agg(_count().alias("n"))
    up, every = Window.orderBy("b"), Window.partitionBy()
    bn = F.col("b") * F.col("n")
    c = h.select("b", F.sum("n").over(up).alias("w0"), F.sum(bn).over(up).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(bn).over(every).alias("s")).filter("w > w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    return c.select(F.col("b").alias("threshold"), _r(F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap / (F.col("w").cast("double") * F.col("w"))).alias("between_var"))


@query(
    "mad_reject",
    """with m as (select event_type, median(value) med from events group by all), d as (select event_type, median(abs(value - med)) mad from events join m using (event_type) group by all)
  select event_id, event_type, round(med + 3 * case when mad > 0 then mad else 0.2 * med end, 6) limit_at from events join m using (event_type) join d using (event_type) where value > med + 3 * case when mad > 0 then mad else 0.2 * med end""",
)
def mad_reject(spark, sf_dir):
    """Events above their type's median by three median absolute deviations."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return evidence.reject_above(e, ["event_type"], "value", 3.0, 0.2).select("event_id", "event_type", _r("limit_at").alias("limit_at"))


@query(
    "ctc_collapse",
    """with f as (select user_id, event_type c, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) p from events)
  select user_id, string_agg(left(c, 1), '' order by ts, event_id) decoded from f where c <> 'error' and (p is null or p <> c) group by all""",
)
def ctc_collapse(spark, sf_dir):
    """Each user's events as frames: repeats collapsed, the blank ('error') dropped."""
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("frame"), "event_type")
    best = evidence.greedy_labels(e, "user_id", "frame", "event_type", "error")
    return best.select("user_id", F.array_join(F.transform("labels", lambda x: F.left(x, F.lit(1))), "").alias("decoded")).filter("decoded <> ''")


@query(
    "tempered_sampling",
    """with c as (select source, count(*) n from documents group by all), p as (select source, pow(n, 0.5) / sum(pow(n, 0.5)) over () p from c)
  select source, round(p, 6) p, round(sum(p) over (order by source), 6) upto from p""",
)
def tempered_sampling(spark, sf_dir):
    """Sampling shares of sources, tempered by a square root, and their running sum (a row per source)."""
    c = _t(spark, sf_dir, "documents").groupBy("source").agg(_count().alias("n"))
    p = c.select("source", (F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy())).alias("p"))
    return p.select("source", _r("p").alias("p"), _r(F.sum("p").over(Window.orderBy("source"))).alias("upto"))


@query(
    "pools_disjoint",
    "select lang, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'tune' else 'held' end as pool, count(*)::bigint n, sum(n_chars)::bigint chars from documents group by all",
)
def pools_disjoint(spark, sf_dir):
    k = F.col("doc_id") % 10
    return _t(spark, sf_dir, "documents").groupBy("lang", F.when(k < 7, "train").when(k < 9, "tune").otherwise("held").alias("pool")).agg(_count().alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "batch_summary",
    "select regexp_extract(url, '^([a-z]+):', 1) kind, count(*)::bigint pages, count(*) filter (where html is null or html = '' or not contains(html, '</html>'))::bigint failed, round(avg(length(html)), 3) mean_chars from pages group by all",
)
def batch_summary(spark, sf_dir):
    """Pages, failures (no closing tag) and mean size by kind of address."""
    bad = F.col("html").isNull() | (F.col("html") == "") | ~F.col("html").contains("</html>")
    return _t(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^([a-z]+):", 1).alias("kind")).agg(_count().alias("pages"), F.count(F.when(bad, 1)).alias("failed"), _r(F.avg(F.length("html")), 3).alias("mean_chars"))


@query(
    "grouping_sets_kind",
    "select lang, source, grouping_id(lang, source)::bigint gid, count(*)::bigint n, sum(n_chars)::bigint chars from documents group by grouping sets ((lang, source), (lang), (source), ())",
)
def grouping_sets_kind(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.grouping_id("lang", "source").cast("long").alias("gid"), _count().alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "layout_inversions",
    """select a.conv_id, count(*)::bigint pairs, count(*) filter (where length(a.text) > length(b.text))::bigint inverted from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 group by all""",
)
def layout_inversions(spark, sf_dir):
    """Neighbouring turns whose lengths stand the wrong way round."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.lead(F.length("text")).over(w).alias("m"), F.lead("turn").over(w).alias("t")).filter("t = turn + 1")
    return c.groupBy("conv_id").agg(_count().alias("pairs"), F.count(F.when(F.col("n") > F.col("m"), 1)).alias("inverted"))


@query(
    "html_text",
    """select page_id, len(regexp_extract_all(html, '(?i)<a\\b'))::bigint n_links, len(regexp_extract_all(html, '(?i)<(p|h1|li)\\b'))::bigint n_blocks,
  length(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g'))::bigint n_text from pages""",
)
def html_text(spark, sf_dir):
    """Links, blocks and characters of text of each page."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", ""), "<[^>]*>", "")
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return _t(spark, sf_dir, "pages").select("page_id", n(r"(?i)<a\b").alias("n_links"), n(r"(?i)<(p|h1|li)\b").alias("n_blocks"), F.length(bare).cast("long").alias("n_text"))


@query(
    "baseline_rows",
    """with e as (select user_id, floor(epoch(ts))::bigint // 3600 b, event_id, event_type from events), f as (select *, case when b - lag(b) over (partition by user_id order by b, event_id) > 1 then 1 else 0 end g from e),
  h as (select *, sum(g) over (partition by user_id order by b, event_id) row from f) select user_id, row::bigint as row_no, string_agg(event_type, '  ' order by b, event_id) line, count(*)::bigint n from h group by all""",
)
def baseline_rows(spark, sf_dir):
    """Events as words on baselines of an hour: rows by gap, joined in order with two blanks."""
    e = _t(spark, sf_dir, "events").select("user_id", F.floor(_seconds("ts") / 3600).alias("b"), "event_id", "event_type")
    return rows.rows_text(e, ["user_id"], "b", ["b", "event_id"], "event_type", 1)


@query(
    "line_numbers",
    """with l as (select l_orderkey k, l_linenumber n, lag(l_linenumber) over (partition by l_orderkey order by l_shipdate, l_linenumber) p from lineitem)
  select k, count(*)::bigint n, round(avg((n > p)::int), 6) ascending, (count(*) >= 6 and avg((n > p)::int) >= 0.7) numbered from l group by all""",
)
def line_numbers(spark, sf_dir):
    """Orders whose line numbers ascend in shipping order like the numbers of a margin."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") > F.lag("l_linenumber").over(w)).cast("int").alias("up"))
    return l.groupBy("k").agg(_count().alias("n"), _r(F.avg("up")).alias("ascending"), ((_count() >= 6) & (F.avg("up") >= 0.7)).alias("numbered"))


@query(
    "edits_overlay",
    "select doc_id, md5(case when doc_id % 7 = 0 then 'edited ' || doc_id else text end) text_md5, doc_id % 7 = 0 was_edited from documents",
)
def edits_overlay(spark, sf_dir):
    """A change log laid over the documents: the edit where there is one, else the text."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    log = d.filter("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("edited "), F.col("doc_id").cast("string")).alias("new"))
    return d.join(log, "doc_id", "left").select("doc_id", F.md5(F.coalesce("new", "text")).alias("text_md5"), F.col("new").isNotNull().alias("was_edited"))


@query(
    "gaussian_classifier",
    """with t as (select label, unnest(range(0, len(embedding))) i, unnest(embedding)::double v from embeddings where vec_id % 5 <> 0), m as (select label, i, avg(v) mu, greatest(var_pop(v), 1e-6) s2 from t group by all),
  q as (select vec_id, label truth, unnest(range(0, len(embedding))) i, unnest(embedding)::double v from embeddings where vec_id % 5 = 0),
  s as (select vec_id, truth, m.label, sum(-0.5 * (ln(s2) + (v - mu) * (v - mu) / s2)) ll from q join m using (i) group by all)
  select vec_id, truth, label predicted, round(ll, 4) loglik from (select *, row_number() over (partition by vec_id order by ll desc, label) r from s) where r = 1""",
)
def gaussian_classifier(spark, sf_dir):
    """Per-class means and variances score every fifth vector; the best class."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    m = e.filter("vec_id % 5 <> 0").groupBy(F.col("label").alias("predicted"), "i").agg(F.avg("v").alias("mu"), F.greatest(F.var_pop("v"), F.lit(1e-6)).alias("s2"))
    ll = F.sum(-0.5 * (F.log("s2") + (F.col("v") - F.col("mu")) * (F.col("v") - F.col("mu")) / F.col("s2")))
    s = e.filter("vec_id % 5 = 0").withColumnRenamed("label", "truth").join(m, "i").groupBy("vec_id", "truth", "predicted").agg(ll.alias("ll"))
    r = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("ll"), "predicted"))
    return s.withColumn("r", r).filter("r = 1").select("vec_id", "truth", "predicted", _r("ll", 4).alias("loglik"))
