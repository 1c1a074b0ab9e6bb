"""Decoding and scoring over the standard tables; each query with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import accuracy, decoding, lexicon, vectors
from leafmill.queries.catalog import query
from leafmill.queries.ledger import LINES, lines
from leafmill.queries.paged import BYTEWISE
from leafmill.queries.standard import _LEX, _WORDS, _count, _r, _t


@query("gap_bands", f"with {LINES} select k page, round(0.8e0 * (avg(3 + q % 4) + avg(25 + p % 9)) / 2, 6) low, round(1.25e0 * (avg(3 + q % 4) + avg(25 + p % 9)) / 2, 6) high from li where n >= 3 group by k")
def gap_bands(spark, sf_dir):
    """Band of uncertain gaps around the middle of each page's narrow gaps, three to six, and wide ones, from twenty-five on."""
    l = lines(spark, sf_dir)
    gaps = l.select(F.col("table").alias("page"), F.explode(F.array(3.0 + F.col("q") % 4, 25.0 + F.col("p") % 9)).alias("gap"))
    return decoding.gap_bands(gaps).select("page", _r("low").alias("low"), _r("high").alias("high"))


@query("word_breaks", f"with {LINES} select k page, r::bigint glyph, ((r - 1) // 3)::bigint word, (r > 1 and r % 3 = 1) uncertain from li")
def word_breaks(spark, sf_dir):
    """Words of three glyphs each, parted by gaps inside the band."""
    l = lines(spark, sf_dir)
    x = (20.0 * F.col("r") + 15 * F.floor((F.col("r") - 1) / 3)).alias("x0")
    g = l.select(F.col("table").alias("page"), F.lit(0).alias("line"), F.col("r").alias("glyph"), x)
    g = g.withColumn("x1", F.col("x0") + 18)
    bands = l.filter("r = 1").select(F.col("table").alias("page"), F.lit(14.0).alias("low"), F.lit(20.0).alias("high"))
    return decoding.word_breaks(g, bands).select("page", "glyph", "word", "uncertain")


@query(
    "x_heights",
    f"""with {LINES}, g as (select k, r % 2 line, unnest([10.0e0 + q % 3, 16.0e0 + p % 3]) v, unnest([1, 0]) small from li),
  o as (select k, line, case when count(*) >= 6 then avg(v) filter (where small = 1) end own from g group by all), e as (select k, median(v) every from g group by k)
  select k page, line::bigint as line_no, round(coalesce(own, median(own) over (partition by k), every), 6) x_height from o join e using (k)""",
)
def x_heights(spark, sf_dir):
    """Lower group of each line's ascents, ten to twelve and from sixteen on; lines of fewer than three glyphs of each go by the page."""
    l = lines(spark, sf_dir)
    g = l.select(F.col("table").alias("page"), (F.col("r") % 2).alias("line"), F.explode(F.array(10.0 + F.col("q") % 3, 16.0 + F.col("p") % 3)).alias("ascent"))
    return decoding.x_heights(g).select("page", F.col("line").alias("line_no"), _r("x_height").alias("x_height"))


@query(
    "lattice_paths",
    f"""with {LINES}, l as (select k * 1000 + (r - 1) // 6 k, (r - 1) % 6 + 1 r, q, p from li), s as (select k, r - 1 a, r b, (q % 7) * 1.0e0 d from l union all select k, r - 2, r, (p % 11) * 1.0e0 from l where r > 1), m as (select k, median(d) m, max(b) n from s group by k),
  t as (select s.k, a, b, d - m w, n from s join m on m.k = s.k where b - a < n or n = 1),
  c as (with recursive z as (select k, b, w c, a || '-' || b path, n from t where a = 0 union all select t.k, t.b, z.c + t.w, z.path || ' ' || t.a || '-' || t.b, z.n from z join t on t.k = z.k and t.a = z.b) select * from z)
  select k page, round(min(c), 6) cost, count(*)::bigint n_paths from c where b = n group by k""",
)
def lattice_paths(spark, sf_dir):
    """Cheapest way through up to six cut pieces, and how many ways there are; longer orders are several words."""
    l = lines(spark, sf_dir).withColumn("table", F.col("table") * 1000 + F.floor((F.col("r") - 1) / 6)).withColumn("r", (F.col("r") - 1) % 6 + 1)
    one = l.select(F.col("table").alias("page"), (F.col("r") - 1).alias("first"), F.col("r").alias("stop"), (F.col("q") % 7).cast("double").alias("dist"))
    two = l.filter("r > 1").select(F.col("table").alias("page"), (F.col("r") - 2).alias("first"), F.col("r").alias("stop"), (F.col("p") % 11).cast("double").alias("dist"))
    found = decoding.lattice_paths(one.unionByName(two), k=1000)
    return found.groupBy("page").agg(_r(F.min("cost")).alias("cost"), _count().alias("n_paths"))


@query(
    "height_prior",
    """with c as (select doc_id, i, substr(text, i, 1) ch, 0.5e0 + (doc_id * 7 + i) % 20 / 10.0e0 h, (doc_id + i) % 5 / 10.0e0 b from (select doc_id, text, unnest(range(1, length(text) + 1)) i from documents))
  select doc_id, round(sum(case when regexp_matches(ch, '^[A-Z0-9bdfhkltgjpqy]$') then -greatest(abs(h - 1.45e0) - 1 / 3.0e0, 0) when regexp_matches(ch, '^[acemnorsuvwxz]$') then -greatest(abs(h - 1) - 1 / 3.0e0, 0) else 0 end), 3) + 0 height,
  sum(case when regexp_matches(ch, '^[gjpqy]$') then case when b > 0.2 then 0.0 else -1.0 end when b > 0.2 and regexp_matches(ch, '^[A-Za-z0-9]$') then -1.0 else 0.0 end)::double descender from c group by doc_id""",
)
def height_prior(spark, sf_dir):
    """Priors of made glyph heights, summed over each document's characters."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "")).alias("at", "ch")).withColumn("i", F.col("at") + 1)
    c = d.select("doc_id", "ch", (0.5 + (F.col("doc_id") * 7 + F.col("i")) % 20 / 10.0).alias("h"), ((F.col("doc_id") + F.col("i")) % 5 / 10.0).alias("b"))
    one = F.lit(1.0)
    p = c.select("doc_id", decoding.height_prior(F.col("ch"), F.col("h"), one).alias("p"), decoding.descender_prior(F.col("ch"), F.col("b"), one).alias("q"))
    return p.groupBy("doc_id").agg((_r(F.sum("p"), 3) + 0.0).alias("height"), F.sum("q").alias("descender"))


@query("kerned_digits", f"with {LINES} select k page, string_agg(q % 10, '' order by r) as text, min(1.0e0 / r) conf from li group by k")
def kerned_digits(spark, sf_dir):
    """Lone digits that stand close are one number."""
    l = lines(spark, sf_dir)
    x = 10.0 * F.col("r")
    w = l.select(F.col("table").alias("page"), F.lit(0).alias("line"), F.col("r").alias("word"), (F.col("q") % 10).cast("string").alias("text"), (1.0 / F.col("r")).alias("conf"), x.alias("x0"), (x + 8).alias("x1"), F.lit(10.0).alias("x_height"))
    return decoding.join_kerned_digits(w).select("page", "text", "conf")


@query(
    "capitals_pages",
    """with w as (select doc_id, unnest(list_filter(string_split(case when doc_id % 2 = 0 then upper(text) || ' Mixed small' else text end, ' '), lambda x: x <> '')) w from documents where text is not null), n as (select doc_id, sum(length(regexp_replace(w, '[^\\p{Lu}]', '', 'g'))) u, sum(length(regexp_replace(w, '[^\\p{L}]', '', 'g'))) a from w group by doc_id)
  select w.doc_id page, (count(*) filter (where a >= 50 and u >= 0.9 * a and w <> lower(w) and w <> upper(w)))::bigint n_changed, count(*)::bigint n from w join n on n.doc_id = w.doc_id group by all""",
)
def capitals_pages(spark, sf_dir):
    """Mixed-case words in capitals on pages of capitals."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(T.capitals(F.col("text")), F.lit(" Mixed small"))).otherwise(F.col("text"))
    w = _t(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("page"), F.explode(F.filter(F.split(t, " "), lambda x: x != "")).alias("text")).withColumn("was", F.col("text"))
    return decoding.capitals_page(w).groupBy("page").agg(F.count(F.when(F.col("text") != F.col("was"), 1)).alias("n_changed"), _count().alias("n"))


@query(
    "case_repair",
    f"""with {_LEX}, w as (select distinct word from lex where lang = 'en' and length(word) >= 4 and contains(word, 'l')), v as (select word, replace(word, 'l', 'I') got from w)
  select got, word repaired from v""",
)
def case_repair(spark, sf_dir):
    """English words read with capital I for small l, put right by the lexicon."""
    lex = lexicon.lexicon(_t(spark, sf_dir, "documents")).filter("lang = 'en'").select("word")
    w = lex.filter((F.length("word") >= 4) & F.contains("word", F.lit("l"))).select(F.replace("word", F.lit("l"), F.lit("I")).alias("text"))
    return decoding.repair_case(w.withColumn("word", F.col("text")), lex).select(F.col("text").alias("got"), "repaired")


@query(
    "mixed_repair",
    f"""with {_LEX}, w as (select distinct word from lex where lang = 'en' and length(word) >= 5 and regexp_matches(word, '^[a-z]+$') and regexp_matches(word, '[oisbgz]')),
  v as (select word, translate(word, 'oisbgz', '015862') noisy from w), n as (select word, noisy, length(regexp_replace(noisy, '[^a-z]', '', 'g')) l from v where not regexp_matches(noisy, '^[0-9]+(st|nd|rd|th|s|m|g|k|km|kg|cm|mm|ml|lb|oz|am|pm)$'))
  select noisy got, word repaired from n where l * 2 > length(noisy)""",
)
def mixed_repair(spark, sf_dir):
    """Digits inside words as letters again; words that are mostly digits are left out."""
    lex = lexicon.lexicon(_t(spark, sf_dir, "documents")).filter("lang = 'en'").select("word")
    w = lex.filter((F.length("word") >= 5) & F.col("word").rlike("^[a-z]+$") & F.col("word").rlike("[oisbgz]")).select(F.translate("word", "oisbgz", "015862").alias("text"))
    w = w.filter((F.regexp_count("text", F.lit("[a-z]")) * 2 > F.length("text")) & ~F.col("text").rlike("^[0-9]+(st|nd|rd|th|s|m|g|k|km|kg|cm|mm|ml|lb|oz|am|pm)$"))
    return decoding.repair_mixed(w.withColumn("word", F.col("text")), lex).select(F.col("text").alias("got"), "repaired")


@query(
    "bag_scores",
    """with p as (select conv_id, turn, text got, lead(text) over (partition by conv_id order by turn) truth from conversations), q as (select * from p where truth is not null),
  g as (select conv_id, turn, w, count(*) n from (select conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(got), '\\s+'), lambda x: x <> '')) w from q) group by all), t as (select conv_id, turn, w, count(*) n from (select conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(truth), '\\s+'), lambda x: x <> '')) w from q) group by all),
  j as (select conv_id, turn, coalesce(g.n, 0) g, coalesce(t.n, 0) t from g full join t using (conv_id, turn, w)), s as (select conv_id, turn, sum(least(g, t))::bigint common, sum(g)::bigint ng, sum(t)::bigint nt from j group by all)
  select conv_id, turn::bigint turn, common, round(common * 1.0e0 / nullif(nt, 0), 6) recall, round(common * 1.0e0 / nullif(ng, 0), 6) as precision_ from s""",
)
def bag_scores(spark, sf_dir):
    """Recall and precision of each turn's words against the next one's, as multisets."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("got"), nxt.alias("truth")).filter("truth is not null")
    return accuracy.bag_scores(p, ["conv_id", "turn"]).select("conv_id", "turn", "common", _r("recall").alias("recall"), _r("precision").alias("precision_"))


@query("word_accuracy")
def word_accuracy(spark, sf_dir):
    """Word accuracy of each whole turn against the next, mean and pooled by conversation; edit distance of lists has no SQL."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = _t(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("got"), nxt.alias("truth")).filter("truth is not null")
    return accuracy.word_accuracy(p, ["conv_id"])


@query(
    "line_matches",
    f"""with t as (select conv_id, turn, {BYTEWISE} t from conversations), g as (select conv_id, turn, replace(t, 'e', 'c') g from t where length(t) >= 4),
  m as (select g.conv_id, g.turn a, t.turn b, levenshtein(g, t) d, greatest(length(g), length(t)) n from g join t on g.conv_id = t.conv_id where length(t) > 0 and length(g) * 1.0e0 / length(t) > 0.6 and length(g) * 1.0e0 / length(t) < 1.6),
  c as (select *, d * 1.0e0 / n s from m where d <= 0.35 * n qualify row_number() over (partition by conv_id, a order by d * 1.0e0 / n, b) = 1)
  select conv_id, a::bigint as line_no, b::bigint truth_line, d::bigint cost from c qualify row_number() over (partition by conv_id, b order by s, a) = 1""",
)
def line_matches(spark, sf_dir):
    """Misread turns matched with the turns of their conversation; a turn keeps its best claimant."""
    t = _t(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").cast("long").alias("line"), "text")
    got = t.withColumn("text", F.replace("text", F.lit("e"), F.lit("c")))
    return accuracy.best_claimants(got, t, "conv_id").select("conv_id", F.col("line").alias("line_no"), "truth_line", "cost")


@query(
    "layout_scores",
    f"""with {LINES}, b as (select k, r block, r place from li), z as (select distinct k, (r - 1) // 2 zone, -((r - 1) // 2) place from li), pt as (select k, r block, (r - 1) // 2 zone, q + 0.0e0 ink from li union all select k, 1, (r - 1) // 2, 30.0e0 from li where r = 3),
  s as (select *, ink / sum(ink) over (partition by k, zone) share, row_number() over (partition by k, zone order by ink desc, block) n from (select k, block, zone, sum(ink) ink from pt group by all)),
  m as (select s.k, zone, block, share, z.place zp, b.place bp from s join z using (k, zone) join b using (k, block) where n = 1), f as (select * from m where share >= 0.5),
  i as (select x.k, count(*) c from f x join f y on x.k = y.k and x.zp < y.zp and x.bp > y.bp group by x.k), w as (select k, count(*) c from (select k, block from f group by all having count(*) > 1) group by k)
  select z.k page, count(*)::bigint n_zones, (select count(*) from m where m.k = z.k and share >= 0.5)::bigint n_main, (select count(*) from m where m.k = z.k and share < 0.8)::bigint n_split, coalesce(any_value(w.c), 0)::bigint n_welds, coalesce(any_value(i.c), 0)::bigint inversions
  from z left join i on i.k = z.k left join w on w.k = z.k group by z.k""",
)
def layout_scores(spark, sf_dir):
    """How blocks, one a line, fit zones of two lines each that are read upwards; a block reaches into the next zone."""
    l = lines(spark, sf_dir).withColumnRenamed("table", "page")
    zone = F.floor((F.col("r") - 1) / 2)
    blocks = l.select("page", F.col("r").alias("block"), F.col("r").alias("place"))
    zones = l.select("page", zone.alias("zone")).distinct().withColumn("place", -F.col("zone"))
    own = l.select("page", F.col("r").alias("block"), zone.alias("zone"), F.col("q").cast("double").alias("ink"))
    more = l.filter("r = 3").select("page", F.lit(1).cast("long").alias("block"), zone.alias("zone"), F.lit(30.0).alias("ink"))
    parts = own.unionByName(more).groupBy("page", "block", "zone").agg(F.sum("ink").alias("ink"))
    return accuracy.layout_scores(blocks, zones, parts, "page")


@query(
    "error_steps",
    f"""with t as (select item_id, {BYTEWISE} truth from benchmark), p as (select item_id, truth, replace(truth, 'e', 'c') got from t), c as (select item_id, substr(truth, i, 1) ch from (select *, unnest(range(1, length(truth) + 1)) i from p))
  select item_id, 'sub shape' bucket, count(*)::bigint n from c where ch = 'e' group by item_id""",
)
def error_steps(spark, sf_dir):
    """Kinds of errors of texts read with c for e."""
    p = _t(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("e"), F.lit("c")).alias("got"), F.col("text").alias("truth"))
    return accuracy.error_buckets(p, "item_id")


@query(
    "equation_scores",
    f"""with {LINES}, e as (select k, r, '\\frac{{' || q || '}}{{' || p || '}}' || case when r % 3 = 0 then '' else '+x' end t, q, p from li), n as (select *, 5 + length(q::varchar) + length(p::varchar) + case when r % 3 = 0 then 0 else 2 end m from e)
  select (m // 4)::bigint band, count(*)::bigint n, round(avg((r % 2 = 1)::int), 6) exact, round(avg((r % 2 = 1)::int), 6) balanced, round(1 - sum((r % 2 = 0)::int) * 1.0e0 / sum(m), 6) token_acc from n group by m // 4""",
)
def equation_scores(spark, sf_dir):
    """Equations of which every other one lacks its first brace."""
    l = lines(spark, sf_dir)
    t = F.concat(F.lit("\\frac{"), F.col("q").cast("string"), F.lit("}{"), F.col("p").cast("string"), F.lit("}"), F.when(F.col("r") % 3 == 0, "").otherwise("+x"))
    got = F.when(F.col("r") % 2 == 1, t).otherwise(F.replace(t, F.lit("\\frac{"), F.lit("\\frac ")))
    s = accuracy.equation_scores(l.select(got.alias("got"), t.alias("truth")), band=4)
    return s.select("band", "n", *[_r(c).alias(c) for c in ("exact", "balanced", "token_acc")])


@query("latex_tokens", f"with {LINES} select k, r::bigint r, 5 + length(q::varchar) + length(p::varchar) n_tokens from li")
def latex_tokens(spark, sf_dir):
    """Tokens of fractions: the command, four braces, a token a digit."""
    l = lines(spark, sf_dir)
    t = F.concat(F.lit("\\frac {"), F.col("q").cast("string"), F.lit("} {"), F.col("p").cast("string"), F.lit("}"))
    return l.select(F.col("table").alias("k"), "r", F.size(accuracy.latex_tokens(t)).cast("long").alias("n_tokens"))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """Mean difference of two made scores of the labelled documents, with the spread over 500 resampled sets; tested by its moments."""
    s = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    s = s.select("doc_id", F.col("quality").cast("double").alias("a"), (F.col("n_chars") / (F.col("n_chars") + 800)).alias("b"))
    return accuracy.paired_bootstrap(s, "a", "b", "doc_id", draws=500)


@query(
    "missing_causes",
    f"""with t as (select doc_id, w, count(*) n from (select doc_id, {_WORDS} w from documents) where length(w) >= 6 and regexp_matches(w, '^[a-z]+$') group by all),
  l as (select *, left(w, 1) c, length(w) // 3 reach from t where left(w, 1) between 'a' and 'm' or left(w, 1) between 'w' and 'z'), s as (select distinct doc_id, '_' || substr(w, 2) o from t where left(w, 1) between 'b' and 'm'),
  k as (select l.doc_id, l.w, any_value(n) n, any_value(c) c, bool_or(o is not null) near from l left join s on s.doc_id = l.doc_id and abs(length(o) - length(w)) <= reach and levenshtein(w, o) <= reach group by l.doc_id, l.w)
  select doc_id page, case when near then 'misread' when c = 'a' then 'suppressed' else 'unread' end cause, sum(n)::bigint n, count(*)::bigint n_words from k group by all""",
)
def missing_causes(spark, sf_dir):
    """Words that a made reading lacks, by cause: those in a- are dropped, in b- to m- misread in a letter, in w- to z- not read."""
    own = lexicon.words(_t(spark, sf_dir, "documents"), "doc_id").filter((F.length("word") >= 6) & F.col("word").rlike("^[a-z]+$")).select(F.col("doc_id").alias("page"), "word")
    first = F.left("word", F.lit(1))
    read = own.filter(~first.between("w", "z"))
    got = read.select("page", F.when(first.between("b", "m"), F.concat(F.lit("_"), F.substr("word", F.lit(2)))).otherwise(F.col("word")).alias("word"), (first != "a").alias("kept"))
    return accuracy.missing_words(got, own, "page").groupBy("page", "cause").agg(F.sum("n").alias("n"), _count().alias("n_words"))


@query(
    "merge_candidates",
    """with c as (select user_id q, event_type l, min(value) d, max(value) u from events where value is not null group by all), b as (select q, l, least(d * 1.5e0, u) d from c)
  select q query_no, l label, round(d, 6) dist, row_number() over (partition by q order by d, l)::bigint rank_no from b qualify row_number() over (partition by q order by d, l) <= 3""",
)
def merge_candidates(spark, sf_dir):
    """Classes at the lesser of a document's scaled distance and the universal one; the three best of each user."""
    c = _t(spark, sf_dir, "events").filter("value is not null").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("label")).agg(F.min("value").alias("d"), F.max("value").alias("u"))
    found = vectors.merge_candidates(c.select("query", "label", F.col("d").alias("dist")), c.select("query", "label", F.col("u").alias("dist")), 1.5, 3)
    return found.select(F.col("query").alias("query_no"), "label", _r("dist").alias("dist"), F.col("rank").alias("rank_no"))


