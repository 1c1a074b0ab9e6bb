"""Layout, quota and guard queries over the standard tables; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import neighbours
from leafmill.queries.catalog import query
from leafmill.queries.standard import _count, _r, _t

_POINTS = "p as (select l_orderkey page, l_linenumber item, min(l_quantity) x, min(l_extendedprice) / 1000 y from lineitem group by all)"
_LINKS = f"""with {_POINTS}, e as (select page, a.item src, b.item dst, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) len,
  floor((atan2(b.y - a.y, b.x - a.x) + pi()) / (pi() / 4))::bigint % 8 sector from p a join p b using (page) where a.item <> b.item),
  k as (select * from e qualify row_number() over (partition by page, src, sector order by len, dst) <= 1)"""


def _links(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("x"), (F.min("l_extendedprice") / 1000).alias("y"))
    return neighbours.sector_links(lines, "l_orderkey", "l_linenumber", "x", "y")


@query("sector_knn", f"{_LINKS} select page, src, dst, sector, round(len, 6) length from k")
def sector_knn(spark, sf_dir):
    """Nearest line of the same order in each of eight directions."""
    return _links(spark, sf_dir).select("page", "src", "dst", F.col("sector").cast("long").alias("sector"), _r("length").alias("length"))


@query(
    "mutual_links",
    f"""{_LINKS}, m as (select k.*, exists (select 1 from k o where o.page = k.page and o.src = k.dst and o.dst = k.src) mutual from k)
  select page, count(*)::bigint n_links, (count(*) filter (where mutual))::bigint n_mutual, round(avg(len), 6) mean_length from m group by page""",
)
def mutual_links(spark, sf_dir):
    """Links of each order, how many go both ways, and their mean length."""
    m = neighbours.with_mutual(_links(spark, sf_dir))
    return m.groupBy("page").agg(_count().alias("n_links"), F.count(F.when(F.col("mutual"), 1)).alias("n_mutual"), _r(F.avg("length")).alias("mean_length"))


@query(
    "hough_vote",
    """with v as (select event_type, a, floor((value - hour(ts) * tan(radians(a))) / 5) bin, count(*) n from events, unnest(range(-20, 21)) t(a) where value is not null group by all),
  s as (select event_type, a, sum(n * n)::bigint score from v group by all)
  select event_type, a::bigint angle, score from s qualify row_number() over (partition by event_type order by score desc, a) = 1""",
)
def hough_vote(spark, sf_dir):
    """Angle whose rows collect the largest sum of squared votes, by kind of event."""
    # Points that agree vote once with their number; 41 angles widen that, not the table.
    e = _t(spark, sf_dir, "events").filter("value is not null").groupBy("event_type", F.hour("ts").alias("x"), "value").agg(_count().alias("n"))
    a = e.select("*", F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("a"))
    row = F.floor((F.col("value") - F.col("x") * F.tan(F.radians("a"))) / 5)
    s = a.groupBy("event_type", "a", row.alias("bin")).agg(F.sum("n").alias("n")).groupBy("event_type", "a").agg(F.sum(F.col("n") * F.col("n")).alias("score"))
    best = s.groupBy("event_type").agg(F.min(F.struct(-F.col("score"), "a")).alias("m"), F.max("score").alias("score"))
    return best.select("event_type", F.col("m.a").cast("long").alias("angle"), "score")


@query(
    "line_case_majority",
    """with w as (select lang, unnest(regexp_extract_all(text, '\\p{L}+')) w from documents), c as (select lang, w, length(w) n, length(regexp_replace(w, '[^\\p{Lu}]', '', 'g')) up from w where length(w) >= 3)
  select lang, count(*)::bigint n_words, (count(*) filter (where up * 10 >= n * 7))::bigint n_upper,
  (count(*) filter (where up * 10 < n * 7 and (n - up) * 10 >= n * 6))::bigint n_lower from c group by lang""",
)
def line_case_majority(spark, sf_dir):
    """Words of three letters and more that are mostly upper (7 of 10) or mostly lower (6 of 10) case."""
    w = _t(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("w")).filter(F.length("w") >= 3)
    c = w.groupBy("lang", "w").agg(_count().alias("m")).select("lang", "m", F.length("w").alias("n"), F.regexp_count("w", F.lit(r"\p{Lu}")).alias("up"))
    upper = F.col("up") * 10 >= F.col("n") * 7
    lower = ~upper & ((F.col("n") - F.col("up")) * 10 >= F.col("n") * 6)
    total = lambda cond: F.sum(F.when(cond, F.col("m")).otherwise(0))
    return c.groupBy("lang").agg(F.sum("m").alias("n_words"), total(upper).alias("n_upper"), total(lower).alias("n_lower"))


@query(
    "garbage_lines",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), f as (select doc_id, length(line) n, length(regexp_replace(line, '[^0-9]', '', 'g')) digits,
  len(regexp_extract_all(line, '[^ ]+')) tokens, len(list_filter(string_split(line, ' '), lambda x: length(x) = 1)) singles, length(regexp_replace(line, '[^\\p{L}]', '', 'g')) letters from l where length(line) >= 4),
  g as (select doc_id, digits * 2 < n and (singles * 2 >= tokens or letters * 2 < n) bad from f)
  select doc_id, (count(*) filter (where not bad))::bigint n_kept, (count(*) filter (where bad))::bigint n_dropped from g group by doc_id""",
)
def garbage_lines(spark, sf_dir):
    """Lines that are mostly single characters or hold few letters; lines that are mostly digits are spared."""
    line = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 4)
    n, digits, letters = F.length("line"), F.regexp_count("line", F.lit("[0-9]")), F.regexp_count("line", F.lit(r"\p{L}"))
    tokens, singles = F.regexp_count("line", F.lit("[^ ]+")), F.size(F.filter(F.split("line", " "), lambda x: F.length(x) == 1))
    bad = (digits * 2 < n) & ((singles * 2 >= tokens) | (letters * 2 < n))
    return line.select("doc_id", bad.alias("bad")).groupBy("doc_id").agg(F.count(F.when(~F.col("bad"), 1)).alias("n_kept"), F.count(F.when(F.col("bad"), 1)).alias("n_dropped"))


@query(
    "tag_quota_sqrt",
    """with c as (select source, count(*) n from documents group by source), s as (select source, n, 200 * sqrt(n) / sum(sqrt(n)) over () share from c),
  f as (select source, n, greatest(1, floor(share))::bigint base, round(share - floor(share), 9) rest from s)
  select source, n::bigint n_docs, base + (row_number() over (order by rest desc, source) <= 200 - sum(base) over ())::bigint quota from f""",
)
def tag_quota_sqrt(spark, sf_dir):
    """Quotas of 200 in all by the root of each source's count, at least one, by largest remainder."""
    c = _t(spark, sf_dir, "documents").groupBy("source").agg(_count().alias("n_docs"))
    every = Window.partitionBy(F.lit(0))  # a row per source
    share = 200 * F.sqrt("n_docs") / F.sum(F.sqrt("n_docs")).over(every)
    f = c.select("source", "n_docs", share.alias("share")).select("source", "n_docs", F.greatest(F.lit(1), F.floor("share")).alias("base"), _r(F.col("share") - F.floor("share"), 9).alias("rest"))
    first = F.row_number().over(every.orderBy(F.col("rest").desc(), "source")) <= 200 - F.sum("base").over(every)
    return f.select("source", "n_docs", (F.col("base") + first.cast("long")).alias("quota"))


#: Labels of total rows: fixed values.
_TOTALS = ["total", "subtotal", "balance", "amount"]


@query(
    "totals_fuzzy",
    """with w as (select lang, translate(w, '015', 'ols') w, count(*) n from (select lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w from documents) where length(w) between 3 and 12 group by all),
  h as (select lang, label, w, n, levenshtein(w, label) d from w, unnest(['total', 'subtotal', 'balance', 'amount']) t(label))
  select lang, label, count(*)::bigint n_words, sum(n)::bigint n_uses, min(d)::bigint least from h where d * 100 <= 35 * length(label) group by all""",
)
def totals_fuzzy(spark, sf_dir):
    """Words within 35 % edits of a total row's label, after look-alikes are folded."""
    w = _t(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w")).filter(F.length("w").between(3, 12))
    w = w.groupBy("lang", F.translate("w", "015", "ols").alias("w")).agg(_count().alias("n"))
    h = w.select("*", F.explode(F.array(*map(F.lit, _TOTALS))).alias("label")).withColumn("d", F.levenshtein("w", "label")).filter(F.col("d") * 100 <= 35 * F.length("label"))
    return h.groupBy("lang", "label").agg(_count().alias("n_words"), F.sum("n").alias("n_uses"), F.min("d").cast("long").alias("least"))


@query(
    "smallest_container",
    """with s as (select o_custkey page, o_orderkey item, epoch(o_orderdate)::bigint a, epoch(o_orderdate)::bigint + floor(o_totalprice)::bigint * 60 b from orders),
  j as (select s.page, s.item, c.item container, c.b - c.a span from s join s c on c.page = s.page and c.a <= s.a and c.b >= s.b and c.b - c.a > s.b - s.a)
  select page, item, container from j qualify row_number() over (partition by page, item order by span, container) = 1""",
)
def smallest_container(spark, sf_dir):
    """Of each customer's orders, taken as spans of time as long as they are dear, the shortest that holds another."""
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    s = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("a"), (start + F.floor("o_totalprice") * 60).alias("b"))
    return neighbours.smallest_container(s, "o_custkey", "o_orderkey", "a", "b")


@query("contamination_guard", "select distinct doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where length(regexp_replace(b.text, '[^ ]', '', 'g')) >= 6")
def contamination_guard(spark, sf_dir):
    """Documents that hold a whole benchmark text of seven words and more."""
    # A held text's second to sixth words stand whole between blanks: they are the join key, containment decides.
    items = _t(spark, sf_dir, "benchmark").filter(F.regexp_count("text", F.lit(" ")) >= 6)
    items = items.select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(F.split("text", " "), 2, 5), " ").alias("key"))
    words = F.split("text", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.array_join(F.slice(F.col("words"), i, 5), " "))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", words.alias("words")).filter(F.size("words") >= 5)
    met = docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(items.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    held = met.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "passage"), "item_id")
    return held.filter(F.contains("text", "passage")).select("doc_id", "item_id").distinct()


#: Kinds of events: fixed values.
_KINDS = ["signup", "error", "click", "view", "purchase"]


@query(
    "nearest_zone",
    """select a.event_id, min(abs(epoch_us(a.ts) - epoch_us(b.ts)))::bigint gap_us from events a left join events b on a.user_id = b.user_id and a.event_type <> b.event_type group by a.event_id""",
)
def nearest_zone(spark, sf_dir):
    """Time from each event to the same user's nearest event of another kind."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return neighbours.nearest_other(e, "user_id", "at", "event_type", _KINDS).select("event_id", F.col("gap").alias("gap_us"))


#: Features of the confidence and their weights, the constant first: fixed values.
_WEIGHTS = [2.0, -3.0, -2.5, 0.15, -4.0]


@query(
    "confidence_score",
    """with f as (select doc_id, greatest(length(text), 1) * 1.0e0 n, length(regexp_replace(text, '[^0-9]', '', 'g')) d, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) u,
  length(regexp_replace(text, '[^ ]', '', 'g')) s, length(regexp_replace(text, '[\\p{L}0-9 ]', '', 'g')) o from documents where text is not null),
  z as (select doc_id, 1 / (1 + exp(-(2.0e0 - 3.0e0 * d / n - 2.5e0 * u / n + 0.15e0 * least(n / (s + 1), 20) - 4.0e0 * o / n))) p from f)
  select z.doc_id, round(p, 6) score, round(p, 6) < 0.8 review, round((p - quality) * (p - quality), 6) brier from z left join labels l on l.doc_id = z.doc_id""",
)
def confidence_score(spark, sf_dir):
    """Logistic confidence of a text from shares of its characters, its review flag, and its squared error where labelled."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    parts = [F.lit(1.0), count("[0-9]") / n, count(r"\p{Lu}") / n, F.least(n / (count(" ") + 1), F.lit(20.0)), count(r"[^\p{L}0-9 ]") / n]
    z = sum((w * x for w, x in zip(_WEIGHTS[1:], parts[1:], strict=True)), F.lit(_WEIGHTS[0]))
    d = _t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", (1 / (1 + F.exp(-z))).alias("p"))
    d = d.join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    off = F.col("p") - F.col("quality")
    return d.select("doc_id", _r("p").alias("score"), (_r("p") < 0.8).alias("review"), _r(off * off).alias("brier"))
