"""Mixing sources to target weights by pivotal rounding, in DataFrame functions only.

Sources, in code-point order with null last, weigh by a repeating list and share a budget of words; a target stops at a bound
times its source's size, and what exceeds it is shared again by weight.  A document's wanted copies are its source's target over
its source's size.  Whole copies are given; the fractions are rounded by pivoting: two fractions of a source play, the loser
becomes 0 or 1, and the winner carries the mass on.  Documents of like size play first, in blocks of bounded size; what a block
leaves over plays in the next level of the tree, up to one document for each source, which a last draw decides.  So every
document keeps its chance, every block's copies are right to less than one, and so are the words, nearly.

Rows equal in every column are one player with their number: units that play among themselves first end as so many copies and one
open fraction, which is worked out at once, so that no block grows with repeated rows.

All draws are hashes of a seed and the players, so reruns agree whatever the partitioning.

Defined results: a null text has size 0; a source without words, or an empty table, has target 0 and takes nothing; rows that
repeat each other are documents of their own; a null doc_id is a document like any other; extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.rows import free_names, row_hash
from leafmill.staging import materialize, release

#: Documents that play one after the other in one task.
BLOCK = 200
WORD = r"[^\x20\x09-\x0D]+"


#: Equal rows that one task writes out at a time.
CHUNK = 100_000


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, tie, rows): words between ASCII blanks, a hash of the row for fixed orders, and how many rows are equal."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), row_hash(docs).alias("tie"))
    return own.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("rows"))


def source_targets(sized: DataFrame, weights: list[float], share: float, bound: float) -> DataFrame:
    """(source, source_size, target): a row per source."""
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    per = materialize(per, "sources")
    # Place of each source in code-point order: rows are numbered within ranges, and the ranges' counts are added up.
    ranges = materialize(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    placed = ranges.withColumn("_row", place).join(before, "_part").withColumn("_at", ((F.col("_row") + F.col("_before")) % len(weights)).cast("int"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("_at"))
    placed = materialize(placed.select("source", "source_size", weight.alias("weight")), "weights")
    release(per), release(ranges)
    # Water filling: words for each unit of weight, among the sources that the bound does not hold.
    budget = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    each = None
    while True:
        cap = F.lit(bound) * F.col("source_size")
        held = F.lit(False) if each is None else F.col("weight") * F.lit(each) >= cap
        got = placed.agg(F.sum(F.when(held, cap).otherwise(0.0)).alias("held"), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(held, 1)).alias("n")).first()
        new = (budget - (got["held"] or 0.0)) / got["free"] if got["free"] else 0.0
        if each is not None and (got["n"] == n or not got["free"]):
            break
        each, n = new, got["n"]
    cap = F.lit(bound) * F.col("source_size")
    return placed.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(each)).alias("target"))


def _uniform(seed: int, *parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


_UNIT = "struct<size:bigint,tie:bigint,doc_id:{0},p:double>"
_DONE = "array<struct<copy:int,size:bigint,doc_id:{0},tie:bigint>>"


def _play(units: Column, kind: str, seed: int) -> Column:
    """struct(left, done): units in order pair off; ``left`` is the one whose fraction is still open, if any."""
    unit, done = _UNIT.format(kind), _DONE.format(kind)
    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(done).alias("done"))

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["tie"].alias("tie"), u["doc_id"].alias("doc_id"), p.alias("p"))

    def settled(u: Column, copy: Column) -> Column:
        return F.array(F.struct(copy.cast("int").alias("copy"), u["size"].alias("size"), u["doc_id"].alias("doc_id"), u["tie"].alias("tie")))

    def step(state: Column, x: Column) -> Column:
        a = state["left"]
        total = a["p"] + x["p"]
        low = total < 1
        # Below one in all, the loser gets nothing; else it gets a copy.  The chances keep every unit's expectation.
        first = F.when(low, a["p"] / F.greatest(total, F.lit(1e-300))).otherwise((F.lit(1.0) - x["p"]) / F.greatest(F.lit(2.0) - total, F.lit(1e-300)))
        draw = _uniform(seed, a["doc_id"], a["tie"], x["doc_id"], x["tie"], a["size"], x["size"]) < first
        # draw: the first unit carries the sum on (low), or is the one with a copy.
        carries = F.when(draw == low, a).otherwise(x)
        settles = F.when(draw == low, x).otherwise(a)
        played = F.struct(
            with_p(carries, F.when(low, total).otherwise(total - 1)).alias("left"),
            F.concat(state["done"], settled(settles, F.when(low, 0).otherwise(1))).alias("done"),
        )
        return F.when(a.isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).otherwise(played)

    return F.aggregate(units, start, step)


def _settled(docs: DataFrame, weights, share: float, bound: float, seed: int, text: str, doc_id: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Groups of equal rows (doc_id, source, size, tie, rows, whole, more, source_size, target): each row has ``whole`` copies, and
    the group ``more`` beside them, one a row; and what holds the parts, to release."""
    sized = materialize(sizes(docs, text, doc_id, source), "sizes")
    targets = materialize(source_targets(sized, list(weights), share, bound), "targets")
    kind = dict(sized.dtypes)["doc_id"]
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(bound)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor("rate").cast("long")).withColumn("mass", F.col("rows") * (F.col("rate") - F.col("whole")))
    rows = rows.withColumn("p", F.col("mass") - F.floor("mass"))
    # Classes of like size, eight to a doubling, and in each as many blocks as its groups fill.
    klass = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    rows = materialize(rows.withColumn("klass", klass), "groups")
    # Counts: per source and class, summed before the shuffle; classes are some hundreds at most for any size of text.
    filled = rows.groupBy("source", "klass").agg(F.count("*").alias("n"))
    filled = materialize(filled.select(F.col("source").alias("_source"), F.col("klass").alias("_klass"), F.ceil(F.col("n") / BLOCK).alias("blocks")), "filled")
    most = filled.agg(F.max("blocks")).first()[0] or 1
    unit = F.struct("size", "tie", "doc_id", "p")
    block = F.pmod(F.xxhash64("tie", F.lit(seed)), F.col("blocks"))
    level = rows.join(filled, F.col("source").eqNullSafe(F.col("_source")) & (F.col("klass") == F.col("_klass")))
    level = level.select("source", F.col("klass").alias("klass"), block.alias("block"), unit.alias("unit"))
    settled, made = [], [sized, targets, rows, filled]
    keys = [["source", "klass", "block"]]
    step = most
    while step > 1:  # blocks of a class meet
        keys.append(["source", "klass", "block"])
        step = -(-step // BLOCK)
    keys += [["source", "klass"], ["source"]]
    for depth, key in enumerate(keys):
        own = [F.col(k) for k in key]
        played = level.groupBy(*own).agg(_play(F.sort_array(F.collect_list("unit")), kind, seed + depth).alias("out"))
        played = materialize(played, "played")
        made.append(played)
        settled.append(played.select("source", F.explode("out.done").alias("u")).select("source", "u.copy", "u.size", "u.doc_id", "u.tie"))
        rest = played.filter("out.left is not null")
        columns = {"source": F.col("source"), "klass": F.col("klass") if "klass" in key else F.lit(0), "block": F.floor(F.col("block") / BLOCK) if "block" in key else F.lit(0).cast("long")}
        level = rest.select(*[c.alias(k) for k, c in columns.items()], F.col("out.left").alias("unit"))
    last = level.select("source", (_uniform(seed - 1, F.col("unit.doc_id"), F.col("unit.tie")) < F.col("unit.p")).cast("int").alias("copy"), "unit.size", "unit.doc_id", "unit.tie")
    settled.append(last)
    drawn = settled[0]
    for s in settled[1:]:
        drawn = drawn.unionByName(s)
    names = ["source", "doc_id", "tie", "size"]
    drawn = drawn.select(*[F.col(c).alias(f"_{c}") for c in names], "copy")
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(drawn, same).withColumn("more", F.floor("mass").cast("long") + F.col("copy"))
    return out.select("doc_id", "source", "size", "tie", "rows", "whole", "more", "source_size", "target"), made


def _spread(df: DataFrame, n: str, number: str, salt: str) -> DataFrame:
    """Each row as often as its column ``n`` says, numbered from 1 in ``number``: large numbers are dealt over tasks before they are written out."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))
    small = df.filter(F.col(n).between(1, CHUNK)).withColumn(salt, F.lit(0).cast("long"))
    large = df.filter(F.col(n) > CHUNK).withColumn(salt, F.explode(chunks)).repartition(F.col(salt))
    span = F.sequence(F.col(salt) * CHUNK + 1, F.least(F.col(n), (F.col(salt) + 1) * CHUNK))
    return small.unionByName(large).withColumn(number, F.explode(span)).drop(salt)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    bound: float = 2.0,
    seed: int = 20,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): a row for each row of docs."""
    groups, made = _settled(docs, weights, share, bound, seed, text, doc_id, source)
    groups = materialize(groups, "copies")
    for m in made:
        release(m)
    each = _spread(groups, "rows", "nth", "part")
    copies = (F.col("whole") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)).cast("int")
    return each.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def taken_documents(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    bound: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """docs with each row as often as the mix takes it; every repeat has the same columns.

    Rows equal in every column stand for each other: their copies together are written from one of them.
    """
    groups, made = _settled(docs, weights, share, bound, seed, text, doc_id, source)
    total = F.col("rows") * F.col("whole") + F.col("more")
    groups = materialize(groups.select("doc_id", "tie", "rows", total.alias("n")), "copies")
    for m in made:
        release(m)
    own_id, tie, own, count, copies, nth, part = free_names(docs.columns, "row_id", "row_tie", "row_own", "row_count", "row_copies", "row_nth", "row_part")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    groups = groups.select(F.col("doc_id").alias(own_id), F.col("tie").alias(tie), F.col("rows").alias(count), F.col("n").alias(copies)).filter(F.col(copies) > 0)
    # A row per document on either side: sorted at every size, never broadcast.
    on = F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(tie))
    hashed = docs.withColumn(own, row_hash(docs))
    # One row takes as many copies as the bound lets it.
    out = hashed.join(groups.filter(F.col(count) == 1).hint("merge"), on).withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*columns)
    many = groups.filter(F.col(count) > 1)
    if many.isEmpty():
        return out
    found = hashed.join(many, on).groupBy(own_id, tie, copies).agg(*[F.first(c).alias(f"{own}_{i}") for i, c in enumerate(columns)])
    found = found.select(copies, *[F.col(f"{own}_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.unionByName(_spread(materialize(found, "repeated"), copies, nth, part).select(*columns))
