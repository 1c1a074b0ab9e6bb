"""Ranks, quantiles and areas over groups of any size: no window or aggregate holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which a group is ranked first, and ranges in which running sums go.
PARTS, RANGES = 16, 256


def top_ranked(df: DataFrame, group: list[str], order: list, top: int, salt: list[str]) -> DataFrame:
    """df with ``rank`` (from 1) of the ``top`` first rows of each group in the order, which must tell rows apart.

    Rows are ranked in ``PARTS`` parts of a group by a hash of the salt columns, each keeps ``top``, and only these are ranked
    together: a task has PARTS x top rows at most in the last step.
    """
    part = F.pmod(F.xxhash64(*salt), F.lit(PARTS))
    kept = df.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    kept = kept.filter(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("_part")


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """(keys, name): the interpolated quantile of each group, exact, nulls left out.

    A sketch brackets it (its rank is off by a ten-thousandth at most), rows outside the bracket are counted, and only the
    distinct values inside, some ten-thousandths of the group, are ordered.
    """
    own = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    around = [max(0.0, q - 3e-4), min(1.0, q + 3e-4)]
    bracket = own.groupBy(*keys).agg(F.percentile_approx("v", around, 10_000).alias("b"), F.count("*").alias("n"))
    met = own.join(bracket, keys) if keys else own.join(F.broadcast(bracket))
    side = F.when(F.col("v") < F.col("b")[0], -1).when(F.col("v") > F.col("b")[1], 1).otherwise(0)
    # One row for all below and one for all above, standing for their nearest value, and one for each distinct value inside.
    per = met.withColumn("side", side).groupBy(*keys, "n", "side", F.when(F.col("side") == 0, F.col("v")).alias("inside"))
    per = per.agg(F.count("*").alias("m"), F.when(F.col("side") > 0, F.min("v")).otherwise(F.max("v")).alias("v"))
    ends = per.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys).orderBy("side", "inside")))
    at = F.lit(q) * (F.col("n") - 1)
    first = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    found = ends.groupBy(*keys).agg(first(F.floor(at)).alias("lo"), first(F.ceil(at)).alias("hi"), F.first(at - F.floor(at)).alias("part"))
    return found.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(name))


def running_sum(df: DataFrame, keys: list[str], at: str, amount: str, name: str) -> DataFrame:
    """df with the sum of ``amount`` over the group's rows up to and including this value of ``at`` (distinct within the group).

    Rows are cut into ranges of ``at`` by a sketch, ranges are summed before rows are, so that a task holds a range of a group.
    """
    bounds = df.groupBy(*keys).agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("_bounds"))
    cut = df.join(bounds, keys).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(at)))).drop("_bounds")
    sums = cut.groupBy(*keys, "_range").agg(F.sum(amount).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_s")  # a row per range
    within = F.sum(amount).over(Window.partitionBy(*keys, "_range").orderBy(at))
    return cut.join(sums.select(*keys, "_range", before.alias("_before")), [*keys, "_range"]).withColumn(name, within + F.col("_before")).drop("_range", "_before")


def rank_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, auc, n): share of (1, 0) pairs that the score orders rightly, ties half; null without both labels."""
    own = df.select(*keys, F.col(score).alias("x"), F.col(label).cast("long").alias("y")).filter("x is not null and y is not null")
    per = own.groupBy(*keys, "x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = running_sum(per, keys, "x", "neg", "below")
    right = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*keys).agg((right / F.nullif(pairs, F.lit(0))).alias("auc"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
