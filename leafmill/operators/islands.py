"""Gaps and islands over ordered values, interval unions and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_levels(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Groups of values whose step from the previous one is at most tol: (keys, level, mean, size)."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) > tol, 1).otherwise(0)
    level = F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_new", new).withColumn("level", level.cast("long"))
    return marked.groupBy(*keys, "level").agg(F.avg(value).alias("mean"), F.count("*").alias("size"))


def interval_union(df: DataFrame, keys: list[str], start: Column, stop: Column) -> DataFrame:
    """Covered length and hull of the intervals of each key: (keys, covered, hull, n)."""
    own = df.select(*keys, start.alias("_a"), stop.alias("_b")).filter("_b >= _a")
    w = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("_b").over(w)
    part = F.greatest(F.lit(0), F.col("_b") - F.greatest("_a", F.coalesce(before, F.col("_a"))))
    return own.withColumn("_part", part).groupBy(*keys).agg(F.sum("_part").alias("covered"), (F.max("_b") - F.min("_a")).alias("hull"), F.count("*").alias("n"))


def band_join(points: DataFrame, bands: DataFrame, x: str, low: str, high: str, width: float, *on: str) -> DataFrame:
    """Points with the bands [low, high) that hold them, by equal cells of ``width`` and never by a bare range condition."""
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    left = points.withColumn("_cell", F.floor(F.col(x) / width))
    right = bands.withColumn("_cell", cells)
    return left.join(right, ["_cell", *on]).filter((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("_cell")
