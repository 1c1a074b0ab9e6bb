"""Calibration against a known sheet: the affine map between drawn and found points, and parameters by the distance of histograms.

Both work from sums: the map from a key's moments, the distance from the running difference of two histograms, whose rows are distinct
values with counts, however many samples there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def affine_maps(points: DataFrame, keys: list[str], least: float = 1e-9) -> DataFrame:
    """(keys, n, a, b, c, d, e, f, error): u = a x + b y + c and v = d x + e y + f by least squares over points (keys, x, y, u, v).

    error is the root of the mean squared distance left.  Keys whose points lie on a line (determinant of the moments under ``least``)
    have no map and no row.
    """
    cov = lambda p, q: F.covar_pop(p, q).alias(f"{p}{q}")
    pairs = [("x", "x"), ("x", "y"), ("y", "y"), ("x", "u"), ("y", "u"), ("u", "u"), ("x", "v"), ("y", "v"), ("v", "v")]
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyuv"], *[cov(*p) for p in pairs])
    m = m.withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).filter(F.col("det") > least)

    def line(t: str) -> list[Column]:
        first = (F.col(f"x{t}") * F.col("yy") - F.col(f"y{t}") * F.col("xy")) / F.col("det")
        second = (F.col(f"y{t}") * F.col("xx") - F.col(f"x{t}") * F.col("xy")) / F.col("det")
        return [first, second, F.col(f"m{t}") - first * F.col("mx") - second * F.col("my"), F.col(f"{t}{t}") - first * F.col(f"x{t}") - second * F.col(f"y{t}")]

    (a, b, c, lu), (d, e, f, lv) = line("u"), line("v")
    named = [v.alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)]
    return m.select(*keys, "n", *named, F.sqrt(F.greatest(lu + lv, F.lit(0.0))).alias("error"))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n)."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def distances(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distance): the mean distance by which the mass of one histogram must move to become the other, by key.

    Histograms are (keys, value, n).  The area between both running shares; keys that only one of them has have no row.
    """
    both = one.select(*keys, "value", F.col("n").alias("p"), F.lit(0).cast("long").alias("q")).unionByName(two.select(*keys, "value", F.lit(0).cast("long").alias("p"), F.col("n").alias("q")))
    both = both.groupBy(*keys, "value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy(*keys)
    up = w.orderBy("value")
    share = lambda c: F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(c).over(w)
    step = F.lead("value").over(up) - F.col("value")
    parts = both.withColumns({"_p": F.sum("p").over(w), "_q": F.sum("q").over(w)}).filter("_p > 0 and _q > 0")
    parts = parts.withColumn("part", F.abs(share("p") - share("q")) * step)
    return parts.groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("distance"))


def nearest_parameter(tried: DataFrame, seen: DataFrame, keys: list[str], parameter: str) -> DataFrame:
    """(keys, parameter, distance): the parameter whose histogram comes nearest to what was seen; ties: the least.

    tried (keys, parameter, value, n), seen (keys, value, n); seen is given to every parameter that was tried.
    """
    at = tried.select(*keys, parameter).distinct()
    d = distances(tried, seen.join(at, keys), [*keys, parameter])
    best = F.min(F.struct(F.round("distance", 9).alias("distance"), F.col(parameter)))
    return d.groupBy(*keys).agg(best.alias("m")).select(*keys, f"m.{parameter}", "m.distance")
