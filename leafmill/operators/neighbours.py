"""Neighbours on a page: directional links, smallest containers, nearest items of another kind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sector_links(points: DataFrame, page: str, item: str, x: str, y: str, k: int = 1, sectors: int = 8) -> DataFrame:
    """(page, src, dst, sector, length): the k nearest items of each item in each sector around it; ties go to the lesser id.

    Items meet within their page only, so a page's items, not the table, bound the pairs.
    """
    a = points.select(F.col(page).alias("page"), F.col(item).alias("src"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = points.select(F.col(page).alias("page"), F.col(item).alias("dst"), F.col(x).alias("_u"), F.col(y).alias("_v"))
    dx, dy = F.col("_u") - F.col("_x"), F.col("_v") - F.col("_y")
    sector = F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi / sectors)) % sectors
    met = a.join(b, "page").filter("src <> dst").select("page", "src", "dst", sector.alias("sector"), F.sqrt(dx * dx + dy * dy).alias("length"))
    nth = F.row_number().over(Window.partitionBy("page", "src", "sector").orderBy("length", "dst"))
    return met.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")


def with_mutual(links: DataFrame) -> DataFrame:
    """links with ``mutual``: whether the opposite link exists; ``sector_links`` gives each (src, dst) once."""
    ends = Window.partitionBy("page", F.least("src", "dst"), F.greatest("src", "dst"))
    return links.withColumn("mutual", F.count("*").over(ends) == 2)


def smallest_container(spans: DataFrame, page: str, item: str, low: str, high: str) -> DataFrame:
    """(page, item, container): the shortest strictly longer span of the page that holds the item's; ties go to the lesser id."""
    own = spans.select(F.col(page).alias("page"), F.col(item).alias("item"), F.col(low).alias("_a"), F.col(high).alias("_b"))
    by = own.select("page", F.col("item").alias("_c"), F.col("_a").alias("_l"), F.col("_b").alias("_h"))
    inside = (F.col("_l") <= F.col("_a")) & (F.col("_h") >= F.col("_b")) & (F.col("_h") - F.col("_l") > F.col("_b") - F.col("_a"))
    best = own.join(by, "page").filter(inside).groupBy("page", "item").agg(F.min(F.struct(F.col("_h") - F.col("_l"), "_c")).alias("_m"))
    return best.select("page", "item", F.col("_m._c").alias("container"))


def nearest_other(items: DataFrame, key: str, at: str, kind: str, kinds: list[str]) -> DataFrame:
    """items with ``gap``: the distance along ``at`` to the nearest item of another kind under the same key (null: none).

    One sorted pass each way instead of a join of all pairs; ``kinds`` is the closed list of kinds.
    """
    w = Window.partitionBy(key).orderBy(at)
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    gaps = []
    for k in kinds:
        seen = F.when(F.col(kind) == k, F.col(at))
        near = F.least(F.col(at) - F.max(seen).over(before), F.min(seen).over(after) - F.col(at))
        gaps.append(F.when(F.col(kind) != k, near))
    return items.withColumn("gap", F.least(*gaps))
