"""What posteriors and distances say: rejection limits and greedy labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import ranks


def reject_above(df: DataFrame, keys: list[str], value: str, k: float = 3.0, fallback: float = 0.2) -> DataFrame:
    """Rows above their group's median by k median absolute deviations (``fallback`` x median where that is 0), with ``limit_at``."""
    med = ranks.exact_quantile(df, keys, value, 0.5, "med")  # a row per group
    off = df.join(med, keys).withColumn("_off", F.abs(F.col(value) - F.col("med")))
    mad = ranks.exact_quantile(off, keys, "_off", 0.5, "mad")
    spread = F.when(F.col("mad") > 0, F.col("mad")).otherwise(fallback * F.col("med"))
    limits = med.join(mad, keys).select(*keys, (F.col("med") + k * spread).alias("limit_at"))
    return df.join(limits, keys).filter(F.col(value) > F.col("limit_at"))


def greedy_labels(frames: DataFrame, key: str, frame: str, label: str, blank: str) -> DataFrame:
    """(key, labels, at): each sequence's best labels with repeats collapsed and blanks dropped, and the frames where they begin."""
    w = Window.partitionBy(key).orderBy(frame)
    before = F.lag(label).over(w)
    starts = frames.withColumn("_new", before.isNull() | (before != F.col(label))).filter(F.col("_new"))
    one = F.struct(F.col(frame).alias("at"), F.col(label).alias("label"))
    # A sequence of blanks only has no labels, but stays.
    got = starts.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col(label) != blank, one))).alias("s"))
    return got.select(key, F.transform("s", lambda x: x["label"]).alias("labels"), F.transform("s", lambda x: x["at"]).alias("at"))
