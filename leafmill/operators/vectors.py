"""Nearest prototypes, class statistics, votes and candidate lists over feature vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of either side that one task compares at a time.
TILE = 4096


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def near_in_tiles(queries: DataFrame, prototypes: DataFrame, q: int = 1) -> DataFrame:
    """(query, label, d): of every query's distances to the prototypes of a label, the q least.

    Both sides are dealt into tiles of about ``TILE`` rows by hash, every tile of one meets every tile of the other once, and a
    meeting keeps q distances a query and label: nothing is broadcast, and no task holds more than two tiles.
    """
    parts = lambda df: max(1, -(-df.count() // TILE))
    n_q, n_p = parts(queries), parts(prototypes)
    left = queries.select("query", "vec", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))).alias("b"))
    right = prototypes.select("label", "vec", F.pmod(F.xxhash64("label", "vec"), F.lit(n_p)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("a"))
    kinds = dict(queries.dtypes)["query"], dict(prototypes.dtypes)["label"]

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"query": mine["query"][:0], "label": theirs["label"][:0], "d": pd.Series([], dtype=float)})
        x, y = _matrix(mine["vec"]), _matrix(theirs["vec"])
        labels, code = np.unique(theirs["label"].to_numpy(), return_inverse=True)
        out = []
        for lo in range(0, len(x), 256):  # 256 x TILE differences of one dimension at a time
            d = np.zeros((len(x[lo : lo + 256]), len(y)))
            for k in range(x.shape[1]):
                d += (x[lo : lo + 256, k, None] - y[None, :, k]) ** 2
            for c, name in enumerate(labels):
                own = d[:, code == c]
                near = np.sort(own, axis=1)[:, :q] if own.shape[1] <= q else np.sort(np.partition(own, q - 1, axis=1)[:, :q], axis=1)
                out.append(pd.DataFrame({"query": np.repeat(mine["query"].to_numpy()[lo : lo + 256], near.shape[1]), "label": name, "d": np.sqrt(near).ravel()}))
        return pd.concat(out)

    schema = f"query {kinds[0]}, label {kinds[1]}, d double"
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, schema)


def nearest_classes(queries: DataFrame, prototypes: DataFrame, k: int | None = 3, q: int = 1) -> DataFrame:
    """(query, label, dist, rank): the k best classes (None: all) of each query by the mean of their q nearest prototypes.

    queries (query, vec) with distinct ids; prototypes (label, vec).  Classes with fewer than q prototypes drop out; ties by label.
    """
    near = F.row_number().over(Window.partitionBy("query", "label").orderBy("d"))
    per = near_in_tiles(queries, prototypes, q).withColumn("n", near).filter(F.col("n") <= q).groupBy("query", "label").agg(F.avg("d").alias("dist"), F.count("*").alias("m"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "label"))
    ranked = per.filter(F.col("m") >= q).withColumn("rank", rank)
    return (ranked.filter(F.col("rank") <= k) if k else ranked).select("query", "label", "dist", F.col("rank").cast("long").alias("rank"))


def floored_scales(vectors: DataFrame, vec: str = "vec", floor: float = 0.05) -> DataFrame:
    """(dim, mean, scale): each dimension's mean and deviation, which is ``floor`` of the mean deviation at least."""
    each = vectors.select(F.posexplode(vec).alias("dim", "v"))
    per = each.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    usual = F.avg("s").over(Window.partitionBy())  # a row per dimension
    return per.select("dim", "mean", F.greatest("s", floor * usual, F.lit(1e-12)).alias("scale"))


def z_scored(vectors: DataFrame, scales: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with ``vec`` centred and scaled; the scales are one row of arrays, as long as a vector."""
    order = scales.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "scale"))).alias("scales"))
    one = F.transform(F.arrays_zip(F.col(vec).alias("v"), F.col("scales").alias("s")), lambda x: (x["v"].cast("double") - x["s"]["mean"]) / x["s"]["scale"])
    return vectors.join(F.broadcast(order)).withColumn(vec, one).drop("scales")


def vote(df: DataFrame, keys: list[str], label: str, weight: str, purity: float) -> DataFrame:
    """(keys, voted, share): weighted majority label, null below the purity; '?' has no vote, weights count .05 at least."""
    mass = df.filter(F.col(label).cast("string") != "?").groupBy(*keys, label).agg(F.sum(F.greatest(F.col(weight), F.lit(0.05))).alias("_m"))
    best = mass.groupBy(*keys).agg(F.max(F.struct("_m", F.col(label).alias("_l"))).alias("_b"), F.sum("_m").alias("_t"))
    share = F.col("_b._m") / F.col("_t")
    return best.select(*keys, F.when(share >= purity, F.col("_b._l")).alias("voted"), share.alias("share"))


def softmax_candidates(df: DataFrame, key: str, dist: str) -> DataFrame:
    """Adds ``logp``: log softmax of -distance over the list's spread (1 at least), floored at 1e-9."""
    w = Window.partitionBy(key)
    z = (F.min(dist).over(w) - F.col(dist)) / F.greatest(F.stddev_pop(dist).over(w), F.lit(1.0))
    out = df.withColumn("_e", F.exp(z))
    return out.withColumn("logp", F.log(F.greatest(F.col("_e") / F.sum("_e").over(w), F.lit(1e-9)))).drop("_e")


def merge_candidates(own: DataFrame, universal: DataFrame, scale: float, k: int) -> DataFrame:
    """(query, label, dist, rank): each class at the lesser of its scaled distance in the document and its universal one; the k best."""
    both = own.select("query", "label", (F.col("dist") * scale).alias("dist")).unionByName(universal.select("query", "label", "dist"))
    least = both.groupBy("query", "label").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "label"))
    return least.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def recost(candidates: DataFrame, opinion: DataFrame, key: str, weight: float, top: int) -> DataFrame:
    """(key, cls, cost, place): costs raised by weight x (second opinion's cost - its least over the listed classes).

    Classes that the opinion does not know keep their cost.  Its ``top`` best that are not listed enter at the list's best cost and
    their excess; the list is sorted again (ties by class) and cut to the length it had.
    """
    w, by_cost = Window.partitionBy(key), Window.partitionBy(key).orderBy("nll", "cls")
    best = opinion.withColumn("nth", F.row_number().over(by_cost))
    both = candidates.select(key, "cls", "cost", F.lit(True).alias("listed")).join(best.select(key, "cls", "nll", "nth"), [key, "cls"], "full")
    both = both.withColumn("length", F.count("listed").over(w)).withColumn("first", F.min("cost").over(w))
    least = F.min(F.when(F.col("listed"), F.col("nll"))).over(w)
    excess = weight * (F.col("nll") - F.coalesce(least, F.min("nll").over(w)))
    cost = F.when(F.col("listed"), F.coalesce(F.col("cost") + excess, F.col("cost"))).when(F.col("nth") <= top, F.col("first") + excess)
    ranked = both.withColumn("cost", cost).filter(F.col("cost").isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy("cost", "cls"))
    return ranked.withColumn("place", place.cast("long")).filter(F.col("place") <= F.col("length")).select(key, "cls", "cost", "place")
