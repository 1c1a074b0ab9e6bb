"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins; no neighbour list is ever gathered, so a node with a third of all edges
costs a skewed join (which AQE splits) and nothing else.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.staging import materialize, release


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs (u, v): link v (and u, for the small star) to the least of u's neighbourhood.

    The minima are a table of their own: a join between two plain shuffles is one whose hot node can be split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, "least")
    joined = pairs.join(least, "u")
    if keep_larger:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    tops = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(tops).filter("a <> b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge between two different nodes touches.

    ``component`` is the least node id reachable.  Null ends, loops and repeated edges are ignored; an empty edge table
    gives an empty result.  Raises if the rounds do not settle (they need about log(n) rounds, squared at worst).
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, seen = materialize(e, "edges"), None
    for _ in range(max_rounds):
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = (state["n"], state["h"])
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, keep_larger=True)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        new = materialize(_star(down, keep_larger=False).distinct(), "edges")
        release(cur)
        cur = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
