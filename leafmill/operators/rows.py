"""Rows across blocks: blocks whose lines share baselines, text of rows, figure columns that pull their labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_baselines(lines: DataFrame, tol: float) -> DataFrame:
    """(page, a, b, shared): for two blocks of a page, on how many baselines of a some line of b stands, within tol.

    Lines meet in equal cells of tol and the next ones, never by a bare range condition; lines (page, block, baseline).
    """
    own = lines.select("page", F.col("block").alias("a"), F.col("baseline").alias("y")).distinct()
    cell = F.floor(F.col("y") / tol)
    mine = own.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    theirs = own.select("page", F.col("a").alias("b"), F.col("y").alias("z"), cell.alias("cell"))
    met = mine.join(theirs, ["page", "cell"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("y") - F.col("z")) <= tol))
    return met.groupBy("page", "a", "b").agg(F.countDistinct("y").alias("shared"))


#: Blocks of a page that are held against as many others at once.
TILE = 2_048


def _pairs(ys: pa.Array, left: np.ndarray, right: np.ndarray, tol: float, min_lines: int, share: float) -> tuple[np.ndarray, ...]:
    """Of blocks' baselines: which of the left agree with which of the right, on how many baselines of the one and of the other."""
    n = np.diff(ys.offsets.to_numpy())
    values, at = np.unique(ys.flatten().to_numpy(zero_copy_only=False).astype(float), return_inverse=True)
    own = np.zeros((len(n), len(values) + 1), np.float32)
    own[np.repeat(np.arange(len(n)), n), at + 1] = 1
    # Of each value, the stretch of those within tol; a step either way where the difference rounds otherwise.
    gap = lambda k: np.abs(values[np.clip(k, 0, len(values) - 1)] - values)
    lo, hi = np.searchsorted(values, values - tol, "left"), np.searchsorted(values, values + tol, "right")
    lo = lo - ((lo > 0) & (gap(lo - 1) <= tol)) + (gap(lo) > tol)
    hi = hi + ((hi < len(values)) & (gap(hi) <= tol)) - (gap(hi - 1) > tol)
    upto = np.cumsum(own, axis=1)
    near, own = (upto[:, hi] > upto[:, lo]).astype(np.float32), own[:, 1:]
    there, back = own[left] @ near[right].T, near[left] @ own[right].T
    ok = (np.minimum(there, back) >= min_lines) & (there >= share * n[left, None] - 1e-9) & (back >= share * n[None, right] - 1e-9)
    i, j = np.nonzero(ok)
    return left[i], right[j], there[i, j].astype(np.int64), back[i, j].astype(np.int64)


def row_read_pairs(lines: DataFrame, min_lines: int = 3, tol: float = 0.5, share: float = 0.6, max_words: float = 4) -> DataFrame:
    """(page, a, b, shared): pairs of blocks, a < b, that are read by rows: ``share`` of the baselines of each are the other's.

    lines (page, block, baseline, n_words); blocks of fewer than ``min_lines`` baselines, or of more than ``max_words`` words a
    line in the median, are prose or too short, and drop out before blocks meet.  Blocks meet in tiles of a page, whole ones at a time:
    only pairs that agree become rows.
    """
    lines = lines.filter("page is not null and block is not null")
    per = lines.groupBy("page", "block").agg(F.collect_set("baseline").alias("ys"), F.percentile("n_words", 0.5).alias("words"))
    able = per.filter((F.size("ys") >= min_lines) & (F.col("words") <= max_words)).select("page", "block", "ys")
    page = Window.partitionBy("page")
    able = able.withColumn("tile", F.floor((F.row_number().over(page.orderBy("block")) - 1) / TILE)).withColumn("last", F.max("tile").over(page))
    met = able.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = met.select("page", "block", "ys", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    kinds = dict(lines.dtypes)

    def read(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        tile, block = t["tile"].to_numpy(), t["block"].combine_chunks()
        p, q, there, back = _pairs(t["ys"].combine_chunks(), np.flatnonzero(tile == i), np.flatnonzero(tile == j), tol, min_lines, share)
        if i == j:
            p, q, there, back = (x[p < q] for x in (p, q, there, back))
        first = pa.repeat(t["page"][0], len(p))
        return pa.table({"page": first, "p": block.take(pa.array(p)), "q": block.take(pa.array(q)), "there": pa.array(there), "back": pa.array(back)})

    found = met.groupBy("page", "i", "j").applyInArrow(read, f"page {kinds['page']}, p {kinds['block']}, q {kinds['block']}, there long, back long")
    return found.select("page", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("there")).otherwise(F.col("back")).alias("shared"))


def row_numbers(items: DataFrame, keys: list[str], at: str, order: list[str], tol: float) -> DataFrame:
    """items with ``row_no`` (from 0): a new row where the step from the item before is over tol."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.when(F.col(at) - F.lag(at).over(w) > tol, 1).otherwise(0)
    return items.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(w)).drop("_new")


def rows_text(items: DataFrame, keys: list[str], at: str, order: list[str], text: str, tol: float, sep: str = "  ") -> DataFrame:
    """(keys, row_no, line, n): the texts of each row, joined in the order of ``order`` columns."""
    rows = row_numbers(items, keys, at, order, tol)
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))  # the items of a row
    return rows.groupBy(*keys, "row_no").agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias("line"), F.count("*").alias("n"))
