"""Reading order of boxes by recursive cuts, and one-to-one matching of boxes; a page is one group, bound by its boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.wordtables import on_pages

Box = tuple[float, float, float, float]


def _widest(boxes: list[Box], idx: list[int], axis: int) -> tuple[float, float]:
    """(width, place) of the widest empty strip across an axis (0: between columns, 1: between rows); width 0: none."""
    spans = sorted((boxes[i][axis], boxes[i][axis + 2]) for i in idx)
    best, end = (0.0, 0.0), spans[0][1]
    for a, b in spans[1:]:
        if a - end > best[0]:
            best = (a - end, (a + end) / 2)
        end = max(end, b)
    return best


def cut_order(boxes: list[Box], prefer: str = "v", least: float = 0.0) -> list[int]:
    """Order of the boxes: cut at the widest gap of the preferred axis ('v': columns first), else of the other, and so on inside.

    What no gap wider than ``least`` cuts is read by top, then left edge.
    """
    order, open_ = [], [list(range(len(boxes)))] if boxes else []
    while open_:
        idx = open_.pop()
        for axis in (0, 1) if prefer == "v" else (1, 0):
            width, at = _widest(boxes, idx, axis)
            if width > least:
                open_ += [[i for i in idx if boxes[i][axis] >= at], [i for i in idx if boxes[i][axis] < at]]
                break
        else:
            order += sorted(idx, key=lambda i: (boxes[i][1], boxes[i][0], i))
    return order


def reading_order(df: DataFrame, page: str, item: str, prefer: str = "v", least: float = 0.0) -> DataFrame:
    """(page, item, place) for boxes in columns x0, y0, x1, y1; rows that lack a coordinate are left out."""

    box = ["x0", "y0", "x1", "y1"]

    def run(rows: list) -> list[tuple]:
        return [(rows[k][item], n) for n, k in enumerate(cut_order([tuple(r[c] for c in box) for r in rows], prefer, least))]

    own = df.select(page, item, *(F.col(c).cast("double").alias(c) for c in box)).dropna()
    return on_pages(own, [item, *box], run, f"`{item}` {dict(df.dtypes)[item]}, place long", page)


def overlap(a: str, b: str):
    """Intersection over union of two struct columns (x0, y0, x1, y1)."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(f"{a}.{hi}", f"{b}.{hi}") - F.greatest(f"{a}.{lo}", f"{b}.{lo}"))
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    inter = side("x0", "x1") * side("y0", "y1")
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-9))


def match_boxes(found: DataFrame, truth: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """(page, found, truth, iou): greedy one-to-one pairs by falling overlap of at least ``least``; ties by ids.

    Both tables have (page, id, box struct).
    """
    f = found.select(page, F.col("id").alias("found"), F.col("box").alias("_f"))
    t = truth.select(page, F.col("id").alias("truth"), F.col("box").alias("_t"))
    met = f.join(t, page).select(page, "found", "truth", overlap("_f", "_t").alias("iou")).filter(F.col("iou") >= least)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        keep, a, b = [], set(), set()
        p = p.sort_values(["iou", "found", "truth"], ascending=[False, True, True], kind="stable")
        for i, x, y in zip(p.index, p["found"], p["truth"], strict=True):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                keep.append(i)
        return p.loc[keep]

    return met.groupBy(page).applyInPandas(run, met.schema)


def detection_scores(found: DataFrame, truth: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """One row: n_found, n_truth, n_matched, precision, recall, f1 over all pages; empty sides score 0."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(found, "n_found").join(n(truth, "n_truth")).join(n(match_boxes(found, truth, page, least), "n_matched"))  # a row each
    share = lambda c: F.coalesce(F.try_divide("n_matched", c), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("n_matched"), F.col("n_found") + F.col("n_truth")), F.lit(0.0))
    return counts.select("*", share(F.col("n_found")).alias("precision"), share(F.col("n_truth")).alias("recall"), f1.alias("f1"))
