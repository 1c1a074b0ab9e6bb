"""Page images as arrays: thresholds, components, skew, rules, light, spreads, and what glyphs look like.

A page is one array: grey is float, 0 to 1, 1 paper; ink is bool.  ``on_images`` runs a function over rows (page, height, width, grey
bytes), each row alone, in Arrow batches; a page's pixels bound the memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[int, int, int, int]


def on_images(df: DataFrame, f: Callable[[np.ndarray, float], list[tuple]], schema: str, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, schema...): f of each row's grey values and dots an inch gives the row's new rows."""
    dpi = F.col("dpi") if "dpi" in df.columns else F.lit(300.0)

    def run(h, w, g, d):
        return [] if g is None else f(np.frombuffer(bytes(g), np.uint8).reshape(h, w) / 255.0, d)

    rows = F.udf(run, f"array<struct<{schema}>>", useArrow=True)
    return df.select(*keys, F.explode(rows("height", "width", "grey", dpi)).alias("_r")).select(*keys, "_r.*")


# Thresholds


def otsu(grey: np.ndarray, bins: int = 256) -> float:
    """The threshold that parts the values into two classes of the largest variance between."""
    n, edges = np.histogram(grey, bins, (0.0, 1.0))
    upto, mass = np.cumsum(n), np.cumsum(n * (edges[:-1] + edges[1:]) / 2)
    rest, total = upto[-1] - upto, mass[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = upto * rest * (mass / upto - (total - mass) / rest) ** 2
    best = np.nan_to_num(between[:-1], nan=-1.0)
    ties = np.flatnonzero(best >= best.max() * (1 - 1e-12))  # empty bins between the classes do as well: the middle one
    return float(edges[1:][ties[len(ties) // 2]])


def box_mean(a: np.ndarray, side: int) -> np.ndarray:
    """Mean over a square window of odd side around each pixel; edges repeat."""
    r = side // 2
    p = np.pad(a, r, mode="edge")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    return (s[side:, side:] - s[:-side, side:] - s[side:, :-side] + s[:-side, :-side]) / (side * side)


def sauvola(grey: np.ndarray, window: int = 41, k: float = 0.2, spread: float = 1.0) -> np.ndarray:
    """Local threshold m (1 + k (s / spread - 1)) of the window's mean and deviation; an even window is one larger."""
    side = window | 1
    m = box_mean(grey, side)
    s = np.sqrt(np.maximum(box_mean(grey * grey, side) - m * m, 0.0))
    return m * (1 + k * (s / spread - 1))


def binarized(grey: np.ndarray, how: str = "sauvola", **params) -> np.ndarray:
    return grey < (sauvola(grey, **params) if how == "sauvola" else otsu(grey, **params))


# Components


def runs_of(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the runs of ink, in reading order."""
    edge = np.diff(np.pad(ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def components(ink: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(component of each run, boxes and areas by component): 8-connected, numbered by their first run.

    Runs of neighbouring rows that touch are joined; labels shrink to the least by repeated rounds over all touching pairs at once.
    """
    row, start, stop = runs_of(ink)
    n = len(row)
    label = np.arange(n)
    # The runs of the row below that touch run i are those from the first that ends at its start or behind to the last that begins by its end.
    width = ink.shape[1] + 2
    lo = np.searchsorted(row * width + stop, (row + 1) * width + start, "left")
    hi = np.searchsorted(row * width + start, (row + 1) * width + stop, "right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(int(count.sum())) + np.repeat(lo - np.cumsum(count) + count, count)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[label]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    names, of = np.unique(label, return_inverse=True)
    m = len(names)
    area = np.bincount(of, weights=stop - start, minlength=m).astype(int)
    box = {"x0": np.full(m, ink.shape[1]), "y0": np.full(m, ink.shape[0]), "x1": np.zeros(m, int), "y1": np.zeros(m, int)}
    np.minimum.at(box["x0"], of, start)
    np.minimum.at(box["y0"], of, row)
    np.maximum.at(box["x1"], of, stop)
    np.maximum.at(box["y1"], of, row + 1)
    return of, {**box, "area": area, "first": names}


def despeckled(ink: np.ndarray, dpi: float = 300.0, least: float = 8.0) -> np.ndarray:
    """Ink without components under ``least`` pixels at 300 dots an inch."""
    of, c = components(ink)
    row, start, stop = runs_of(ink)
    out = ink.copy()
    for r, a, b in zip(*(x[(c["area"] < least * (dpi / 300) ** 2)[of]] for x in (row, start, stop)), strict=True):
        out[r, a:b] = False
    return out


def type_size(grey: np.ndarray, least: int = 30) -> float | None:
    """Median height of the components that may be glyphs; None if they are fewer than ``least``."""
    _, c = components(grey < otsu(grey))
    w, h = c["x1"] - c["x0"], c["y1"] - c["y0"]
    ok = (c["area"] >= 6) & (c["area"] <= 4000) & (h >= 3) & (h <= 120) & (w <= 8 * h) & (h <= 8 * w)
    return float(np.median(h[ok])) if ok.sum() >= least else None


def resized(grey: np.ndarray, scale: float) -> np.ndarray:
    """Grey values at another scale, between pixels by straight lines."""
    h, w = (max(1, round(n * scale)) for n in grey.shape)
    y, x = (np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in ((h, grey.shape[0]), (w, grey.shape[1])))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (grey[y0][:, x0] * (1 - fx) + grey[y0][:, x1] * fx) * (1 - fy) + (grey[y1][:, x0] * (1 - fx) + grey[y1][:, x1] * fx) * fy


def magnified(grey: np.ndarray, dpi: float, target: float = 30.0, min_dpi: float = 200.0, most: float = 4.0) -> tuple[np.ndarray, float]:
    """(grey, scale): small type, or a page of few dots an inch, made larger; others stay."""
    size = type_size(grey)
    scale = max(target / size if size and size < target else 1.0, min_dpi / dpi if dpi < min_dpi else 1.0)
    scale = min(scale, most)
    return (resized(grey, scale), scale) if scale > 1.0 else (grey, 1.0)


# Skew


def skew_by_projection(ink: np.ndarray, most: float = 5.0, coarse: float = 0.5, fine: float = 0.05, step: int = 2) -> float:
    """The angle in degrees that the rows of text rise by, where the row profile varies most; coarse angles first, then around the best.

    Coordinates are turned, not images; every ``step``-th pixel each way counts.
    """
    y, x = np.nonzero(ink[::step, ::step])
    if not len(x):
        return 0.0

    def spread(angle: float) -> float:
        t = np.radians(angle)
        at = np.round(y * np.cos(t) + x * np.sin(t)).astype(int)
        return float(np.bincount(at - at.min()).astype(float).var())

    around = lambda mid, reach, by: mid + by * np.arange(-round(reach / by), round(reach / by) + 1)
    best = max(around(0.0, most, coarse), key=lambda a: (spread(a), -abs(a)))
    return round(float(max(around(best, coarse, fine), key=lambda a: (spread(a), -abs(a)))), 6)


def skew_by_votes(boxes: dict[str, np.ndarray], most: float = 5.0, step: float = 0.25, bin_size: float = 3.0) -> float:
    """The same from one point a component, its middle and foot: the angle whose rows collect the largest sum of squared votes."""
    x, y = (boxes["x0"] + boxes["x1"]) / 2, boxes["y1"].astype(float)
    if len(x) < 3:
        return 0.0

    def votes(angle: float) -> float:
        t = np.radians(angle)
        rho = y * np.cos(t) + x * np.sin(t)
        n = np.bincount(np.round((rho - rho.min()) / bin_size).astype(int))
        return float((n.astype(float) ** 2).sum())

    angles = step * np.arange(-round(most / step), round(most / step) + 1)
    return round(float(max(angles, key=lambda a: (votes(a), -abs(a)))), 6)


def turned(grey: np.ndarray, angle: float, fill: float = 1.0) -> np.ndarray:
    """Grey values turned by an angle about the middle, nearest pixels, what comes from outside filled."""
    h, w = grey.shape
    t = np.radians(angle)
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    u = np.round(cx + (x - cx) * np.cos(t) + (y - cy) * np.sin(t)).astype(int)
    v = np.round(cy - (x - cx) * np.sin(t) + (y - cy) * np.cos(t)).astype(int)
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    return np.where(inside, grey[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)], fill)


def best_turn(votes: dict[int, tuple[int, int]], least: int = 5, margin: float = 1.5) -> int:
    """Quarter turns (0 to 3) whose reading the lexicon endorses most: votes (endorsed, words) by turn; upright unless another has
    ``least`` endorsed words and ``margin`` times upright's."""
    upright = votes.get(0, (0, 0))[0]
    turn = max(votes, key=lambda t: (votes[t][0], -t), default=0)
    return turn if votes and votes[turn][0] >= least and votes[turn][0] >= margin * upright else 0


# Light


def median_filter(a: np.ndarray, side: int) -> np.ndarray:
    """Median over a square window of odd side; edges repeat.  One row of windows at a time."""
    r = side // 2
    p = np.pad(a, r, mode="edge")
    out = np.empty_like(a)
    for y in range(a.shape[0]):
        win = np.lib.stride_tricks.sliding_window_view(p[y : y + side], side, axis=1)
        out[y] = np.median(win.transpose(1, 0, 2).reshape(a.shape[1], -1), axis=1)
    return out


def flattened(grey: np.ndarray, shrink: int = 8, side: int = 31, floor: float = 0.05) -> np.ndarray:
    """Grey over its background: shrunk, median-filtered, brought back, ``floor`` at least; clipped to 0 to 1."""
    small = resized(grey, 1 / shrink)
    back = median_filter(small, min(side, 2 * (min(small.shape) // 2) + 1))
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(grey.shape, back.shape, strict=True))
    rows = np.stack([np.interp(x, np.arange(back.shape[1]), r) for r in back])
    full = np.stack([np.interp(y, np.arange(back.shape[0]), c) for c in rows.T]).T
    return np.clip(grey / np.maximum(full, floor), 0.0, 1.0)


def dark_regions(grey: np.ndarray, cell: int = 16, dark: float = 0.45, least: int = 4, inked: float = 0.03) -> list[Box]:
    """Boxes of light type on dark ground: joined cells whose median is dark, of which some pixels are light, but not a third (pictures)."""
    h, w = (n // cell * cell for n in grey.shape)
    if not h or not w:
        return []
    cells = grey[:h, :w].reshape(h // cell, cell, w // cell, cell).transpose(0, 2, 1, 3).reshape(h // cell, w // cell, -1)
    low = np.median(cells, axis=2) < dark
    of, c = components(low)
    out = []
    for k in range(len(c["area"])):
        x0, y0, x1, y1 = (int(c[n][k]) * cell for n in ("x0", "y0", "x1", "y1"))
        light = (grey[y0:y1, x0:x1] > 0.6).mean()
        if c["area"][k] >= least and inked <= light <= 0.34 and c["area"][k] >= 0.8 * (c["x1"][k] - c["x0"][k]) * (c["y1"][k] - c["y0"][k]):
            out.append((x0, y0, x1, y1))
    return out


def inverted(grey: np.ndarray, regions: list[Box]) -> np.ndarray:
    out = grey.copy()
    for x0, y0, x1, y1 in regions:
        out[y0:y1, x0:x1] = 1.0 - out[y0:y1, x0:x1]
    return out


# Pictures, rules and spreads


def picture_zones(ink: np.ndarray, dpi: float = 300.0, share: float = 0.002, fill: float = 0.3, density: float = 0.45, cell: int = 24) -> list[Box]:
    """Boxes of pictures: large well-filled components and joined cells of dense ink, those that overlap melted; flat ones are rules."""
    size = ink.size
    _, c = components(ink)
    w, h = c["x1"] - c["x0"], c["y1"] - c["y0"]
    solid = (w * h >= share * size) & (c["area"] >= fill * w * h) & (w <= 6 * h) & (h <= 6 * w)
    found = [tuple(int(c[n][k]) for n in ("x0", "y0", "x1", "y1")) for k in np.flatnonzero(solid)]
    step = max(4, round(cell * dpi / 300))
    gh, gw = (n // step * step for n in ink.shape)
    if gh and gw:
        dense = ink[:gh, :gw].reshape(gh // step, step, gw // step, step).mean(axis=(1, 3)) > density
        _, d = components(dense)
        found += [tuple(int(d[n][k]) * step for n in ("x0", "y0", "x1", "y1")) for k in range(len(d["area"])) if d["area"][k] * step * step >= share * size]
    grown = True
    while grown:
        grown, out = False, []
        for b in found:
            k = next((i for i, o in enumerate(out) if b[0] < o[2] and o[0] < b[2] and b[1] < o[3] and o[1] < b[3]), None)
            if k is None:
                out.append(b)
            else:
                out[k] = (min(b[0], out[k][0]), min(b[1], out[k][1]), max(b[2], out[k][2]), max(b[3], out[k][3]))
                grown = True
        found = out
    return sorted(found)


def long_runs(ink: np.ndarray, least: int) -> np.ndarray:
    """Ink in horizontal runs of ``least`` pixels and more."""
    row, start, stop = runs_of(ink)
    keep = stop - start >= least
    edge = np.zeros((ink.shape[0], ink.shape[1] + 1), np.int32)
    np.add.at(edge, (row[keep], start[keep]), 1)
    np.add.at(edge, (row[keep], stop[keep]), -1)
    return edge.cumsum(axis=1)[:, :-1] > 0


def rulings(ink: np.ndarray, least: int = 100, thick: int = 8, dash: int = 6) -> list[tuple[int, int, int, int, bool]]:
    """(x0, y0, x1, y1, horizontal) of straight rules: long runs, those of dashes after gaps of up to ``dash`` pixels are closed."""
    out = []
    for horizontal in (True, False):
        a = ink if horizontal else ink.T
        row, start, stop = runs_of(a)
        closed = a.copy()
        for r, s, n, q in zip(row[:-1], stop[:-1], start[1:], row[1:], strict=True):
            if r == q and n - s <= dash:
                closed[r, s:n] = True
        _, c = components(long_runs(closed, least))
        for k in range(len(c["area"])):
            if c["y1"][k] - c["y0"][k] <= thick:
                x0, y0, x1, y1 = (int(c[n][k]) for n in ("x0", "y0", "x1", "y1"))
                out.append((x0, y0, x1, y1, True) if horizontal else (y0, x0, y1, x1, False))
    return sorted(out)


def spread_spine(ink: np.ndarray, dpi: float = 300.0, min_aspect: float = 1.15, band: float = 100.0, ratio: float = 0.12) -> int | None:
    """The column between two facing pages, or None: wide pages whose emptiest band of columns near the middle holds under ``ratio`` of
    the mean ink."""
    h, w = ink.shape
    if w < min_aspect * h:
        return None
    side = max(1, round(band * dpi / 300) // 4)
    profile = np.convolve(ink.sum(axis=0), np.ones(side) / side, "same")
    lo, hi = round(w * 0.35), round(w * 0.65)
    if not profile.any() or hi <= lo:
        return None
    low = profile[lo:hi].min()
    at = lo + np.flatnonzero(profile[lo:hi] == low)
    return int(at[len(at) // 2]) if low < ratio * profile.mean() else None


# Glyphs


def grouped_components(boxes: list[Box], side: float = 0.5, nested: float = 0.4) -> list[int]:
    """Glyph of each component, by the least member: those that share ``side`` of the narrower's width, or ``nested`` of the smaller box."""
    order, group = sorted(range(len(boxes)), key=lambda k: boxes[k][0]), list(range(len(boxes)))

    def find(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    active: list[int] = []
    for k in order:
        b = boxes[k]
        active = [j for j in active if boxes[j][2] > b[0]]
        for j in active:
            a = boxes[j]
            x = min(a[2], b[2]) - max(a[0], b[0])
            y = max(0, min(a[3], b[3]) - max(a[1], b[1]))
            small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
            if x >= side * min(a[2] - a[0], b[2] - b[0]) or x * y >= nested * small:
                low, high = sorted((find(j), find(k)))
                group[high] = low
        active.append(k)
    return [find(k) for k in range(len(boxes))]


def hole_count(ink: np.ndarray) -> int:
    """Regions of paper inside the ink, 4-connected: those that the border does not reach."""
    paper = ~np.pad(ink, 1)
    # 4-connected paper: halve the resolution's diagonals away by doubling the array and closing corners with ink.
    big = np.zeros((2 * paper.shape[0] - 1, 2 * paper.shape[1] - 1), bool)
    big[::2, ::2] = paper
    big[1::2, ::2] = paper[1:] & paper[:-1]
    big[::2, 1::2] = paper[:, 1:] & paper[:, :-1]
    big[1::2, 1::2] = paper[1:, 1:] & paper[:-1, 1:] & paper[1:, :-1] & paper[:-1, :-1]
    return len(components(big)[1]["area"]) - 1


def thinned(ink: np.ndarray) -> np.ndarray:
    """One-pixel skeleton: border pixels that connect nothing go in two alternating passes until none can."""
    a = np.pad(ink, 1).copy()
    changed = True
    while changed:
        changed = False
        for odd in (False, True):
            p = [np.roll(a, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # north, then clockwise
            n = sum(x.astype(int) for x in p)
            turns = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            open_ = ~(north & east & west) & ~(north & south & west) if odd else ~(north & east & south) & ~(east & south & west)
            gone = a & (n >= 2) & (n <= 6) & (turns == 1) & open_
            if gone.any():
                a &= ~gone
                changed = True
    return a[1:-1, 1:-1]


def skeleton_graph(ink: np.ndarray) -> dict[str, int]:
    """Ends, junctions, strokes and loops of a glyph's skeleton: strokes are what is left between junctions, loops by Euler's count."""
    s = np.pad(thinned(ink), 1)
    n = sum(np.roll(s, d, (0, 1)).astype(int) for d in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)))
    knots = s & (n >= 3)
    return {"ends": int((s & (n == 1)).sum()), "junctions": len(components(knots)[1]["area"]), "strokes": len(components(s & ~knots)[1]["area"]), "loops": hole_count(ink)}


def deslanted(ink: np.ndarray) -> np.ndarray:
    """Ink sheared upright by its second moments."""
    y, x = np.nonzero(ink)
    if len(y) < 2:
        return ink
    cy, cx = y.mean(), x.mean()
    var = ((y - cy) ** 2).mean()
    shear = -(((x - cx) * (y - cy)).mean() / var) if var > 0 else 0.0
    shift = np.round(shear * (y - cy)).astype(int)
    u = x + shift
    out = np.zeros((ink.shape[0], u.max() - min(u.min(), 0) + 1), bool)
    out[y, u - min(u.min(), 0)] = True
    return out


def glyph_features(ink: np.ndarray, zones: int = 7) -> np.ndarray:
    """Numbers that describe a glyph: ink in zones x zones cells, crossings along rows and columns, holes, skeleton counts, moments.

    The glyph is deslanted and cropped first; a blank one is all zeros.
    """
    a = deslanted(ink)
    y, x = np.nonzero(a)
    if not len(y):
        return np.zeros(zones * zones + 14 + 5 + 9)
    a = a[y.min() : y.max() + 1, x.min() : x.max() + 1]
    h, w = a.shape
    ry, rx = np.arange(h) * zones // h, np.arange(w) * zones // w
    cell = np.zeros((zones, zones))
    np.add.at(cell, (ry[np.nonzero(a)[0]], rx[np.nonzero(a)[1]]), 1.0)
    room = np.outer(np.bincount(ry, minlength=zones), np.bincount(rx, minlength=zones))
    density = np.divide(cell, room, out=np.zeros_like(cell), where=room > 0)
    rows = [(np.diff(np.pad(a[min(h - 1, int((k + 0.5) * h / 7))], 1).astype(np.int8)) == 1).sum() for k in range(7)]
    cols = [(np.diff(np.pad(a[:, min(w - 1, int((k + 0.5) * w / 7))], 1).astype(np.int8)) == 1).sum() for k in range(7)]
    g = skeleton_graph(a)
    py, px = np.nonzero(a)
    u, v = (px + 0.5) / w - 0.5, (py + 0.5) / h - 0.5
    moments = [w / h, a.mean(), u.mean(), v.mean(), (u * u).mean(), (v * v).mean(), (u * v).mean(), (u**3).mean(), (v**3).mean()]
    return np.concatenate([density.ravel(), rows, cols, [g["ends"], g["junctions"], g["strokes"], g["loops"], hole_count(a)], moments]).astype(float)


def line_strip(grey: np.ndarray, x_height: float, baseline: float, height: int = 32, target: float = 13.0, foot: int = 22) -> np.ndarray:
    """A line resampled to ``height`` rows: x-height ``target`` pixels, baseline on row ``foot``, contrast from the 2nd to the 90th
    hundredth."""
    s = target / x_height
    big = resized(grey, s)
    top = round(baseline * s) - foot
    out = np.ones((height, big.shape[1]))
    a, b = max(0, top), min(big.shape[0], top + height)
    if b > a:
        out[a - top : b - top] = big[a:b]
    lo, hi = np.percentile(out, 2), np.percentile(out, 90)
    return np.clip((out - lo) / (hi - lo), 0, 1) if hi > lo else out


# Made pages


def block_page(text: str, wrap: int = 60, cell: tuple[int, int] = (16, 10), glyph: tuple[int, int] = (10, 6), margin: int = 20) -> np.ndarray:
    """Ink of a text in which every character but a blank is a solid block: a page whose components and lines are known."""
    n = max(1, -(-len(text) // wrap))
    out = np.zeros((2 * margin + n * cell[0], 2 * margin + wrap * cell[1]), bool)
    for i, c in enumerate(text):
        if not c.isspace():
            y, x = margin + i // wrap * cell[0], margin + i % wrap * cell[1]
            out[y : y + glyph[0], x : x + glyph[1]] = True
    return out


def degraded(grey: np.ndarray, angle: float = 0.0, light: float = 0.0, blur: int = 0, flips: float = 0.0, seed: int = 0) -> np.ndarray:
    """A page made worse in the order that paper is: skewed, lit from one side, blurred, and its pixels flipped more the nearer to an edge."""
    out = turned(grey, angle) if angle else grey.copy()
    if light:
        out = out * (1 - light * np.linspace(0, 1, out.shape[1])[None, :])
    if blur:
        out = box_mean(out, 2 * blur + 1)
    if flips:
        edge = np.abs(out - box_mean(out, 3)) * 4
        hit = np.random.default_rng(seed).random(out.shape) < flips * (0.1 + np.clip(edge, 0, 1))
        out = np.where(hit, 1 - out, out)
    return np.clip(out, 0, 1)
