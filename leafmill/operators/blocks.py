"""Blocks of a page from links, boxes, levels and lines; a page is one group, bound by its components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import rows as R
from leafmill.operators.wordtables import BOX, on_pages

Box = tuple[float, float, float, float]


def _hull(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _meet(a: Box, b: Box) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def strong_components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Least member of each of n nodes' strongly connected component: forward order of finishing, then backward reach."""
    ahead, back = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in links:
        ahead[a].append(b)
        back[b].append(a)
    seen, order = [False] * n, []
    for s in range(n):
        if seen[s]:
            continue
        seen[s], open_ = True, [(s, iter(ahead[s]))]
        while open_:
            v, rest = open_[-1]
            w = next((w for w in rest if not seen[w]), None)
            if w is None:
                order.append(v)
                open_.pop()
            else:
                seen[w] = True
                open_.append((w, iter(ahead[w])))
    label = [-1] * n
    for s in reversed(order):
        if label[s] >= 0:
            continue
        members, open_ = [], [s]
        label[s] = s
        while open_:
            v = open_.pop()
            members.append(v)
            for w in back[v]:
                if label[w] < 0:
                    label[w] = s
                    open_.append(w)
        least = min(members)
        for v in members:
            label[v] = least
    return label


def melted(boxes: list[Box]) -> list[int]:
    """Group of each box, by the least member: boxes whose hulls overlap are one, until none do."""
    group = list(range(len(boxes)))
    hull = dict(enumerate(boxes))
    grown = True
    while grown:
        grown = False
        # Only neighbours along x can overlap: a sweep, repeated while hulls grow.
        order, active = sorted(hull, key=lambda g: hull[g][0]), []
        for g in order:
            active = [o for o in active if hull[o][2] > hull[g][0]]
            o = next((o for o in active if _meet(hull[o], hull[g])), None)
            if o is not None:
                a, b = min(o, g), max(o, g)
                hull[a] = _hull([hull[a], hull.pop(b)])
                group = [a if x == b else x for x in group]
                grown = True
                break
            active.append(g)
    return group


def scc_blocks(links: DataFrame, items: DataFrame, factor: float = 1.5, reach: float = 5.0) -> DataFrame:
    """(page, item, block): strongly connected components of the links that are short enough, those whose boxes overlap melted.

    A link (page, src, dst, length) is kept up to ``factor`` times the page's mean length and ``reach`` times the larger of its ends'
    heights.  items (page, item, x0, y0, x1, y1); a block is named by its least item.
    """
    size = items.select("page", F.col("item").alias("src"), (F.col("y1") - F.col("y0")).alias("h"))
    mean = links.groupBy("page").agg(F.avg("length").alias("mean"))
    short = links.join(mean, "page").join(size, ["page", "src"]).join(size.withColumnsRenamed({"src": "dst", "h": "g"}), ["page", "dst"])
    short = short.filter((F.col("length") <= factor * F.col("mean")) & (F.col("length") <= reach * F.greatest("h", "g")))
    out = short.groupBy("page", F.col("src").alias("item")).agg(F.collect_list("dst").alias("to"))  # an item's links, k a sector

    def blocks(rows: list) -> list[tuple]:
        at = {r["item"]: k for k, r in enumerate(rows)}
        label = strong_components(len(rows), [(k, at[d]) for k, r in enumerate(rows) for d in r["to"] or []])
        names = sorted(set(label))
        hulls = [_hull([tuple(r[c] for c in BOX) for r, l in zip(rows, label, strict=True) if l == n]) for n in names]
        joined = dict(zip(names, melted(hulls), strict=True))
        return [(r["item"], rows[names[joined[l]]]["item"]) for r, l in zip(rows, label, strict=True)]

    kind = dict(items.dtypes)["item"]
    return on_pages(items.join(out, ["page", "item"], "left"), ["item", *BOX, "to"], blocks, f"item {kind}, block {kind}")


def dash_blocks(components: DataFrame, blocks: DataFrame, least: float, aspect: float = 1.5, fill: float = 0.7) -> DataFrame:
    """Components (page, item, x0, y0, x1, y1, ink) that are flat, solid, ``least`` wide and in no block: blocks of their own."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = components.filter((w >= least) & (w >= aspect * h) & (F.col("ink") >= fill * w * h))
    b = blocks.select("page", *[F.col(c).alias(f"b{c}") for c in BOX])
    inside = (F.col("x0") < F.col("bx1")) & (F.col("bx0") < F.col("x1")) & (F.col("y0") < F.col("by1")) & (F.col("by0") < F.col("y1"))
    held = flat.join(b, "page").filter(inside).select("page", "item").distinct()
    return flat.join(held, ["page", "item"], "left_anti")


def _continued(boxes: list[Box], gap: float, narrow: float, wide: float) -> list[int]:
    order = list(range(len(boxes)))
    moved: set[tuple[int, int]] = set()
    again = True
    while again:
        again = False
        for at, k in enumerate(order):
            b = boxes[k]
            best = None
            for j in order[:at]:
                a = boxes[j]
                common = min(a[2], b[2]) - max(a[0], b[0])
                small, large = sorted((a[2] - a[0], b[2] - b[0]))
                below = 0 <= b[1] - a[3] <= gap
                if below and common >= narrow * small and common >= wide * large and (best is None or a[3] > boxes[best][3]):
                    best = j
            if best is None or (best, k) in moved:
                continue
            place = order.index(best)
            between = order[place + 1 : at]
            if between and all(boxes[m][0] >= min(boxes[best][2], b[2]) and boxes[m][1] < b[3] for m in between):
                order.pop(at)
                order.insert(place + 1, k)
                moved.add((best, k))
                again = True
                break
    return order


def continued_columns(blocks: DataFrame, gap: float, narrow: float = 0.9, wide: float = 0.6) -> DataFrame:
    """(page, block, place): blocks (page, block, place, x0, y0, x1, y1) with those that go on in a column moved behind its last one.

    A block goes on where it stands within ``gap`` under another, covers ``narrow`` of the narrower and ``wide`` of the wider, and all
    that is read between the two stands to their right and not below.
    """

    def order(rows: list) -> list[tuple]:
        return [(rows[k]["block"], p) for p, k in enumerate(_continued([tuple(r[c] for c in BOX) for r in rows], gap, narrow, wide))]

    return on_pages(blocks, ["place", "block", *BOX], order, f"block {dict(blocks.dtypes)['block']}, place long")


def display_rows(blocks: DataFrame, usual: float, big: float = 1.7, gap: float = 1.5) -> DataFrame:
    """(page, block, joined): blocks of large type on one row, close to each other, as one, named by the least.

    blocks (page, block, x0, y0, x1, y1, size): size is the type's height.  Two are joined where both are ``big`` times the usual size,
    share half of the lower one's height, stand ``gap`` sizes apart at most, and their hull meets no other block.
    """

    def join(rows: list) -> list[tuple]:
        boxes = [tuple(r[c] for c in BOX) for r in rows]
        root = list(range(len(rows)))
        large = [k for k, r in enumerate(rows) if r["size"] >= big * usual]
        for x, i in enumerate(large):
            for j in large[x + 1 :]:
                a, b = boxes[i], boxes[j]
                side = min(a[3], b[3]) - max(a[1], b[1]) >= 0.5 * min(a[3] - a[1], b[3] - b[1])
                apart = max(a[0], b[0]) - min(a[2], b[2])
                hull = _hull([a, b])
                if side and apart <= gap * max(rows[i]["size"], rows[j]["size"]) and not any(_meet(hull, c) for k, c in enumerate(boxes) if k not in (i, j)):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        return [(r["block"], rows[root[k]]["block"]) for k, r in enumerate(rows)]

    kind = dict(blocks.dtypes)["block"]
    return on_pages(blocks, ["block", *BOX, "size"], join, f"block {kind}, joined {kind}")


def level_choice(levels: DataFrame, gutters: DataFrame, share: float = 0.3) -> DataFrame:
    """(page, item, group): each item in the coarsest group of nested levels that holds no gutter.

    levels (page, item, level, group, x0, y0, x1, y1), level 0 the finest, groups named within their level; a gutter (page, x0, y0, x1,
    y1) is held where it lies between a group's edges and covers ``share`` of its height.  Items whose finest group holds one keep that.
    """
    hull = levels.groupBy("page", "level", "group").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    g = gutters.select("page", *[F.col(c).alias(f"g{c}") for c in BOX])
    common = F.least("d", "gy1") - F.greatest("b", "gy0")
    held = hull.join(g, "page").filter((F.col("gx0") > F.col("a")) & (F.col("gx1") < F.col("c")) & (common >= share * (F.col("d") - F.col("b")))).select("page", "level", "group").distinct()
    free = levels.select("page", "item", "level", "group").join(held.withColumn("_h", F.lit(True)), ["page", "level", "group"], "left")
    ok = F.col("_h").isNull() | (F.col("level") == 0)
    # A coarse group counts only if all finer ones of the item are free, or finest.
    down = Window.partitionBy("page", "item").orderBy("level")
    best = free.withColumn("_ok", F.min(ok).over(down)).filter("_ok").groupBy("page", "item").agg(F.max(F.struct("level", "group")).alias("m"))
    return best.select("page", "item", F.col("m.level").alias("level"), F.col("m.group").alias("group"))


def judged(candidates: DataFrame, weights: dict[str, list[float]], features: list[str]) -> DataFrame:
    """(page, candidate, score): each page's best candidate by the weights of its context; ties by name.

    candidates (page, context, candidate, features...); weights: 'context candidate' -> one for each feature and the constant last.
    """
    none = F.lit(None).cast("array<double>")
    own = reduce(lambda e, kv: F.when(F.concat_ws(" ", "context", "candidate") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(e), sorted(weights.items()), none)
    x = F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0))
    score = F.aggregate(F.zip_with(own, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    s = candidates.withColumn("score", score).filter("score is not null")
    best = s.groupBy("page").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("m"))
    return best.select("page", F.col("m.candidate").alias("candidate"), (-F.col("m.s")).alias("score"))


def text_lines(components: DataFrame, part: float = 0.5) -> DataFrame:
    """(page, block, line, baseline, n, x0, y0, x1, y1): components of a block by rows of their centres; the baseline is the median foot."""
    h = components.groupBy("page", "block").agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("h"))
    c = components.join(h, ["page", "block"]).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    w = Window.partitionBy("page", "block").orderBy("cy", "x0")
    new = F.when(F.col("cy") - F.lag("cy").over(w) > part * F.col("h"), 1).otherwise(0)
    lined = c.withColumn("_new", new).withColumn("line", F.sum("_new").over(w))
    return lined.groupBy("page", "block", "line").agg(F.percentile("y1", 0.5).alias("baseline"), F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def figure_groups(lines: DataFrame, tol: float, least: int = 3, numeric: float = 0.6) -> DataFrame:
    """(page, figures, labels, shared): blocks of figures with the nearest block of labels to their left on the same baselines.

    lines (page, block, baseline, x0, x1, numeric): a block holds figures where ``numeric`` of its lines are; it pulls a block of text
    that shares ``least`` baselines, with no other text block that shares any between the two.
    """
    per = lines.groupBy("page", "block").agg(F.avg(F.col("numeric").cast("int")).alias("s"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    shared = R.shared_baselines(lines, tol)
    fig = per.filter(F.col("s") >= numeric).select("page", F.col("block").alias("a"), F.col("x0").alias("left"))
    text = per.filter(F.col("s") < numeric).select("page", F.col("block").alias("b"), F.col("x1").alias("right"))
    met = shared.join(fig, ["page", "a"]).join(text, ["page", "b"]).filter(F.col("right") <= F.col("left"))
    best = met.groupBy("page", "a").agg(F.max(F.struct("right", (-F.col("b")).alias("b"), "shared")).alias("m"))
    return best.filter(F.col("m.shared") >= least).select("page", F.col("a").alias("figures"), (-F.col("m.b")).alias("labels"), F.col("m.shared").alias("shared"))


def facing_blocks(lines: DataFrame, width: float, margin: float = 4.0, share: float = 0.6, least: int = 3) -> DataFrame:
    """(page, block) of columns that belong to the facing page: ``share`` of their lines run off an edge with a cut word there.

    lines (page, block, x0, x1, cut_left, cut_right): whether the first and the last word are no words.
    """
    off = ((F.col("x0") <= margin) & F.col("cut_left")) | ((F.col("x1") >= width - margin) & F.col("cut_right"))
    per = lines.groupBy("page", "block").agg(F.count("*").alias("n"), F.avg(off.cast("int")).alias("s"))
    return per.filter((F.col("n") >= least) & (F.col("s") >= share)).select("page", "block")


def margin_numbers(lines: DataFrame, near: float = 40.0, least: int = 6, rising: float = 0.7) -> DataFrame:
    """(page, line) of line numbers in a margin: lone words of at most three digits, their left edges within ``near`` of their median,
    ``least`` of them, and ``rising`` of successive values ascending.  lines (page, line, y0, x0, text)."""
    num = lines.filter(F.col("text").rlike("^[0-9]{1,3}$")).withColumn("v", F.col("text").try_cast("int"))
    med = num.groupBy("page").agg(F.percentile("x0", 0.5).alias("m"))
    near_ = num.join(med, "page").filter(F.abs(F.col("x0") - F.col("m")) <= near)
    w = Window.partitionBy("page").orderBy("y0", "line")
    up = near_.withColumn("up", (F.col("v") > F.lag("v").over(w)).cast("int"))
    ok = up.groupBy("page").agg(F.count("*").alias("n"), F.avg("up").alias("s")).filter((F.col("n") >= least) & (F.col("s") >= rising))
    return near_.join(ok.select("page"), "page").select("page", "line")


def empty_rectangles(obstacles: list[Box], bound: Box, min_w: float, min_h: float) -> list[Box]:
    """All rectangles inside bound that meet no obstacle and cannot grow, of ``min_w`` by ``min_h`` at least.

    A sweep along x: an open window (from x, between two heights) closes at an obstacle that begins in it and goes on above and
    below it; where an obstacle ends, windows open over what is free there.
    """
    left, top, right, foot = bound
    inside = [o for o in obstacles if o[0] < right and o[2] > left and o[1] < foot and o[3] > top]
    events = sorted([(max(o[0], left), 1, o) for o in inside] + [(o[2], 0, o) for o in inside if o[2] < right], key=lambda e: e[:2])
    open_, active, out = {(top, foot): left}, [], []  # heights: since when
    for x, begins, o in events:
        if begins:
            active.append(o)
            for (a, b), since in sorted(open_.items()):
                if o[1] < b and o[3] > a:
                    del open_[a, b]
                    out.append((since, a, x, b))
                    for part in ((a, o[1]), (o[3], b)):
                        if part[1] - part[0] >= min_h:
                            open_[part] = min(since, open_.get(part, since))
        else:
            active.remove(o)
            at = top
            for y0, y1 in [*sorted((p[1], p[3]) for p in active), (foot, foot)]:
                if y0 - at >= min_h and at < o[3] and y0 > o[1]:
                    open_.setdefault((at, y0), x)
                at = max(at, y1)
    out += [(since, a, right, b) for (a, b), since in open_.items()]
    fits = {r for r in out if r[2] - r[0] >= min_w and r[3] - r[1] >= min_h}
    holds = lambda p, q: p != q and p[0] <= q[0] and p[1] <= q[1] and p[2] >= q[2] and p[3] >= q[3]
    return sorted(r for r in fits if not any(holds(p, r) for p in fits))


def largest_rectangles(obstacles: list[Box], bound: Box, min_w: float, min_h: float, limit: int = 30, most_common: float = 0.5) -> list[Box]:
    """The largest empty rectangles, at most ``limit``, none of which one before it covers by ``most_common`` of its area."""
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    common = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    kept: list[Box] = []
    for r in sorted(empty_rectangles(obstacles, bound, min_w, min_h), key=lambda b: (-area(b), b)):
        if len(kept) < limit and all(common(r, k) < most_common * area(r) for k in kept):
            kept.append(r)
    return kept


def gutters(items: DataFrame, bounds: DataFrame, min_w: float, height_share: float = 0.28, hug: float = 0.3, near: float = 20.0) -> DataFrame:
    """(page, x0, y0, x1, y1): tall empty lanes between items, with items along ``hug`` of their height within ``near`` on both sides.

    items and bounds (page, x0, y0, x1, y1), a bound a page; lanes whose middles are within min_w of each other are one, the tallest.
    """

    def beside(lane: Box, boxes: list[Box], left: bool) -> float:
        spans = sorted((max(lane[1], b[1]), min(lane[3], b[3])) for b in boxes if (0 <= lane[0] - b[2] <= near if left else 0 <= b[0] - lane[2] <= near) and b[1] < lane[3] and b[3] > lane[1])
        total, end = 0.0, lane[1]
        for a, b in spans:
            total += max(0.0, b - max(a, end))
            end = max(end, b)
        return total / (lane[3] - lane[1])

    def lanes(rows: list) -> list[tuple]:
        bound = next(tuple(r[c] for c in BOX) for r in rows if r["bound"])
        boxes = [tuple(r[c] for c in BOX) for r in rows if not r["bound"]]
        tall = height_share * (bound[3] - bound[1])
        out: list[Box] = []
        for b in sorted(largest_rectangles(boxes, bound, min_w, tall), key=lambda b: (b[1] - b[3], b)):
            if beside(b, boxes, True) >= hug and beside(b, boxes, False) >= hug and all(abs((b[0] + b[2]) - (o[0] + o[2])) / 2 > min_w for o in out):
                out.append(b)
        return sorted(out)

    both = items.select("page", *BOX, F.lit(False).alias("bound")).unionByName(bounds.select("page", *BOX, F.lit(True).alias("bound")))
    return on_pages(both, [*BOX, "bound"], lanes, "x0 double, y0 double, x1 double, y1 double")
