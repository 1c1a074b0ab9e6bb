"""Tables from words without rules: rows, phrases, columns, cells, and the stretches of a page that are tables.

Words are (page, word, text, x0, y0, x1, y1).  What follows from sorted neighbours is done by windows; what goes on from one row to
the next is done a page at a time, by ``on_pages``.  A page's words are one group and bound it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import islice
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from leafmill.functions import text as T

BOX = ["x0", "y0", "x1", "y1"]
#: Signs that belong to the amount behind them, and how an amount begins: fixed values.
SIGNS, AMOUNT = ["$", "€", "£", "¥"], r"^[0-9(\-—]"
_DIGIT = re.compile("[0-9]")


def _values(column: pa.Array) -> list:
    """A column's values as Python's own, numbers without a detour by scalars."""
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def on_pages(df: DataFrame, columns: list[str], f: Callable[[list], list[tuple]], schema: str, page: str = "page") -> DataFrame:
    """(page, schema...): f of each page's rows (dicts), which come sorted by the columns, gives the page's new rows.

    Pages come and go as whole Arrow columns of a batch; no row object is made for a word.
    """
    rows = df.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    made = StructType.fromDDL(schema)
    names, kinds = made.names, [to_arrow_type(x.dataType) for x in made]

    def run(pages: pa.Array) -> pa.Array:
        flat = pages.flatten()
        each = zip(*map(_values, flat.flatten()), strict=True)
        out, ends = [], [0]
        for n in pages.value_lengths().to_pylist():
            out += f([dict(zip(columns, x, strict=True)) for x in islice(each, n or 0)])
            ends.append(len(out))
        cols = zip(*out, strict=True) if out else [()] * len(names)
        items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    found = F.arrow_udf(run, f"array<struct<{schema}>>")
    return rows.select(page, F.explode(found("_rows")).alias("_r")).select(page, "_r.*")


def rows_by_mean(centres: list[float], tol: float) -> list[int]:
    """Row of each of some ascending centres: the current one while within tol of its running mean."""
    out, total, n = [], 0.0, 0
    for c in centres:
        if n and abs(c - total / n) <= tol:
            total, n = total + c, n + 1
            out.append(out[-1])
        else:
            out.append(out[-1] + 1 if out else 0)
            total, n = c, 1
    return out


def _numbered(rows: list, part: float) -> list[int]:
    tol = part * median(r["y1"] - r["y0"] for r in rows)
    return rows_by_mean([(r["y0"] + r["y1"]) / 2 for r in rows], tol)


def text_rows(words: DataFrame, part: float = 0.5) -> DataFrame:
    """words with ``row``, from 0 down the page: a word joins the row whose mean centre is within ``part`` of the median height."""
    own = ["word", "text", *BOX]

    def number(rows: list) -> list[tuple]:
        return [(*(r[c] for c in own), k) for r, k in zip(rows, _numbered(rows, part), strict=True)]

    centre = words.withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    kinds = dict(words.dtypes)
    found = on_pages(centre, ["cy", "x0", "word", "text", "y0", "x1", "y1"], number, ", ".join(f"{c} {kinds[c]}" for c in own) + ", row long")
    more = [c for c in words.columns if c not in ("page", *own)]
    return found.join(words.select("page", "word", *more), ["page", "word"]) if more else found


def _hull(df_keys: list[str], df: DataFrame, order: str = "x0") -> DataFrame:
    """Groups of words as phrases: text in order, box, number of words."""
    parts = F.array_sort(F.collect_list(F.struct(order, "word", "text")))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return df.groupBy(*df_keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), *box, F.count("*").alias("n_words"), F.transform(parts, lambda x: x["word"]).alias("words"))


def _usual_height() -> Column:
    """Median height of the page's words, by a window: the words are not made a second time for it."""
    return F.percentile(F.col("y1") - F.col("y0"), 0.5).over(Window.partitionBy("page"))


def in_phrases(rows: DataFrame, gap: float = 0.8) -> DataFrame:
    """Words of rows with ``phrase``, from 0 along the row: a new one behind a gap of over ``gap`` median word heights.

    A currency sign goes with the amount behind it, however far.
    """
    w = Window.partitionBy("page", "row").orderBy("x0", "word")
    before = F.lag("text").over(w)
    sign = before.isin(*SIGNS) & F.col("text").rlike(AMOUNT)
    far = F.col("x0") - F.lag("x1").over(w) > gap * F.col("unit")
    new = rows.withColumn("unit", _usual_height()).withColumn("_new", F.when(far & ~F.coalesce(sign, F.lit(False)), 1).otherwise(0))
    return new.withColumn("phrase", F.sum("_new").over(w)).drop("_new", "unit")


def phrases(rows: DataFrame, gap: float = 0.8) -> DataFrame:
    """(page, row, phrase, text, x0, y0, x1, y1, n_words, words)."""
    return _hull(["page", "row", "phrase"], in_phrases(rows, gap))


def page_lines(rows: list, gap: float, numbers: list[int] | None = None) -> list[list[list]]:
    """Words, sorted by centre, as rows of phrases of words; numbers: the words' rows, where they are known."""
    far = gap * median(r["y1"] - r["y0"] for r in rows)
    lines: list[list] = []
    for r, k in zip(rows, _numbered(rows, 0.5) if numbers is None else numbers, strict=True):
        lines.extend([] for _ in range(k + 1 - len(lines)))
        lines[k].append(r)
    out = []
    for line in lines:
        line.sort(key=lambda w: (w["x0"], w["word"]))
        parts = [[line[0]]]
        for a, b in zip(line, line[1:], strict=False):
            if b["x0"] - a["x1"] > far and not _is_sign(a, b):
                parts.append([])
            parts[-1].append(b)
        out.append(parts)
    return out


def _is_sign(a, b) -> bool:
    return a["text"] in SIGNS and bool(re.match(AMOUNT, b["text"]))


def _aligned(lines: list[list[list]], wide: float, near: float) -> list[list[list]]:
    """Rows of phrases, split where cells line up across rows and joined where a phrase lines up with nothing."""
    spaces = [b["x0"] - a["x1"] for line in lines for p in line for a, b in zip(p, p[1:], strict=False)]
    spaces = [x for x in spaces if x > 0]
    if len(spaces) < 4:
        return lines
    usual, tol = median(spaces), median(w["y1"] - w["y0"] for line in lines for p in line for w in p) / 2
    cand = lambda a, b: b["x0"] - a["x1"] >= wide * usual and not _is_sign(a, b)
    edges = sorted((w["x0"], k) for k, line in enumerate(lines) for p in line for i, w in enumerate(p) if i == 0 or cand(p[i - 1], w))
    at = [x for x, _ in edges]

    def lines_up(x: float, k: int) -> bool:
        return any(row != k for _, row in edges[bisect_left(at, x - tol) : bisect_right(at, x + tol)])

    out = []
    for k, line in enumerate(lines):
        new: list[list] = []
        for n, p in enumerate(line):
            digits = any(_DIGIT.search(w["text"]) for q in line[max(0, n - 1) : n + 1] for w in q)
            joins = n and p[0]["x0"] - line[n - 1][-1]["x1"] < near * usual and not digits and not lines_up(p[0]["x0"], k)
            if not joins:
                new.append([])
            for i, w in enumerate(p):
                if i and cand(p[i - 1], w) and lines_up(w["x0"], k):
                    new.append([])
                new[-1].append(w)
        out.append(new)
    return out


def phrase_of(words: list) -> dict:
    box = {"x0": min(w["x0"] for w in words), "y0": min(w["y0"] for w in words), "x1": max(w["x1"] for w in words), "y1": max(w["y1"] for w in words)}
    return {"text": " ".join(w["text"] for w in words), **box, "n_words": len(words)}


BY_CENTRE = ["cy", "x0", "word", "text", "y0", "x1", "y1"]


def centred(words: DataFrame) -> DataFrame:
    return words.withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


def aligned_phrases(words: DataFrame, gap: float = 0.8, wide: float = 1.4, near: float = 1.5) -> DataFrame:
    """(page, row, phrase, text, x0, y0, x1, y1, n_words): phrases after those that hold two cells are split, and those that are one are
    joined.

    A phrase is split before a word that stands behind ``wide`` median spaces and whose left edge lines up, within half a word height,
    with one on another row that begins a phrase or stands so too; never between a sign and its amount.  A phrase less than ``near``
    spaces behind the one before it joins that if it lines up with nothing and neither holds a digit.  Pages of fewer than four spaces
    inside phrases stay as they are.
    """

    def split(rows: list) -> list[tuple]:
        lines = _aligned(page_lines(rows, gap), wide, near)
        return [(k, n, *(phrase_of(p)[c] for c in ("text", *BOX, "n_words"))) for k, line in enumerate(lines) for n, p in enumerate(line)]

    return on_pages(centred(words), BY_CENTRE, split, "row long, phrase long, text string, x0 double, y0 double, x1 double, y1 double, n_words long")


def columns(ph: DataFrame, cross: float = 0.0) -> DataFrame:
    """(page, col, x0, x1): what the phrases of rows with more than one cover along the page, cut where nothing stands.

    With ``cross``, places that no more than this share of those rows cover are free as well.
    """
    multi = ph.groupBy("page", "row").agg(F.count("*").alias("n")).filter("n > 1").select("page", "row")
    own = ph.join(multi, ["page", "row"])
    allow = multi.groupBy("page").agg((F.count("*") * F.lit(cross)).alias("allow"))
    ends = own.select("page", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    at = ends.groupBy("page", "e.x").agg(F.sum("e.d").alias("d")).join(allow, "page")
    along = Window.partitionBy("page").orderBy("x")
    depth = F.sum("d").over(along)
    taken = at.withColumn("taken", depth > F.col("allow")).withColumn("was", F.coalesce(F.lag("taken").over(along), F.lit(False)))
    starts = taken.filter("taken and not was").withColumn("col", F.row_number().over(along) - 1).select("page", "col", F.col("x").alias("x0"))
    stops = taken.filter("was and not taken").withColumn("col", F.row_number().over(along) - 1).select("page", "col", F.col("x").alias("x1"))
    return starts.join(stops, ["page", "col"])


def in_columns(ph: DataFrame, cols: DataFrame) -> DataFrame:
    """Phrases with ``col``: the column they overlap most, or the one whose centre is nearest if they meet none; ties to the left."""
    c = cols.select("page", F.col("col"), F.col("x0").alias("a"), F.col("x1").alias("b"))
    met = ph.join(c, "page")
    over = F.greatest(F.lit(0.0), F.least("x1", "b") - F.greatest("x0", "a"))
    off = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("a") + F.col("b")) / 2)
    best = met.groupBy("page", "row", "phrase").agg(F.min(F.struct(-over, F.when(over > 0, 0.0).otherwise(off), "col")).alias("m"))
    return ph.join(best.select("page", "row", "phrase", F.col("m.col").alias("col")), ["page", "row", "phrase"])


def body_start(ph: DataFrame, most: int = 3) -> DataFrame:
    """(page, first): the first row with a digit behind its first phrase, at most ``most`` rows down, else row 1."""
    found = F.min(F.when((F.col("phrase") > 0) & F.col("text").rlike("[0-9]"), F.col("row")))
    return ph.groupBy("page").agg(found.alias("f")).select("page", F.when(F.col("f") <= most, F.col("f")).otherwise(1).alias("first"))


def header_span(x0: float, x1: float, cols: list[tuple[float, float]], best: int, blocked: set[int]) -> tuple[int, int]:
    """First and last column that a header phrase stands over.

    It takes in all columns it overlaps; of the runs around these without a blocked column, and without the first one unless it is
    overlapped itself, the run whose centre is nearest the phrase's.
    """
    hit = [k for k, (a, b) in enumerate(cols) if min(x1, b) > max(x0, a)] or [best]
    centre = (x0 + x1) / 2
    lefts, k = [hit[0]], hit[0] - 1
    while k > 0 and k not in blocked:
        lefts.append(k)
        k -= 1
    rights, k = [hit[-1]], hit[-1] + 1
    while k < len(cols) and k not in blocked:
        rights.append(k)
        k += 1
    runs = [(a, b) for a in lefts for b in rights]
    return min(runs, key=lambda r: (round(abs((cols[r[0]][0] + cols[r[1]][1]) / 2 - centre), 6), r[1] - r[0], r))


def _wraps(rows: list[list[dict]], first: int, line: float) -> list[list[dict]]:
    """Header rows whose phrases stand under one each of the row above, edges or centres lined up, melt into it."""
    out = [list(r) for r in rows]
    k = 1
    while k < min(first, len(out)):
        up, down = out[k - 1], out[k]
        pairs = []
        for p in down:
            own = [q for q in up if min(abs(p["x0"] - q["x0"]), abs(p["x1"] - q["x1"]), abs(p["x0"] + p["x1"] - q["x0"] - q["x1"]) / 2) <= line / 2]
            pairs.append(own[0] if len(own) == 1 else None)
        close = down and up and min(p["y0"] for p in down) - max(q["y1"] for q in up) < 0.6 * line
        if close and all(q is not None for q in pairs) and len({id(q) for q in pairs}) == len(pairs):
            for p, q in zip(down, pairs, strict=True):
                q["text"] += " " + p["text"]
                q["x0"], q["x1"], q["y1"] = min(q["x0"], p["x0"]), max(q["x1"], p["x1"]), max(q["y1"], p["y1"])
            del out[k]
            first -= 1
        else:
            k += 1
    return out


def _body_wraps(rows: list[list[tuple[int, dict]]], first: int, line: float) -> list[list[tuple[int, dict]]]:
    """Body rows of text only that stand close under a row with figures, in its text columns, go on its cells."""
    out = [list(r) for r in rows[:first]]
    for r in rows[first:]:
        above = out[-1] if len(out) > first else None
        figures = lambda cells: any(_DIGIT.search(p["text"]) for _, p in cells)
        if above and r and not figures(r) and figures(above):
            texts = {c for c, p in above if not _DIGIT.search(p["text"])}
            close = min(p["y0"] for _, p in r) - max(p["y1"] for _, p in above) < 0.35 * line
            if close and {c for c, _ in r} <= texts and len(r) < len(above):
                for c, p in r:
                    own = next(q for k, q in above if k == c)
                    own["text"] += " " + p["text"]
                    own["y1"] = max(own["y1"], p["y1"])
                continue
        out.append(list(r))
    return out


def _sign_columns(cells: list[tuple[int, int, int, str]], n_cols: int) -> tuple[list[tuple[int, int, int, str]], int]:
    """Columns that hold nothing but currency signs join the column behind them."""
    k = n_cols - 2
    while k >= 0:
        own = [t for _, c, _, t in cells if c == k]
        if own and all(t.strip() in SIGNS for t in own):
            signs = {r: t for r, c, _, t in cells if c == k}
            merged = []
            for r, c, w, t in cells:
                if c == k:
                    if not any(x[0] == r and x[1] == k + 1 for x in cells):
                        merged.append((r, c, w, t))
                elif c == k + 1:
                    merged.append((r, k, w, f"{signs[r]} {t}" if r in signs else t))
                else:
                    merged.append((r, c - 1 if c > k else c, w - 1 if c < k < c + w else w, t))
            cells, n_cols = merged, n_cols - 1
        k -= 1
    return cells, n_cols


def _table(items: list, spans: list[tuple[float, float]]) -> list[tuple[int, int, int, str]]:
    """(row, col, colspan, text) of one table: its phrases by row and its columns' edges."""
    rows: dict[int, list[dict]] = {}
    for i in items:
        rows.setdefault(i["row"], []).append({k: i[k] for k in ("text", *BOX)})
    seen = [sorted(r, key=lambda p: p["x0"]) for _, r in sorted(rows.items())]
    line = median(p["y1"] - p["y0"] for r in seen for p in r)
    first = next((k for k, r in enumerate(seen[:4]) if any(_DIGIT.search(p["text"]) for p in r[1:])), 1)
    before = len(seen)
    seen = _wraps(seen, first, line)
    first -= before - len(seen)

    def column(p: dict) -> int:
        over = [min(p["x1"], b) - max(p["x0"], a) for a, b in spans]
        if max(over) > 0:
            return max(range(len(spans)), key=lambda k: (over[k], -k))
        return min(range(len(spans)), key=lambda k: (abs((p["x0"] + p["x1"]) - (spans[k][0] + spans[k][1])), k))

    placed = [[(column(p), p) for p in r] for r in seen]
    placed = _body_wraps(placed, first, line)
    cells = []
    for r, row in enumerate(placed):
        used: dict[int, list[str]] = {}
        wide: dict[int, int] = {}
        for c, p in row:
            a, b = (c, c)
            if r < first:
                a, b = header_span(p["x0"], p["x1"], spans, c, {k for k, q in row if q is not p})
            used.setdefault(a, []).append(p["text"])
            wide[a] = max(wide.get(a, 1), b - a + 1)
        cells += [(r, c, wide[c], " ".join(t)) for c, t in used.items()]
    return sorted(_sign_columns(cells, len(spans))[0])


#: Dots that lead the eye from a label to its figure.
LEADER = r"^[.·…_]{3,}$"


def free_columns(lines: list[list[dict]], cross: float) -> list[tuple[float, float]]:
    """What the phrases of rows with more than one cover along the page, or all if there are none."""
    multi = [r for r in lines if len(r) > 1]
    every = [p for r in multi or lines for p in r]
    if not multi:
        return [(min(p["x0"] for p in every), max(p["x1"] for p in every))]
    step: dict[float, int] = {}
    for p in every:
        step[p["x0"]] = step.get(p["x0"], 0) + 1
        step[p["x1"]] = step.get(p["x1"], 0) - 1
    out, depth, start = [], 0, None
    for x in sorted(step):
        depth += step[x]
        if depth > cross * len(multi) and start is None:
            start = x
        elif depth <= cross * len(multi) and start is not None:
            out.append((start, x))
            start = None
    return out or [(min(p["x0"] for p in every), max(p["x1"] for p in every))]


def whitespace_table(words: DataFrame, gap: float = 0.8, cross: float = 0.0, aligned: bool = True) -> DataFrame:
    """(page, row, col, colspan, text): each page's words as one table, by rows, phrases and the columns between them.

    Leaders drop out; header lines that go on under each other melt, headers span the columns they stand over, wrapped body cells go
    on their rows, and columns of currency signs join the next.  A page without two phrases on a row is one column.
    """

    def read(rows: list) -> list[tuple]:
        lines = page_lines(rows, gap)
        lines = _aligned(lines, 1.4, 1.5) if aligned else lines
        phrases_ = [[phrase_of(p) for p in line] for line in lines]
        return _table([{**p, "row": k} for k, line in enumerate(phrases_) for p in line], free_columns(phrases_, cross))

    own = centred(words.filter(~F.col("text").rlike(LEADER)))
    return on_pages(own, BY_CENTRE, read, "row long, col long, colspan long, text string")


def find_tables(words: DataFrame, gap: float = 0.8, pitch: float = 1.6, least: int = 2) -> DataFrame:
    """(page, word, table): the words of the page's tables, numbered down the page; words outside them have no row.

    A table is a run of rows with more than one phrase whose distances stay under ``pitch`` times the page's usual one, of which
    ``least`` rows share two columns, one holding figures.  Rows of prose (many short gaps, no figure) break it; single-phrase rows at
    its ends are left out.
    """
    kind = dict(words.dtypes)["word"]

    def read(rows: list) -> list[tuple]:
        return [(k, *(phrase_of(p)[c] for c in ("text", *BOX, "n_words")), [w["word"] for w in p]) for k, line in enumerate(page_lines(rows, gap)) for p in line]

    made = f"row long, text string, x0 double, y0 double, x1 double, y1 double, n_words long, words array<{kind}>"
    ph = on_pages(centred(words.filter(~F.col("text").rlike(LEADER))), BY_CENTRE, read, made).withColumn("figure", T.is_figure(F.col("text")))

    def split(items: list) -> list[tuple]:
        lines: dict[int, list] = {}
        for i in items:
            lines.setdefault(i["row"], []).append(i)
        order = sorted(lines)
        tops = {r: min(p["y0"] for p in lines[r]) for r in order}
        steps = [tops[b] - tops[a] for a, b in zip(order, order[1:], strict=False)]
        usual = median(steps) if steps else 0.0
        height = median(p["y1"] - p["y0"] for p in items)
        prose = {r for r in order if len(lines[r]) > 4 and not any(p["figure"] for p in lines[r]) and max(p["n_words"] for p in lines[r]) <= 2}
        runs, now = [], []
        for k, r in enumerate(order):
            far = bool(now) and steps[k - 1] > max(pitch * usual, pitch * height) and steps[k - 1] > pitch * (min(steps) if steps else 0)
            if r in prose or far:
                runs.append(now)
                now = []
            if r not in prose:
                now.append(r)
        runs.append(now)
        out, number = [], 0
        for run in runs:
            while run and len(lines[run[0]]) < 2:
                run = run[1:]
            while run and len(lines[run[-1]]) < 2:
                run = run[:-1]
            multi = [r for r in run if len(lines[r]) > 1]
            if len(multi) < least:
                continue
            first = lines[multi[0]]
            shared = sum(sum(any(min(p["x1"], q["x1"]) > max(p["x0"], q["x0"]) for q in first) for p in lines[r]) >= 2 for r in multi[1:])
            if shared + 1 < least or not any(p["figure"] for r in run for p in lines[r]):
                continue
            out += [(w, number) for r in run for p in lines[r] for w in p["words"]]
            number += 1
        return out

    return on_pages(ph, ["row", "x0", "text", "y0", "x1", "y1", "figure", "n_words", "words"], split, f"word {kind}, table long")


def rule_regions(rules: DataFrame, tol: float, least: int = 3, most_gap: float = 400.0) -> DataFrame:
    """(page, x0, y0, x1, y1, n): stacks of ``least`` horizontal rules that share both ends within tol, at most ``most_gap`` apart.

    rules (page, x0, y0, x1, y1).  Ends are grouped by gaps along the page, left ends first, then right ends, then the steps down.
    """
    out, keys = rules, ["page"]
    for c, name, limit in (("x0", "left", tol), ("x1", "right", tol), ("y0", "stack", most_gap)):
        w = Window.partitionBy(*keys).orderBy(c)
        out = out.withColumn("_new", F.when(F.col(c) - F.lag(c).over(w) > limit, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
        keys.append(name)
    per = out.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))
    return per.filter(F.col("n") >= least).select("page", *BOX, "n")


def row_gaps(rows: DataFrame, factor: float = 0.8) -> DataFrame:
    """(page, row, a, b, h): free stretches between neighbouring words of a row, wider than ``factor`` median word heights."""
    w = Window.partitionBy("page", "row").orderBy("x0", "word")
    g = rows.withColumn("h", _usual_height()).withColumn("a", F.lag("x1").over(w)).withColumn("b", F.col("x0"))
    return wide_gaps(g, factor).select("page", "row", "a", "b", "h")


def wide_gaps(gaps: DataFrame, factor: float = 0.8) -> DataFrame:
    return gaps.filter(F.col("b") - F.col("a") > factor * F.col("h"))


def _spines(items: list, teeth: int) -> list[tuple]:
    """(spine, x, first row, last row): a gap goes on in the next row's gap that it has most in common with; that is the new width."""
    by: dict[int, list[tuple[float, float]]] = {}
    for i in items:
        by.setdefault(i["row"], []).append((i["a"], i["b"]))
    chains: list[list] = []  # [a, b, first, last]
    for r in sorted(by):
        above = [c for c in chains if c[3] == r - 1]
        for a, b in sorted(by[r]):
            common = lambda c: min(b, c[1]) - max(a, c[0])  # noqa: B023, E731
            best = max(above, key=common, default=None)
            if best is not None and common(best) > 0:
                above.remove(best)
                best[:] = [max(a, best[0]), min(b, best[1]), best[2], r]
            else:
                chains.append([a, b, r, r])
    kept = sorted((c[2], (c[0] + c[1]) / 2, c[3]) for c in chains if c[3] - c[2] + 1 >= teeth)
    return [(k, x, a, b) for k, (a, x, b) in enumerate(kept)]


def spines(rows: DataFrame, factor: float = 0.8, teeth: int = 3) -> DataFrame:
    """(page, spine, x, first, last): upright free lanes at the middle of gaps that ``teeth`` rows on end have in common."""
    return gap_spines(row_gaps(rows, factor), teeth)


def gap_spines(gaps: DataFrame, teeth: int = 3) -> DataFrame:
    return on_pages(gaps, ["row", "a", "b"], lambda r: _spines(r, teeth), "spine long, x double, first long, last long")


def meshes(spine: DataFrame, shared: int = 2) -> DataFrame:
    """(page, mesh, n_spines, first, last, x0, x1): spines that have ``shared`` rows in common, and what these do, are one mesh."""

    def join(items: list) -> list[tuple]:
        root = list(range(len(items)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        order = sorted(range(len(items)), key=lambda k: items[k]["first"])
        reach: list[int] = []  # of a mesh of overlapping spines only those that still reach down matter
        for k in order:
            reach = [j for j in reach if items[j]["last"] - items[k]["first"] + 1 >= shared]
            for j in reach:
                if min(items[j]["last"], items[k]["last"]) - items[k]["first"] + 1 >= shared:
                    a, b = sorted((find(j), find(k)))
                    root[b] = a
            reach.append(k)
        groups: dict[int, list] = {}
        for k, i in enumerate(items):
            groups.setdefault(find(k), []).append(i)
        found = sorted((min(i["first"] for i in g), min(i["x"] for i in g), len(g), max(i["last"] for i in g), max(i["x"] for i in g)) for g in groups.values())
        return [(m, n, a, b, x0, x1) for m, (a, x0, n, b, x1) in enumerate(found)]

    return on_pages(spine, ["first", "last", "x", "spine"], join, "mesh long, n_spines long, first long, last long, x0 double, x1 double")


def word_of_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, word, row, col): the first cell, by row and column, that holds the word's centre; cells (page, row, col, x0, y0, x1, y1)."""
    c = cells.select("page", "row", "col", *[F.col(b).alias(f"c{b}") for b in BOX])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = words.join(c, "page").filter((x >= F.col("cx0")) & (x <= F.col("cx1")) & (y >= F.col("cy0")) & (y <= F.col("cy1")))
    return met.groupBy("page", "word").agg(F.min(F.struct("row", "col")).alias("m")).select("page", "word", "m.row", "m.col")


def cell_text(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, row, col, text): the words of each cell, by line (half a word height) and left edge."""
    own = word_of_cells(words, cells).join(words, ["page", "word"])
    down = Window.partitionBy("page", "row", "col").orderBy("y0", "word")
    new = F.when(F.col("y0") - F.lag("y0").over(down) > (F.col("y1") - F.col("y0")) / 2, 1).otherwise(0)
    lined = own.withColumn("_new", new).withColumn("line", F.sum("_new").over(down))
    parts = F.array_sort(F.collect_list(F.struct("line", "x0", "word", "text")))
    return lined.groupBy("page", "row", "col").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def split_at_cells(words: DataFrame, cells: DataFrame, whole: float = 0.75) -> DataFrame:
    """(page, word, row, col, text): each word's characters by the cell that holds their centres, at even shares of its width.

    A word of which ``whole`` and more lie in one cell goes there wholly; characters in no cell drop out.
    """
    # A word meets the cells of its page whole, before its characters are taken apart: what is dealt by page are words.
    own = words.filter(F.length("text") > 0).select("page", "word", F.col("text").alias("t"), "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    c = cells.select("page", "row", "col", *[F.col(b).alias(f"c{b}") for b in BOX])
    beside = (F.least("x0", "x1") < F.col("cx1")) & (F.greatest("x0", "x1") >= F.col("cx0")) & (F.col("y") >= F.col("cy0")) & (F.col("y") < F.col("cy1"))
    met = own.join(c, "page").filter(beside).groupBy("page", "word", "t", "x0", "x1").agg(F.array_sort(F.collect_list(F.struct("row", "col", "cx0", "cx1"))).alias("cells"))  # a word's cells
    each = F.sequence(F.lit(1), F.length("t"))
    x = lambda i: F.col("x0") + (F.col("x1") - F.col("x0")) * (i - 0.5) / F.length("t")
    first = lambda i: F.get(F.filter("cells", lambda c: (x(i) >= c["cx0"]) & (x(i) < c["cx1"])), F.lit(0))
    homes = met.select("page", "word", "t", F.transform(each, lambda i: F.struct(first(i)["row"].alias("row"), first(i)["col"].alias("col"))).alias("homes"))
    # (The outer form, for the plain one brings a filter that works everything out once more.)
    per = homes.select("page", "word", "t", "homes", F.explode_outer(F.array_distinct("homes")).alias("m")).filter("m.row is not null")
    part = F.array_join(F.transform(F.filter(each, lambda i: F.get("homes", i - 1) == F.col("m")), lambda i: F.substr("t", i, F.lit(1))), "")
    per = per.select("page", "word", "t", "m.row", "m.col", part.alias("part"))
    w = Window.partitionBy("page", "word")
    share = F.length("part") / F.length("t")
    most = per.withColumn("most", F.max(share).over(w)).filter((F.col("most") < whole) | (share == F.col("most")))
    return most.select("page", "word", "row", "col", F.when(F.col("most") >= whole, F.col("t")).otherwise(F.col("part")).alias("text"))
