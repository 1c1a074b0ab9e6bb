"""Tables as cells: (table, row, col, text), rows and columns from 0; spans and roles where an operator adds them.

A table's cells are one group and bound it; tables meet nothing but themselves.  Empty cells may be missing or hold an empty text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.staging import materialize

#: Cells that stand for a tick: fixed values.
TICKS = ["✓", "✔", "√", "v", "V", "x", "X", "☑"]
#: Labels of total rows and the words they are misread from: fixed values.
TOTAL_WORDS = ["total", "subtotal", "balance", "amount"]
#: Fixed patterns: a caption's head, and what notes hold.
CAPTION, NOTE = r"(?i)^(?:table|tab[.]|figure|exhibit)\s*[0-9]+", r"(?i)\b(?:doi|https?:|www[.])"


def _filled() -> Column:
    return F.trim(F.coalesce("text", F.lit(""))) != ""


def _by(*c: str):
    return Window.partitionBy("table", *c)


def figures(cells: DataFrame) -> DataFrame:
    """cells with ``figure`` (whether the text is one) and ``value`` (null for what has none)."""
    return cells.withColumn("figure", _filled() & T.is_figure(F.col("text"))).withColumn("value", T.figure_value(F.col("text")))


def is_total(label: Column) -> Column:
    """A total row's label: by pattern, or within 35 % edits of a known one after look-alikes are folded."""
    folded = F.translate(F.lower(F.trim(label)), "015", "ols")
    near = reduce(lambda a, b: a | b, [F.levenshtein(folded, F.lit(w)) * 100 <= 35 * len(w) for w in TOTAL_WORDS])
    return label.rlike(T.TOTAL) | near


def with_totals(cells: DataFrame) -> DataFrame:
    """cells with ``label`` (the first filled cell's text of their row) and ``total`` (whether it is a total's, below the first row)."""
    label = F.min_by(F.when(_filled(), F.col("text")), F.when(_filled(), F.col("col"))).over(_by("row"))
    return cells.withColumn("label", label).withColumn("total", F.coalesce((F.col("row") > 0) & is_total(F.col("label")), F.lit(False)))


def labels(cells: DataFrame) -> DataFrame:
    """(table, row, label): the first filled cell's text of each row that has one."""
    first = F.min_by("text", "col")
    return cells.filter(_filled()).groupBy("table", "row").agg(first.alias("label"))


def total_rows(cells: DataFrame) -> DataFrame:
    """(table, row) of rows below the first whose label is a total's."""
    return labels(cells).filter((F.col("row") > 0) & is_total(F.col("label"))).select("table", "row")


def _n_header(first: Column, most: int) -> Column:
    return F.when(first.between(1, most), first).otherwise(0).cast("long")


def header_rows(cells: DataFrame, most: int = 3) -> DataFrame:
    """(table, n_rows, n_header): rows above the first one with a figure behind the first column, if they are one to ``most``."""
    f = figures(cells)
    first = F.min(F.when((F.col("col") > 0) & F.col("figure"), F.col("row")))
    per = f.groupBy("table").agg((F.max("row") + 1).alias("n_rows"), first.alias("first"))
    return per.select("table", F.col("n_rows").cast("long").alias("n_rows"), _n_header(F.col("first"), most).alias("n_header"))


def with_header(cells: DataFrame, most: int = 3) -> DataFrame:
    """cells with ``figure``, ``value`` and ``n_header``, as in ``header_rows``."""
    first = F.min(F.when((F.col("col") > 0) & F.col("figure"), F.col("row"))).over(_by())
    return figures(cells).withColumn("n_header", _n_header(first, most))


def figure_columns(cells: DataFrame, below: int = 0, least: int = 3, share: float = 0.6) -> DataFrame:
    """(table, col, n_cells, share, is_figures): columns of ``least`` filled cells under row ``below`` of which ``share`` are figures."""
    f = figures(cells).filter(_filled() & (F.col("row") > below))
    per = f.groupBy("table", "col").agg(F.count("*").alias("n_cells"), F.avg(F.col("figure").cast("int")).alias("share"))
    return per.withColumn("is_figures", (F.col("n_cells") >= least) & (F.col("share") >= share))


def repair_figures(cells: DataFrame) -> DataFrame:
    """cells with look-alikes read as figures in figure columns; ``read_as`` keeps what was read where it changed."""
    cols = figure_columns(cells.withColumn("text", F.coalesce(T.lookalike_repair(F.col("text")), F.col("text")))).filter("is_figures").select("table", "col", F.lit(True).alias("_f"))
    fixed = F.when(F.col("_f") & (F.col("row") > 0), T.lookalike_repair(F.col("text")))
    both = cells.join(cols, ["table", "col"], "left").withColumn("_new", fixed)
    return both.withColumn("read_as", F.when(F.col("_new").isNotNull(), F.col("text"))).withColumn("text", F.coalesce("_new", "text")).drop("_f", "_new")


def _near(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= tol * F.greatest(F.abs(b), F.lit(1.0))


def marked_values(cells: DataFrame) -> DataFrame:
    """(table, row, col, value, total) of all figures; total: whether their row is a total's."""
    return figures(with_totals(cells)).filter("value is not null").select("table", "row", "col", "value", "total")


def product_checks(cells: DataFrame, tol: float = 0.011, least: int = 3, share: float = 0.75) -> DataFrame:
    """products(marked_values(cells))."""
    return products(marked_values(cells), tol, least, share)


def products(values: DataFrame, tol: float = 0.011, least: int = 3, share: float = 0.75) -> DataFrame:
    """(table, row, col, kind, ok): for column triples a x b = c, searched among all, that hold on ``least`` rows and ``share`` of them.

    The factors are an unordered pair; a row applies where it has all three figures; total rows are left out.  ``col`` is c.
    """
    row = values.filter("not total").groupBy("table", "row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("v"))  # a row's cells
    one = row.withColumn("x", F.explode("v")).withColumn("y", F.explode(F.filter("v", lambda e: e["col"] > F.col("x.col"))))
    one = one.withColumn("z", F.explode(F.filter("v", lambda e: (e["col"] != F.col("x.col")) & (e["col"] != F.col("y.col")))))
    one = one.select("table", "row", F.col("x.col").alias("a"), F.col("y.col").alias("b"), F.col("z.col").alias("col"), _near(F.col("x.value") * F.col("y.value"), F.col("z.value"), tol).alias("ok"))
    triple = Window.partitionBy("table", "a", "b", "col")
    n_ok = F.sum(F.col("ok").cast("int")).over(triple)
    kept = one.withColumn("n_ok", n_ok).withColumn("n", F.count("*").over(triple)).filter((F.col("n_ok") >= least) & (F.col("n_ok") >= share * F.col("n")))
    return kept.groupBy("table", "row", "col").agg(F.min("ok").alias("ok")).select("table", "row", "col", F.lit("product").alias("kind"), "ok")


def sum_checks(cells: DataFrame, tol: float = 0.011) -> DataFrame:
    """sums(marked_values(cells))."""
    return sums(marked_values(cells), tol)


def sums(values: DataFrame, tol: float = 0.011) -> DataFrame:
    """(table, row, col, kind, ok): each total row's figures against the sum of their column since the header or the total before."""
    down = Window.partitionBy("table", "col").orderBy("row")
    above = F.coalesce(F.sum(F.col("total").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = values.withColumn("part", above)
    inside = Window.partitionBy("table", "col", "part")
    summed = part.withColumn("sum", F.sum(F.when(~F.col("total"), F.col("value"))).over(inside)).withColumn("n", F.count(F.when(~F.col("total"), 1)).over(inside))
    return summed.filter("total and n > 0").select("table", "row", "col", F.lit("sum").alias("kind"), _near(F.col("sum"), F.col("value"), tol).alias("ok"))


def crossfoot_checks(cells: DataFrame, tol: float = 0.011, least: int = 3, share: float = 0.75) -> DataFrame:
    """crossfoots(marked_values(cells))."""
    return crossfoots(marked_values(cells), tol, least, share)


def crossfoots(values: DataFrame, tol: float = 0.011, least: int = 3, share: float = 0.75) -> DataFrame:
    """(table, row, col, kind, ok): columns that are the sum of a run of two and more figure columns before them, blanks 0.

    All runs are tried by differences of running sums; a column keeps the run that most rows satisfy (ties: first, longest).
    """
    body = values.filter("not total").withColumn("cols", F.sort_array(F.collect_set("col").over(_by())))  # a table's columns
    rows = body.groupBy("table", "row", "cols").agg(F.collect_list(F.struct("col", "value")).alias("v"))
    at = rows.select("table", "row", "v", F.posexplode("cols").alias("place", "col"))
    at = at.withColumn("value", F.get(F.filter("v", lambda e: e["col"] == F.col("col")), F.lit(0))["value"])
    at = at.withColumn("upto", F.sum(F.coalesce("value", F.lit(0.0))).over(_by("row").orderBy("col")))
    row = at.groupBy("table", "row").agg(F.sort_array(F.collect_list(F.struct("place", "col", "value", "upto"))).alias("v"))  # a row's cells
    one = row.withColumn("z", F.explode(F.filter("v", lambda e: e["value"].isNotNull())))
    starts = F.filter("v", lambda e: e["place"] <= F.col("z.place") - 2)
    one = one.withColumn("x", F.explode(starts)).withColumn("y", F.explode(F.filter("v", lambda e: (e["place"] > F.col("x.place")) & (e["place"] < F.col("z.place")))))
    total = F.col("y.upto") - F.col("x.upto") + F.coalesce("x.value", F.lit(0.0))
    one = one.select("table", "row", F.col("z.col").alias("col"), F.col("x.col").alias("a"), F.col("y.col").alias("b"), _near(total, F.col("z.value"), tol).alias("ok"))
    run = Window.partitionBy("table", "col", "a", "b")
    one = one.withColumn("n_ok", F.sum(F.col("ok").cast("int")).over(run)).withColumn("n", F.count("*").over(run))
    kept = one.filter((F.col("n_ok") >= least) & (F.col("n_ok") >= share * F.col("n")))
    best = F.dense_rank().over(_by("col").orderBy(F.desc("n_ok"), "a", F.desc("b")))
    return kept.withColumn("nth", best).filter("nth = 1").select("table", "row", "col", F.lit("crossfoot").alias("kind"), "ok")


#: Kinds of checks.
CHECKS = ("product", "sum", "crossfoot")


def check_cells(cells: DataFrame, tol: float = 0.011, kinds: tuple[str, ...] = CHECKS) -> DataFrame:
    """(table, row, col, state): 'ok' or 'fail' for the cells that some check of these kinds judges; one that fails wins.

    The tables' figures are written once and read by the checks.
    """
    values = materialize(marked_values(cells), "figures")
    by = {"product": products, "sum": sums, "crossfoot": crossfoots}
    every = reduce(DataFrame.unionByName, [by[k](values, tol) for k in kinds])
    return every.groupBy("table", "row", "col").agg(F.when(F.min("ok"), "ok").otherwise("fail").alias("state"))


def check_counts(states: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(table, n_ok, n_fail): checked cells of each table, those of the tables nested in it included; parents (child, parent)."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    rows = states
    if parents is not None:
        up = parents.select(F.col("child").alias("table"), F.col("parent").alias("_p"))
        rows = states.join(up, "table", "left").select(F.explode(F.array_distinct(F.array_compact(F.array("table", "_p")))).alias("table"), "state")
    return rows.groupBy("table").agg(n("ok").alias("n_ok"), n("fail").alias("n_fail"))


def split_totals(cells: DataFrame) -> DataFrame:
    """cells with ``part`` ('body' or 'totals') and their row in it: rows from the first total row on are a table of their own."""
    marked = with_totals(cells)
    both = marked.withColumn("_first", F.min(F.when(F.col("total"), F.col("row"))).over(_by())).drop("label", "total")
    late = F.col("row") >= F.col("_first")
    out = both.withColumn("part", F.when(late, "totals").otherwise("body")).withColumn("part_row", F.when(late, F.col("row") - F.col("_first")).otherwise(F.col("row")))
    return out.drop("_first")


def trim_notes(cells: DataFrame, words: int = 5) -> DataFrame:
    """cells without leading caption rows and trailing note rows, rows renumbered.

    Such a row has one filled cell: of ``words`` words and more, or headed like a caption, or with a reference in it.
    """
    f = cells.filter(_filled()).groupBy("table", "row").agg(F.count("*").alias("n"), F.min_by("text", "col").alias("t"))
    odd = (F.col("n") == 1) & ((F.size(T.tokens(F.col("t"))) >= words) | F.col("t").rlike(CAPTION) | F.col("t").rlike(NOTE))
    proper = f.filter(~odd).groupBy("table").agg(F.min("row").alias("_lo"), F.max("row").alias("_hi"))
    both = cells.join(proper, "table").filter((F.col("row") >= F.col("_lo")) & (F.col("row") <= F.col("_hi")))
    return both.withColumn("row", F.col("row") - F.col("_lo")).drop("_lo", "_hi")


def merge_paren_columns(cells: DataFrame, share: float = 0.6) -> DataFrame:
    """cells with companion columns joined to their left neighbours and columns renumbered.

    A companion's every filled cell is a bracketed figure beside a cell that ends in a figure, on ``share`` of such rows at least.
    Header rows do not count.  Runs of companions join the same column.
    """
    own = cells.select("table", "row", "col", "text", _filled().alias("_full"))
    own = with_header(own).withColumn("_t", F.when(F.col("_full") & (F.col("row") >= F.col("n_header")), F.trim("text")))
    own = own.withColumn("_ends", F.coalesce(F.col("_t").rlike(r"[0-9][)%]?$"), F.lit(False)))
    beside = F.max("_ends").over(_by("row").orderBy("col").rangeBetween(-1, -1))
    own = own.withColumn("_fits", F.col("_t").rlike(r"^[(][-+$]?[0-9][0-9.,]*%?[)]$") & F.coalesce(beside, F.lit(False)))
    along = _by().orderBy("col")
    n = lambda c, w: F.count(F.when(c, 1)).over(w)
    own = own.withColumn("_room", n(F.col("_ends"), along.rangeBetween(-1, -1)))
    for name, c in (("_filled", F.col("_t").isNotNull()), ("_fit", F.col("_fits"))):
        own = own.withColumn(name, n(c, _by("col")))
    joins = (F.col("col") > 0) & (F.col("_filled") > 0) & (F.col("_filled") == F.col("_fit")) & (F.col("_fit") >= share * F.col("_room"))
    # A column counts at its first cell.
    first = F.row_number().over(_by("col").orderBy("row")) == 1
    own = own.withColumn("_new", (first & ~joins).cast("int"))
    to = F.sum("_new").over(along.rangeBetween(Window.unboundedPreceding, 0)) - 1
    merged = own.withColumn("_to", to).filter("_full")
    parts = F.array_sort(F.collect_list(F.struct("col", "text")))  # a column and its companions
    return merged.groupBy("table", "row", F.col("_to").alias("col")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def row_kinds(cells: DataFrame) -> DataFrame:
    """(table, row, kind): 'figures' where all filled cells are, 'text' where none is, else 'mixed'; empty rows have no row."""
    f = figures(cells).filter(_filled()).groupBy("table", "row").agg(F.avg(F.col("figure").cast("int")).alias("s"))
    return f.select("table", "row", F.when(F.col("s") == 1, "figures").when(F.col("s") == 0, "text").otherwise("mixed").alias("kind"))


def merge_item_rows(cells: DataFrame, share: float = 0.6, n_header: int = 1) -> DataFrame:
    """cells with two-line items as one row: a text row and the figure row behind it (or before it, whichever way fits more).

    Only in tables of whose rows under the first ``n_header`` ``share`` stand in such pairs; a pair's cells of one column are joined
    with a blank.
    """
    # A row's kind stands at each of its cells, and counts at the first: cells are dealt by table once, rows met by windows.
    f = figures(cells).filter(_filled()).withColumn("s", F.avg(F.col("figure").cast("int")).over(_by("row")))
    kind = F.when(F.col("row") < n_header, None).when(F.col("s") == 1, "figures").when(F.col("s") == 0, "text").otherwise("mixed")
    leads = F.row_number().over(_by("row").orderBy("col")) == 1
    f = f.withColumn("kind", kind).withColumn("leads", leads & F.col("kind").isNotNull())
    f = f.withColumn("above", F.max("kind").over(_by().orderBy("row").rangeBetween(-1, -1)))
    pair = lambda a, b: (F.col("above") == a) & (F.col("kind") == b)
    n = lambda c: F.sum(F.when(F.col("leads") & c, 2).otherwise(0)).over(_by())
    f = f.withColumn("n", n(F.lit(True)) / 2).withColumn("after", n(pair("text", "figures"))).withColumn("before", n(pair("figures", "text")))
    way = F.when((F.col("after") >= F.col("before")) & (F.col("after") >= share * F.col("n")), "after").when(F.col("before") >= share * F.col("n"), "before")
    joins = ((way == "after") & pair("text", "figures")) | ((way == "before") & pair("figures", "text"))
    f = f.withColumn("_to", F.when(joins, F.col("row") - 1).otherwise(F.col("row")))
    f = f.withColumn("_new", F.dense_rank().over(_by().orderBy("_to")) - 1)
    parts = F.array_sort(F.collect_list(F.struct("row", "text")))  # two rows of a column
    return f.groupBy("table", F.col("_new").alias("row"), "col").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def label_spans(cells: DataFrame) -> DataFrame:
    """(table, row, col, text, rowspan, colspan, role) of the filled cells.

    A label of the first column spans down over rows that lack one but are filled ('group'), where those have at least another label
    above them; a body row with a label only spans all columns ('section'); a total's label that is set right spans from the left
    edge ('total'); other cells are 'cell'.
    """
    f = with_header(cells).withColumn("n_cols", F.max("col").over(_by()) + 1).filter(_filled())
    in_row = _by("row")
    f = f.withColumn("first", F.min("col").over(in_row)).withColumn("n", F.count("*").over(in_row)).withColumn("body", F.col("row") >= F.col("n_header"))
    section = F.col("body") & (F.col("col") == 0) & (F.col("n") == 1) & ~F.col("figure")
    total = F.col("body") & (F.col("col") == F.col("first")) & (F.col("col") > 0) & is_total(F.col("text"))
    f = f.withColumn("role", F.when(section, "section").when(total, "total").otherwise("cell"))
    # Rows that continue a group: filled, without a first cell, no total, under a row with a label that is no section.  A row counts
    # at its first cell.
    has = lambda role: F.max(F.col("role") == role).over(in_row)
    f = f.withColumn("labelled", F.col("first") == 0).withColumn("sectioned", has("section")).withColumn("totalled", has("total"))
    leads = F.col("col") == F.col("first")
    opens = leads & (F.col("labelled") | F.col("totalled") | ~F.col("body"))
    f = f.withColumn("group", F.sum(opens.cast("int")).over(_by().orderBy("row").rangeBetween(Window.unboundedPreceding, 0)))
    in_group = _by("group")
    f = f.withColumn("span", F.sum(leads.cast("int")).over(in_group)).withColumn("step", F.max("row").over(in_group) - F.min("row").over(in_group) + 1)
    f = f.withColumn("down", F.when(F.col("labelled") & F.col("body") & ~F.col("sectioned") & (F.col("span") == F.col("step")), F.col("span")).otherwise(1))
    grouped = (F.col("col") == 0) & (F.col("down") > 1)
    return f.select(
        "table",
        "row",
        F.when(F.col("role") == "total", 0).otherwise(F.col("col")).alias("col"),
        "text",
        F.when(grouped, F.col("down")).otherwise(1).cast("long").alias("rowspan"),
        F.when(F.col("role") == "section", F.col("n_cols")).when(F.col("role") == "total", F.col("col") + 1).otherwise(1).cast("long").alias("colspan"),
        F.when(grouped, "group").otherwise(F.col("role")).alias("role"),
    )


def with_spans(cells: DataFrame) -> DataFrame:
    """cells with rowspan and colspan, 1 where the table has no such columns."""
    for c in ("rowspan", "colspan"):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(1).cast("long"))
    return cells


def header_paths(cells: DataFrame, sep: str = " > ") -> DataFrame:
    """(table, row, col, text, col_path, row_path) of filled body cells right of the stub.

    The stub is the leading columns of which fewer than half of the filled body cells are figures.  A cell's column headers are the
    header cells whose columns meet its own, by row; its row headers the stub's cells whose rows meet its own, by column.
    """
    f = with_header(with_spans(cells).filter(_filled())).withColumn("body", F.col("row") >= F.col("n_header"))
    f = f.withColumn("label", F.avg(F.when(F.col("body"), F.col("figure").cast("int"))).over(_by("col")) < 0.5)
    f = f.withColumn("first", F.min(F.when(F.col("body") & ~F.col("label"), F.col("col"))).over(_by()))
    leading = F.col("body") & (F.col("first").isNull() | (F.col("col") < F.col("first")))
    f = f.withColumn("n_stub", F.coalesce(F.max(F.when(leading, F.col("col"))).over(_by()) + 1, F.lit(0)))
    head = F.struct("row", "col", "colspan", "text")
    f = f.withColumn("heads", F.sort_array(F.collect_list(F.when(~F.col("body"), head)).over(_by()))).filter("body")  # a table's headers
    mine = F.filter("heads", lambda h: (h["col"] < F.col("col") + F.col("colspan")) & (F.col("col") < h["col"] + h["colspan"]))
    f = f.withColumn("col_path", F.array_join(F.transform(mine, lambda h: h["text"]), sep))
    # Stub cells meet the others of each row that they take in.
    rows = f.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rowspan").cast("long") - 1))).withColumn("at", F.col("row") + F.col("at"))
    beside = F.struct("col", "row", "text")
    rows = rows.withColumn("stub", F.collect_list(F.when(F.col("col") < F.col("n_stub"), beside)).over(Window.partitionBy("table", "at")))
    cell = rows.filter("col >= n_stub").groupBy("table", "row", "col", "text", "col_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("stub")))).alias("stub"))
    return cell.select("table", "row", "col", "text", "col_path", F.array_join(F.transform("stub", lambda h: h["text"]), sep).alias("row_path"))


def fix_texts(cells: DataFrame) -> DataFrame:
    """cells with split figures joined, an S for a dollar sign read as one, masked numbers in lower case, and columns of ticks as ticks."""
    t = F.trim("text")
    joined = F.when(t.rlike(r"^[$]?[0-9]{1,3}(?:, ?[0-9]{3})+(?:[.][0-9]+)?$"), F.regexp_replace(t, ", ", ",")).otherwise(t)
    signed = F.when(joined.rlike(r"^[Ss§] ?[0-9][0-9,]*(?:[.][0-9]+)?$"), F.concat(F.lit("$"), F.ltrim(F.substr(joined, F.lit(2))))).otherwise(joined)
    plain = F.when(signed.rlike(r"^[xX*]{2,}[0-9]{2,}$"), F.lower(signed)).otherwise(signed)
    fixed = cells.withColumn("text", plain)
    tick = F.col("text").isin(*TICKS)
    only = F.min(F.when(_filled() & (F.col("row") > 0), tick)).over(_by("col"))
    return fixed.withColumn("text", F.when(F.coalesce(only, F.lit(False)) & tick & (F.col("row") > 0), "✓").otherwise(F.col("text")))


def shape_features(cells: DataFrame) -> DataFrame:
    """(table, n_rows, n_cols, filled, figures, words, prose): a table's shape, shares of its slots and of its filled cells."""
    f = figures(cells).filter(_filled())
    words = F.size(T.tokens(F.col("text")))
    per = f.groupBy("table").agg(
        (F.max("row") + 1).cast("double").alias("n_rows"),
        (F.max("col") + 1).cast("double").alias("n_cols"),
        F.count("*").alias("n"),
        F.avg(F.col("figure").cast("int")).alias("figures"),
        F.avg(words).alias("words"),
        F.avg((words >= 6).cast("int")).alias("prose"),
    )
    return per.select("table", "n_rows", "n_cols", (F.col("n") / (F.col("n_rows") * F.col("n_cols"))).alias("filled"), "figures", "words", "prose")


def prefer(first: DataFrame, second: DataFrame, weights: list[float], constant: float = 0.0) -> DataFrame:
    """(table, p, takes_second): logistic preference for the second of two readings, from both shapes and their differences.

    weights: for the six features of the first reading, of the second, and second less first; a missing reading loses.
    """
    names = ["n_rows", "n_cols", "filled", "figures", "words", "prose"]
    a, b = (shape_features(x).select("table", *[F.col(n).alias(f"{n}_{k}") for n in names]) for k, x in enumerate((first, second)))
    both = a.join(b, "table", "full")
    x = [F.col(f"{n}_0") for n in names] + [F.col(f"{n}_1") for n in names] + [F.col(f"{n}_1") - F.col(f"{n}_0") for n in names]
    z = reduce(lambda s, wx: s + wx[0] * wx[1], zip(weights, x, strict=True), F.lit(constant))
    p = F.when(F.col("n_rows_1").isNull(), 0.0).when(F.col("n_rows_0").isNull(), 1.0).otherwise(1 / (1 + F.exp(-z)))
    return both.select("table", p.alias("p"), (p >= 0.5).alias("takes_second"))


def grid(cells: DataFrame) -> DataFrame:
    """(table, r, c, dy, dx, text, rowspan, colspan): every slot of each table, and its place in the cell that takes it; null: empty."""
    c = with_spans(cells)
    over = c.select("*", F.explode(F.sequence(F.lit(0), F.col("rowspan").cast("int") - 1)).alias("dy"))
    over = over.select("*", F.explode(F.sequence(F.lit(0), F.col("colspan").cast("int") - 1)).alias("dx"))
    more = [x for x in c.columns if x not in ("table", "row", "col", "text", "rowspan", "colspan")]
    taken = over.select("table", (F.col("row") + F.col("dy")).alias("r"), (F.col("col") + F.col("dx")).alias("c"), "dy", "dx", "text", "rowspan", "colspan", *more)
    reach = c.groupBy("table").agg(F.max(F.col("row") + F.col("rowspan") - 1).alias("h"), F.max(F.col("col") + F.col("colspan") - 1).alias("w"))
    long = lambda x: F.col(x).cast("long")
    slots = reach.select("table", "w", F.explode(F.sequence(F.lit(0).cast("long"), long("h"))).alias("r"))
    slots = slots.select("table", "r", F.explode(F.sequence(F.lit(0).cast("long"), long("w"))).alias("c"))
    return slots.join(taken.withColumn("r", long("r")).withColumn("c", long("c")).hint("merge"), ["table", "r", "c"], "left")  # both sides grow with the tables


def slot_lines(cells: DataFrame, value: Column, empty: str, line: Callable[[Column], Column], sep: str, name: str) -> DataFrame:
    """(table, name): every slot of each table by ``value`` (of text and of dy and dx, the place in its cell), ``empty`` where no cell is;
    ``line`` of a row's values, and these joined by ``sep``.

    Cells are dealt by table once; the slots that no cell takes are filled in their row, not met by a join.
    """
    # What is missing of 0 to last among some sorted places.
    lacks = lambda at, last: F.filter(F.sequence(F.lit(0).cast("long"), last), lambda x: ~F.array_contains(at, x))
    reach = lambda at, span: F.max(F.col(at) + F.col(span) - 1).over(_by()).cast("long")
    c = with_spans(cells).select("table", "row", "col", "text", "rowspan", "colspan", reach("row", "rowspan").alias("h"), reach("col", "colspan").alias("w"))
    over = c.select("*", F.explode(F.sequence(F.lit(0), F.col("rowspan").cast("int") - 1)).alias("dy"))
    over = over.select("*", F.explode(F.sequence(F.lit(0), F.col("colspan").cast("int") - 1)).alias("dx"))
    taken = over.select("table", "h", "w", (F.col("row") + F.col("dy")).cast("long").alias("r"), (F.col("col") + F.col("dx")).cast("long").alias("c"), value.alias("v")).filter("r >= 0 and c >= 0")
    rows = taken.groupBy("table", "h", "w", "r").agg(F.collect_list(F.struct("c", "v")).alias("s"))
    rest = F.transform(lacks(F.col("s")["c"], F.col("w")), lambda x: F.struct(x.alias("c"), F.lit(empty).alias("v")))
    rows = rows.select("table", "h", "w", "r", line(F.transform(F.array_sort(F.concat("s", rest)), lambda x: x["v"])).alias("v"))
    blank = line(F.transform(F.sequence(F.lit(0).cast("long"), F.col("w")), lambda x: F.lit(empty)))
    per = rows.groupBy("table", "h", "w").agg(F.collect_list(F.struct("r", "v")).alias("s"))
    rest = F.transform(lacks(F.col("s")["r"], F.col("h")), lambda x: F.struct(x.alias("r"), blank.alias("v")))
    return per.select("table", F.array_join(F.transform(F.array_sort(F.concat("s", rest)), lambda x: x["v"]), sep).alias(name))


def structure_tokens(cells: DataFrame) -> DataFrame:
    """(table, tokens): each slot's token row by row: fcel or ecel where a cell starts, filled or empty; lcel where one spans on from
    the left, ucel from above, xcel from both; nl behind each row.  Slots without a cell are empty cells."""
    start = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", "fcel").otherwise("ecel")
    token = F.when((F.col("dy") > 0) & (F.col("dx") > 0), "xcel").when(F.col("dy") > 0, "ucel").when(F.col("dx") > 0, "lcel").otherwise(start)
    return slot_lines(cells, token, "ecel", lambda row: F.concat_ws(" ", row, F.lit("nl")), " ", "tokens")


def cells_of_tokens(tokens: list[str]) -> list[tuple[int, int, int, int, bool]]:
    """(row, col, rowspan, colspan, filled) of a token sequence; an invalid one is repaired.

    Short rows are padded with empty cells; a token that goes on from nothing starts an empty cell; what goes on from a cell to the
    left or above grows that cell only while it stays a rectangle.
    """
    rows, row = [], []
    for t in tokens:
        if t == "nl":
            rows.append(row)
            row = []
        else:
            row.append(t)
    if row:
        rows.append(row)
    width = max(map(len, rows), default=0)
    owner: dict[tuple[int, int], int] = {}
    cells: list[list] = []

    def begin(r: int, c: int, filled: bool) -> None:
        owner[r, c] = len(cells)
        cells.append([r, c, 1, 1, filled])

    for r, line in enumerate(rows):
        for c, t in enumerate(line + ["ecel"] * (width - len(line))):
            left, up = owner.get((r, c - 1)), owner.get((r - 1, c))
            if t == "lcel" and left is not None and cells[left][0] == r:
                owner[r, c] = left
                cells[left][3] = c - cells[left][1] + 1
            elif t in ("ucel", "xcel") and up is not None and (t == "ucel") == (cells[up][1] == c):
                if t == "ucel" or owner.get((r, c - 1)) == up:
                    owner[r, c] = up
                    cells[up][2] = r - cells[up][0] + 1
                else:
                    begin(r, c, False)
            else:
                begin(r, c, t == "fcel")
    # A cell that grew down on some of its columns only is cut back to its full rows; the rest are empty cells.
    out = []
    for k, (r, c, h, w, filled) in enumerate(cells):
        while h > 1 and any(owner.get((r + h - 1, c + x)) != k for x in range(w)):
            h -= 1
        out.append((r, c, h, w, filled))
        out += [(y, x, 1, 1, False) for (y, x), o in owner.items() if o == k and not (r <= y < r + h and c <= x < c + w)]
    return sorted(out)


def decode_tokens(df: DataFrame, key: str = "table", tokens: str = "tokens") -> DataFrame:
    """(table, row, col, rowspan, colspan, filled): the cells of each sequence of structure tokens."""
    kind = "array<struct<row:long,col:long,rowspan:long,colspan:long,filled:boolean>>"
    read = F.udf(lambda s: cells_of_tokens(s.split()) if s else [], kind, useArrow=True)
    return df.select(F.col(key).alias("table"), F.explode(read(F.col(tokens))).alias("c")).select("table", "c.*")


def place_cells(rows: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(row, col) of each cell of an HTML table, whose rows list (rowspan, colspan): the first free slots, spans from above kept free."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, line in enumerate(rows):
        c = 0
        for h, w in line:
            while any((r, c + x) in taken for x in range(w)):
                c += 1
            taken.update((r + y, c + x) for y in range(h) for x in range(w))
            out.append((r, c))
            c += w
    return out
