"""Results as documents: tables as HTML, CSV and JSON, pages as hOCR, and bundles of a page's files.

Each gives a column of text or bytes a row per table or page; ``files.write_files`` puts them into files.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import tables


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _in_order(order: list[str], value: str) -> Column:
    """Values of a group in the order of the columns, as an array (a row's cells, or a table's rows)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])


def _with_header(cells: DataFrame) -> DataFrame:
    if "n_header" in cells.columns:
        return cells
    return cells.join(tables.header_rows(cells).select("table", "n_header"), "table")


def _one_level(cells: DataFrame) -> DataFrame:
    """(table, html): cells with n_header, and inner: HTML of what is nested in them."""
    keep = ["table", "row", "col", "text", "rowspan", "colspan", "inner", *(["state"] if "state" in cells.columns else [])]
    g = tables.grid(tables.with_spans(cells).select(*keep))
    g = g.join(cells.select("table", "n_header").distinct(), "table").filter("dy is null or (dy = 0 and dx = 0)")
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    state = F.when(F.col("state").isNotNull(), F.concat(F.lit(' class="'), F.col("state"), F.lit('"'))).otherwise("") if "state" in cells.columns else F.lit("")
    attrs = F.concat(F.coalesce(span("rowspan"), F.lit("")), F.coalesce(span("colspan"), F.lit("")), state)
    content = F.concat(escaped(F.col("text")), F.coalesce("inner", F.lit("")))
    head = F.concat(F.lit('<th scope="col"'), attrs, F.lit(">"), content, F.lit("</th>"))
    body = F.concat(F.lit("<td"), attrs, F.lit(">"), content, F.lit("</td>"))
    rows = g.withColumn("h", F.when(F.col("r") < F.col("n_header"), head).otherwise(body)).groupBy("table", "r").agg(F.array_join(_in_order(["c"], "h"), "").alias("h"))
    rows = rows.withColumn("h", F.concat(F.lit("<tr>"), F.col("h"), F.lit("</tr>")))
    return rows.groupBy("table").agg(F.concat(F.lit("<table>"), F.array_join(_in_order(["r"], "h"), ""), F.lit("</table>")).alias("html"))


def table_html(cells: DataFrame, nested: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """(table, html) of cells (table, row, col, text[, rowspan, colspan, state, n_header]).

    Header rows hold th with a scope, slots without a cell are empty, a check's state is a class.  nested (child, table, row, col) puts
    tables into cells, down to ``depth`` levels; those that stand in another have no row of their own.
    """
    cells = _with_header(cells).withColumn("inner", F.lit(None).cast("string"))
    if nested is None:
        return _one_level(cells)
    own = nested.select("child", F.col("table").alias("_t"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    base, html = cells.drop("inner"), None
    for _ in range(depth):  # each round puts one more level into its cells
        html = _one_level(cells)
        inside = html.join(own, html["table"] == own["child"]).groupBy("_t", "_r", "_c").agg(F.array_join(_in_order(["child"], "html"), "").alias("inner"))
        on = (base["table"] == inside["_t"]) & (base["row"] == inside["_r"]) & (base["col"] == inside["_c"])
        cells = base.join(inside, on, "left").drop("_t", "_r", "_c")
    return _one_level(cells).join(own.select(F.col("child").alias("table")), "table", "left_anti")


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\n\\r]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def table_csv(cells: DataFrame, number: str = "table") -> DataFrame:
    """(table, csv): a block headed ``# Table N`` (the column ``number``, N.M for a nested one), a line a row, spans as empty fields."""
    start = F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("text"))
    block = tables.slot_lines(cells, F.coalesce(csv_field(start), F.lit("")), "", lambda row: F.array_join(row, ","), "\n", "body").filter("table is not null")
    if number == "table":
        block = block.withColumn("_n", F.col("table").cast("string"))
    else:
        block = block.join(cells.select("table", F.col(number).cast("string").alias("_n")).distinct(), "table")
    return block.select("table", F.concat(F.lit("# Table "), F.col("_n"), F.lit("\n"), F.col("body"), F.lit("\n")).alias("csv"))


def table_json(cells: DataFrame) -> DataFrame:
    """(table, json): a record with its sizes, header rows and cells in order."""
    c = _with_header(tables.with_spans(cells))
    one = F.struct("row", "col", "rowspan", "colspan", "text")
    per = c.groupBy("table").agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols"), F.max("n_header").alias("header_rows"), F.array_sort(F.collect_list(one)).alias("cells"))
    return per.select("table", F.to_json(F.struct("n_rows", "n_cols", "header_rows", "cells")).alias("json"))


def _bbox(*more: Column) -> Column:
    box = F.concat_ws(" ", *[F.round(c).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")])
    return F.concat(F.lit("bbox "), box, *more)


def hocr(words: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """(page, hocr): words (page, block, line, word, text, conf, x0, y0, x1, y1[, graphic]) as XHTML.

    Areas stand in the order of their blocks, lines that are in none (null) in a last one; lines flagged graphic are left out; conf, 0
    to 1, is written in per cent.  extras (page, place, html) puts tables, pictures and the like behind the areas.
    """
    if "graphic" in words.columns:
        words = words.filter(~F.coalesce("graphic", F.lit(False)))
    none = F.col("block").isNull()
    w = words.withColumn("none", none).withColumn("block", F.coalesce("block", F.lit(0)))
    conf = F.concat(F.lit("; x_wconf "), F.round(F.col("conf") * 100).cast("long").cast("string"))
    span = F.concat(F.lit("<span class='ocrx_word' title='"), _bbox(conf), F.lit("'>"), escaped(F.col("text")), F.lit("</span>"))
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]

    def level(df: DataFrame, keys: list[str], item: str, kind: str, sep: str) -> DataFrame:
        got = df.groupBy(*keys).agg(F.array_join(_in_order([item], "h"), sep).alias("h"), *hull)
        return got.withColumn("h", F.concat(F.lit(f"<{kind[0]} class='{kind[1]}' title='"), _bbox(), F.lit("'>"), F.col("h"), F.lit(f"</{kind[0]}>")))

    lines = level(w.withColumn("h", span), ["page", "none", "block", "line"], "word", ("span", "ocr_line"), " ")
    areas = level(lines, ["page", "none", "block"], "line", ("div", "ocr_carea"), "")
    areas = areas.withColumn("place", F.struct(F.col("none").cast("int").alias("a"), F.col("block").cast("long").alias("b"))).select("page", "place", "h", "x0", "y0", "x1", "y1")
    if extras is not None:
        zero = F.lit(None).cast("double")
        more = extras.select("page", F.struct(F.lit(2).alias("a"), F.col("place").cast("long").alias("b")).alias("place"), F.col("html").alias("h"), *[zero.alias(c) for c in ("x0", "y0", "x1", "y1")])
        areas = areas.unionByName(more)
    pages = level(areas, ["page"], "place", ("div", "ocr_page"), "")
    head = "<!DOCTYPE html><html xmlns='http://www.w3.org/1999/xhtml'><head><title></title><meta charset='utf-8'/></head><body>"
    return pages.select("page", F.concat(F.lit(head), F.col("h"), F.lit("</body></html>")).alias("hocr"))


def name_image(hocr_column: Column, name: Column) -> Column:
    """hOCR whose page names its image."""
    at = "<div class='ocr_page' title='"
    return F.replace(hocr_column, F.lit(at), F.concat(F.lit(at + 'image "'), escaped(name), F.lit('"; ')))


def bundle(*files: tuple[Column, Column]) -> Column:
    """Bytes of a zip archive of (name, content) columns, text or bytes; null contents are left out; equal contents, equal bytes."""

    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        def one(entries) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for e in entries:
                    if e["content"] is not None:
                        z.writestr(zipfile.ZipInfo(e["name"], (1980, 1, 1, 0, 0, 0)), bytes(e["content"]), zipfile.ZIP_DEFLATED)
            return out.getvalue()

        return rows.map(one)

    return pack(F.array(*[F.struct(n.cast("string").alias("name"), c.cast("binary").alias("content")) for n, c in files]))


def reading_text(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, text): lines (page, block, line, text) joined by line breaks, blocks by empty lines, in order."""
    block = lines.groupBy(page, "block").agg(F.array_join(_in_order(["line"], "text"), "\n").alias("t"))
    return block.groupBy(page).agg(F.array_join(_in_order(["block"], "t"), "\n\n").alias("text"))


def numbered_tables(tops: DataFrame, nested: DataFrame) -> DataFrame:
    """(table, number): top tables 1, 2, ... by (page, y0, x0) within a page, nested ones N.M by id.  tops (page, table, x0, y0)."""
    n = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "table")).cast("string")
    own = tops.join(nested.select(F.col("child").alias("table")), "table", "left_anti").select("page", "table", n.alias("number"))
    m = F.row_number().over(Window.partitionBy("table").orderBy("child")).cast("string")
    below = nested.select("child", "table", m.alias("m")).join(own.select("table", "number"), "table").select(F.col("child").alias("table"), F.concat_ws(".", "number", "m").alias("number"))
    return own.select("table", "number").unionByName(below)
