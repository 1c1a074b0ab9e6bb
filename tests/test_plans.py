"""Queries over printed ledgers read their input once or twice, however many operators they run."""

import pytest

from leafmill.operators import headers
from leafmill.queries import catalog, headings, ledger, paged, printed  # noqa: F401  (the others register their queries)
from tests.compare import difference, views

MOST = {
    "ledger_products": (1, 3), "ledger_sums": (1, 3), "ledger_split": (1, 3), "label_spans": (1, 3), "ledger_paths": (1, 3), "crossfoot_cells": (2, 4),
    "otsl_encode": (2, 8), "otsl_decode": (2, 8), "ledger_states": (3, 8),
    "junction_spines": (1, 4), "junction_meshes": (1, 4), "printed_phrases": (1, 4), "printed_rows": (1, 4), "printed_tables": (1, 4), "found_tables": (3, 20), "box_order": (1, 2),
    "paren_columns": (1, 3),
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_scans_and_exchanges(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = MOST[name]
    assert plan.count("FileScan") <= scans and plan.count("Exchange ") <= exchanges


def test_box_order_makes_no_pandas_group_a_page(spark):
    plan = catalog.QUERIES["box_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("ArrowEvalPython") == 1


def test_split_words_deals_words_not_characters(spark):
    """Every character was a row before it met the cells, so the text was dealt and sorted once for each of its letters."""
    plan = catalog.QUERIES["split_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.index("Join") :]


def test_split_words_over_shared_and_missing_cells(spark):
    """Against each character by itself: cells over one another, two boxes of one cell, ground without a cell."""
    words = [(1, k, "abcdefghij"[: 1 + k % 10], 3.0 * k, 0.0, 3.0 * k + 7.0 * (1 + k % 10), 10.0) for k in range(40)]
    cells = [(1, 0, 0, 0.0, -5.0, 33.0, 20.0), (1, 0, 1, 30.0, -5.0, 71.0, 20.0), (1, 0, 1, 80.0, -5.0, 99.0, 20.0), (1, 1, 0, 90.0, -5.0, 131.0, 20.0), (1, 2, 0, 0.0, 30.0, 400.0, 60.0)]
    want = set()
    for page, word, t, x0, y0, x1, y1 in words:
        parts = {}
        for i, c in enumerate(t):
            x, y = x0 + (x1 - x0) * (i + 0.5) / len(t), (y0 + y1) / 2
            own = min(((r, k) for p, r, k, a, b, e, f in cells if p == page and a <= x < e and b <= y < f), default=None)
            if own:
                parts[own] = parts.get(own, "") + c
        most = max((len(p) for p in parts.values()), default=0) / len(t)
        want |= {(page, word, *at, t if most >= 0.75 else p) for at, p in parts.items() if most < 0.75 or len(p) / len(t) == most}
    box = "x0 double, y0 double, x1 double, y1 double"
    found = printed.W.split_at_cells(spark.createDataFrame(words, f"page long, word long, text string, {box}"), spark.createDataFrame(cells, f"page long, row long, col long, {box}"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_header_cells_and_words_are_dealt_by_table_once(spark):
    """Places of words were joined back to the words, and cells dealt by row, by table and by cell again."""
    plan = catalog.QUERIES["rebuilt_headers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    frames = headers._frames(headings.read_cells(w := headings.headed_words(spark, "/root/testdata/sf0.001")), w.drop("row", "col"))
    below = frames._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 4 and below.count("Exchange ") <= 6 and "Join" not in below


def test_holders_over_shared_tiles_and_null_keys(spark):
    """Against each word by itself: boxes over one another, words without page or name, boxes without page."""
    words = [(p, w, 13.0 * (w or 0), 7.0 * ((w or 0) % 9), 13.0 * (w or 0) + 8, 7.0 * ((w or 0) % 9) + 5) for p in (1, 2, None) for w in [*range(30), None]]
    boxes = [(p, k, 40.0 * k, 0.0, 40.0 * k + 150, 20.0 + 9 * k) for p in (1, None) for k in range(8)]
    want = []
    for p, w, x0, y0, x1, y1 in words:
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        want.append((p, w, min((k for q, k, a, b, c, d in boxes if p is not None and w is not None and p == q and a <= x < c and b <= y < d), default=None)))
    box = "x0 double, y0 double, x1 double, y1 double"
    found = headers.zones.holders(spark.createDataFrame(words, f"page long, word long, {box}"), spark.createDataFrame(boxes, f"page long, k long, {box}"), "k")
    assert found.columns == ["page", "word", "x0", "y0", "x1", "y1", "k"]
    assert sorted(((r.page, r.word, r.k) for r in found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["label_spans", "ledger_paths", "ledger_split", "ledger_sums", "ledger_products"])
def test_tasks_take_a_bounded_number_of_lines(spark, monkeypatch, name):
    """The session's shuffle partitions bounded nothing: a task's lines grew with the table."""
    monkeypatch.setattr(ledger.dealt, "__defaults__", (500,))
    sf = "/root/testdata/sf0.001"
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    assert n > 4 and f", {n}), REPARTITION_BY_NUM" in plan
    assert difference(spark, views(sf), catalog.QUERIES[name], catalog.ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", ["table_csv", "otsl_encode", "item_rows"])
def test_lines_are_dealt_once_and_cells_never(spark, name):
    """Slots were joined with the cells, rows with the cells they move; cells were dealt by row, by slot and by table in turn."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1 and "Join" not in plan


def test_slots_of_odd_tables(spark):
    """Rows and columns without a cell, cells over one another, an empty text and one of null, a table of one far cell."""
    cells = [(1, 0, 0, "a", 1, 2), (1, 0, 1, "b", 1, 1), (1, 2, 3, None, 2, 1), (1, 4, 0, " ", 1, 1), (2, 2, 1, 'x,"y"', 1, 1)]
    df = spark.createDataFrame(cells, "table long, row long, col long, text string, rowspan int, colspan int")
    tokens = {r.table: r.tokens for r in ledger.tables.structure_tokens(df).collect()}
    blank = "ecel ecel ecel ecel nl"
    assert tokens == {1: f"fcel fcel lcel ecel ecel nl {blank} ecel ecel ecel ecel nl ecel ecel ecel ucel nl ecel ecel ecel ecel nl", 2: "ecel ecel nl ecel ecel nl ecel fcel nl"}
    csv = {r.table: r.csv for r in ledger.sinks.table_csv(df).collect()}
    assert csv == {1: "# Table 1\na,,b,,\n,,,\n,,,\n,,,\n ,,,\n", 2: '# Table 2\n,\n,\n,"x,""y"""\n'}
