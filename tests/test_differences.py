"""Small tables on which queries differed from their SQL."""

import duckdb
import pytest

from leafmill.queries import catalog, ledger, paged, reading, repair, standard  # noqa: F401  (they register their queries)
from tests.compare import difference, views


def _differs(spark, tmp_path, name: str, **tables: str) -> str:
    for table, sql in tables.items():
        duckdb.sql(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
    return difference(spark, views(str(tmp_path)), catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))


def test_ledger_states_without_chance_sums_across(spark, tmp_path):
    # Three of four lines have a count of one, so that count and price come near the amount.
    rows = "values (19720, 10996, 1, 1, 14.0, 49883.4), (19720, 6884, 1, 2, 1.0, 55745.24), (19720, 3573, 1, 3, 1.0, 6309.7), (19720, 5753, 1, 4, 1.0, 101920.92)"
    sql = f"select k::bigint l_orderkey, p::bigint l_partkey, s::bigint l_suppkey, n::int l_linenumber, q::double l_quantity, e::double l_extendedprice from ({rows}) t(k, p, s, n, q, e)"
    assert _differs(spark, tmp_path, "ledger_states", lineitem=sql) == ""


def test_capitals_of_one_character_each(spark, tmp_path):
    # A sharp s more and there are 50 letters; with two letters for it, 50 were there before.
    turns = "select 1::bigint conv_id, turn, repeat('a', 48 + turn // 3) || 'ß' as text from (values (0), (3)) t(turn)"
    assert _differs(spark, tmp_path, "caps_pages", conversations=turns) == ""
    docs = "select d::bigint doc_id, t as text from (values (2, repeat('a', 78) || 'ß'), (4, repeat('a', 79) || 'ß'), (6, repeat('a', 78) || 'ŉ ﬁ')) v(d, t)"
    assert _differs(spark, tmp_path, "capitals_pages", documents=docs) == ""


def test_capitals_of_every_letter(spark):
    from leafmill.functions import text as T

    df = spark.createDataFrame([("straße ﬁn ŉ ᾳ É",), ("plain",), (None,)], "text string")
    assert [r[0] for r in df.select(T.capitals(df["text"])).collect()] == ["STRAẞE ﬁN ŉ ᾼ É", "PLAIN", None]


EVENTS = """select row_number() over ()::bigint event_id, ts::timestamp ts, u::bigint user_id, 'signup' event_type, 1.0::double as value, '' props from
  (select '2024-01-01 23:59:59.7' ts, 1 u union all select '2024-01-02 ' || lpad(h::varchar, 2, '0') || ':10:00.2', u from range(3) a(h), range(1, 3) b(u)
  union all select '2024-01-02 23:59:59.6', u from range(1, 3) b(u) union all select '2024-01-03 ' || lpad(h::varchar, 2, '0') || ':10:00', u from range(2) a(h), range(1, 3) b(u)) x"""


@pytest.mark.parametrize("name", ["stream_windows", "row_groups"])
def test_seconds_before_midnight(spark, tmp_path, name):
    assert _differs(spark, tmp_path, name, events=EVENTS) == ""


def test_blocks_in_tiles_against_all_pairs(spark, monkeypatch):
    """Blocks that stood on one baseline met in rows, all pairs of them; here tiles of five, baselines within tol, and names of null."""
    import random

    from leafmill.operators import rows as R

    monkeypatch.setattr(R, "TILE", 5)
    r = random.Random(3)
    at = {(p, f"b{k}"): sorted({r.randrange(14) + r.choice([0.0, 0.25, 0.5]) for _ in range(r.randrange(2, 9))}) for p in (1, 2) for k in range(23)}
    lines = [(p, b, y, 3) for (p, b), ys in at.items() for y in ys] + [(None, "b1", 1.0, 3), (1, None, 1.0, 3), (1, "b1", None, 3)]
    on = lambda a, b: sum(any(abs(y - z) <= 0.5 for z in b) for y in a)
    want = set()
    for (p, a), ys in at.items():
        for (q, b), zs in at.items():
            there, back = on(ys, zs), on(zs, ys)
            if p == q and a < b and min(there, back, len(ys), len(zs)) >= 3 and there >= 0.6 * len(ys) - 1e-9 and back >= 0.6 * len(zs) - 1e-9:
                want.add((p, a, b, there))
    found = R.row_read_pairs(spark.createDataFrame(lines, "page long, block string, baseline double, n_words int"))
    assert want and {tuple(x) for x in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert R.row_read_pairs(spark.createDataFrame([], "page long, block string, baseline double, n_words int")).count() == 0
