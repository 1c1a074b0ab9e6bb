"""Maps and parameters recovered from the tables' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import calibration
from leafmill.queries.catalog import query
from leafmill.queries.ledger import LINES, lines
from leafmill.queries.standard import _r, _t

_A, _B, _C, _D, _E, _F = "1 + k % 7 / 10.0e0", "k % 5 / 50.0e0", "(k % 11)", "- (k % 3) / 40.0e0", "1 - k % 9 / 20.0e0", "(k % 13) - 6"


@query(
    "affine_maps",
    f"""with {LINES}, s as (select k, count(*) n, var_pop(r) * var_pop(q) - covar_pop(r, q) ** 2 det from li group by k)
  select k page, n::bigint n_points, round({_A}, 6) a, round({_B}, 6) b, round({_C}, 6)::double c, round({_D}, 6) d, round({_E}, 6) e, round({_F}, 6)::double f from s where det > 1e-9""",
)
def affine_maps(spark, sf_dir):
    """The map that was laid over each order's points, found again where they do not lie on a line."""
    k = F.col("table")
    p = lines(spark, sf_dir).select(k.alias("page"), F.col("r").cast("double").alias("x"), F.col("q").cast("double").alias("y"))
    k = F.col("page")
    u = (1 + k % 7 / 10) * F.col("x") + k % 5 / 50 * F.col("y") + k % 11
    v = -(k % 3) / 40 * F.col("x") + (1 - k % 9 / 20) * F.col("y") + k % 13 - 6
    found = calibration.affine_maps(p.withColumn("u", u).withColumn("v", v), ["page"])
    return found.select("page", F.col("n").alias("n_points"), *[(_r(c) + 0.0).alias(c) for c in "abcdef"])


_SHIFTS = """h as (select l_suppkey % 8 m, (l_returnflag = 'R')::int seen, l_quantity::double v, count(*) n from lineitem where l_returnflag in ('R', 'N') group by all),
  b as (select m, s, v + s v, n p, 0 q from h, unnest(range(0, 6)) t(s) where seen = 0 union all select m, s, v, 0, n from h, unnest(range(0, 6)) t(s) where seen = 1),
  g as (select m, s, v, sum(p) p, sum(q) q from b group by all),
  c as (select m, s, abs(sum(p) over (partition by m, s order by v) / sum(p) over (partition by m, s) - sum(q) over (partition by m, s order by v) / sum(q) over (partition by m, s)) * (lead(v) over (partition by m, s order by v) - v) part from g),
  d as (select m, s, coalesce(sum(part), 0) distance from c group by all)"""


@query("histogram_distances", f"with {_SHIFTS} select m part_of, s::bigint shift, round(distance, 6) distance from d")
def histogram_distances(spark, sf_dir):
    """How far the quantities of lines not returned, shifted by up to five, are from those returned, in eight parts of the suppliers."""
    tried, seen = _tried(spark, sf_dir)
    at = tried.select("part_of", "shift").distinct()
    return calibration.distances(tried, seen.join(at, "part_of"), ["part_of", "shift"]).select("part_of", "shift", _r("distance").alias("distance"))


@query("nearest_shift", f"with {_SHIFTS} select m part_of, s::bigint shift, round(distance, 6) distance from (select *, row_number() over (partition by m order by round(distance, 9), s) r from d) where r = 1")
def nearest_shift(spark, sf_dir):
    """The shift under which both come nearest."""
    found = calibration.nearest_parameter(*_tried(spark, sf_dir), ["part_of"], "shift")
    return found.select("part_of", "shift", _r("distance").alias("distance"))


def _tried(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("part_of"), "l_returnflag", "l_quantity")
    tried = calibration.histogram(l.filter("l_returnflag = 'N'"), ["part_of"], "l_quantity").withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return tried.withColumn("value", F.col("value") + F.col("shift")), calibration.histogram(l.filter("l_returnflag = 'R'"), ["part_of"], "l_quantity")
