"""Command line: ``python -m leafmill run | batch | stages | inspect``.

``run`` puts one table through a profile and keeps every boundary, ``batch`` puts a folder of page images through it and writes a
summary (exit code 2 if a page failed), ``stages`` lists what is registered, ``inspect`` shows a kept run's manifest.  Modules named
with ``--use`` are imported first, so that they can register their stages.
"""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans import profile, runner, stages
from leafmill.session import build_session
from leafmill.sources import files, images


def page_table(spark: SparkSession, inputs: list[str], recursive: bool = False) -> DataFrame:
    """(page, path, height, width, dpi, grey, error): a row for each image file under the inputs, one that no reader knows included."""
    listed = files.jobs(files.listing(spark, inputs, recursive)).filter(files.ending(F.col("path")) != "pdf").select("path", F.col("name").alias("page"))
    paths = [f"{i.rstrip('/')}/*" if "." not in i.rsplit("/", 1)[-1] else i for i in inputs]
    px = images.read_images(spark, paths)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    both = listed.withColumn("_p", plain).join(px.select(plain.alias("_p"), "height", "width", "dpi", "grey"), "_p", "left").drop("_p")
    return both.withColumn("error", F.when(F.col("grey").isNull(), "the file cannot be read as an image"))


def _steps(a: argparse.Namespace):
    for name in a.use:
        importlib.import_module(name)
    return profile.load(a.profile, a.set)


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    steps = _steps(a)
    _, manifest = runner.run_kept(spark.read.parquet(a.input), steps, a.out)
    manifest.orderBy("step").select("step", "slot", "impl", "n_rows", F.round("seconds", 3).alias("seconds")).show(truncate=False)
    return 0


def _batch(spark: SparkSession, a: argparse.Namespace) -> int:
    steps, began = _steps(a), time.perf_counter()
    pages = page_table(spark, a.inputs, a.recursive)
    good, bad = pages.filter("error is null"), pages.filter("error is not null")
    done = runner.run(good, steps)
    out = done.unionByName(bad, allowMissingColumns=True)
    if "error" not in done.columns:
        out = out.withColumn("error", F.col("error"))
    out.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/pages")
    kept = spark.read.parquet(f"{a.out.rstrip('/')}/pages")
    for c in ("seconds", "p_correct"):
        if c not in kept.columns:
            kept = kept.withColumn(c, F.lit(None).cast("double"))
    summary = files.batch_summary(kept, time.perf_counter() - began)
    summary.write.mode("overwrite").json(f"{a.out.rstrip('/')}/batch")
    row = summary.first()
    print(json.dumps(row.asDict()))
    return 2 if row["failed"] else 0


def _stages(spark: SparkSession, a: argparse.Namespace) -> int:
    for name in a.use:
        importlib.import_module(name)
    stages.listing(spark).orderBy("slot", "impl").show(1000, truncate=False)
    return 0


def _inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    spark.read.schema(runner.METRICS).json(f"{a.run.rstrip('/')}/manifest").orderBy("step").show(1000, truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__.split("\n")[0])
    p.add_argument("--use", action="append", default=[], metavar="MODULE")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in (("run", _run), ("batch", _batch)):
        c = sub.add_parser(name)
        c.add_argument("profile")
        if name == "run":
            c.add_argument("input")
        else:
            c.add_argument("inputs", nargs="+")
            c.add_argument("--recursive", action="store_true")
        c.add_argument("--out", required=True)
        c.add_argument("--set", action="append", default=[], metavar="SLOT.KEY=VALUE")
        c.set_defaults(f=f)
    sub.add_parser("stages").set_defaults(f=_stages)
    c = sub.add_parser("inspect")
    c.add_argument("run")
    c.set_defaults(f=_inspect)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.f(build_session("leafmill"), a)
