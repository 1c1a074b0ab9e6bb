"""Runs a profile over a table, as one lineage or with every boundary kept."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.profile import Step
from leafmill.plans.stages import find

METRICS = "run string, step int, slot string, impl string, params string, path string, seconds double, n_rows long, error string"


def run(df: DataFrame, steps: list[Step]) -> DataFrame:
    """All steps as one plan for Catalyst; nothing runs yet."""
    for bound in [find(s.slot, s.impl).bind(s.params) for s in steps]:
        df = bound(df)
    return df


def run_kept(df: DataFrame, steps: list[Step], folder: str, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(result, manifest): each step is written under folder and read again, so that runs can be compared or resumed.

    The manifest (``METRICS``) has a row a step; rows are counted while they are written.  A step that fails is recorded with its
    error before the error is raised again, and the steps before it stay.
    """
    spark, rows, folder = df.sparkSession, [], folder.rstrip("/")
    name = run_id or uuid.uuid4().hex
    bound = [find(s.slot, s.impl).bind(s.params) for s in steps]  # names and parameters fail before anything runs
    for i, (s, f) in enumerate(zip(steps, bound, strict=True)):
        path, began, seen = f"{folder}/{i:02d}_{s.slot}.{s.impl}", time.perf_counter(), Observation(f"step{i}")
        row = (name, i, s.slot, s.impl, json.dumps(s.params, sort_keys=True, default=str), path)
        try:
            f(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        except Exception as e:
            rows.append((*row, time.perf_counter() - began, None, f"{type(e).__name__}: {e}"[:2000]))
            spark.createDataFrame(rows, METRICS).write.mode("overwrite").json(f"{folder}/manifest")
            raise
        df = spark.read.parquet(path)
        rows.append((*row, time.perf_counter() - began, seen.get["n"], None))
    manifest = spark.createDataFrame(rows, METRICS)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return df, manifest


def rerun_from(k: int, steps: list[Step], folder: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps k and later anew, from the kept boundary before k (k = 0: from df); the manifest counts from 0 at step k."""
    if k:
        s = steps[k - 1]
        df = df.sparkSession.read.parquet(f"{folder.rstrip('/')}/{k - 1:02d}_{s.slot}.{s.impl}")
    return run_kept(df, steps[k:], f"{folder.rstrip('/')}/from{k:02d}")


def profile_report(spark: SparkSession, *folders: str) -> DataFrame:
    """(slot, impl, runs, failed, mean_seconds, mean_rows) over the manifests of kept runs, slowest first."""
    m = spark.read.schema(METRICS).json([f"{f.rstrip('/')}/manifest" for f in folders])
    per = m.groupBy("slot", "impl").agg(F.count("*").alias("runs"), F.count("error").alias("failed"), F.avg("seconds").alias("mean_seconds"), F.avg("n_rows").alias("mean_rows"))
    return per.orderBy(F.desc("mean_seconds"))


class Session:
    """Work on one table, step by step: every boundary is kept, and a change of step k makes k and the later ones stale.

    ``refresh`` runs what is stale.  Each change starts a new generation; a run notices between two steps that it has been overtaken,
    and its running jobs, which carry the generation's tag, are interrupted.
    """

    def __init__(self, df: DataFrame, steps: list[Step], folder: str) -> None:
        self.df, self.steps, self.folder = df, list(steps), folder.rstrip("/")
        self.generation, self.fresh, self.kept = 0, 0, [None] * len(steps)

    def change(self, k: int, impl: str | None = None, **params) -> None:
        """Another implementation or other parameters for step k."""
        old = self.steps[k]
        new = Step(old.slot, impl or old.impl, {**({} if impl and impl != old.impl else old.params), **params})
        find(new.slot, new.impl).bind(new.params)  # fails before anything is given up
        self._overtake()
        self.steps[k] = new
        self.fresh = min(self.fresh, k)

    def _overtake(self) -> None:
        self.df.sparkSession.interruptTag(self._tag())
        self.generation += 1

    def _tag(self) -> str:
        return f"session-{id(self)}-{self.generation}"

    def refresh(self) -> DataFrame:
        """The last boundary, after the stale steps have run."""
        spark, own = self.df.sparkSession, self.generation
        tag = self._tag()
        spark.addTag(tag)
        try:
            while self.fresh < len(self.steps):
                k, s = self.fresh, self.steps[self.fresh]
                before = spark.read.parquet(self.kept[k - 1]) if k else self.df
                path = f"{self.folder}/g{own:04d}/{k:02d}_{s.slot}.{s.impl}"
                find(s.slot, s.impl).bind(s.params)(before).write.mode("overwrite").parquet(path)
                if own != self.generation:
                    raise RuntimeError("a later change has overtaken this run")
                self.kept[k], self.fresh = path, k + 1
        finally:
            spark.removeTag(tag)
        return spark.read.parquet(self.kept[-1])

    def toml(self) -> str:
        """The profile of the session's steps."""
        out = ["[pipeline]", f"stages = {json.dumps([s.slot for s in self.steps])}"]
        for s in self.steps:
            out += ["", f"[stage.{s.slot}]", f"impl = {json.dumps(s.impl)}"]
            if s.params:
                out.append("params = {" + ", ".join(f"{k} = {json.dumps(v)}" for k, v in s.params.items()) + "}")
        return "\n".join(out) + "\n"

    def save(self) -> str:
        """JSON from which ``load`` takes the session up again."""
        steps = [[s.slot, s.impl, s.params] for s in self.steps]
        return json.dumps({"steps": steps, "folder": self.folder, "generation": self.generation, "fresh": self.fresh, "kept": self.kept})

    @classmethod
    def load(cls, df: DataFrame, saved: str) -> Session:
        d = json.loads(saved)
        out = cls(df, [Step(*s) for s in d["steps"]], d["folder"])
        out.generation, out.fresh, out.kept = d["generation"] + 1, d["fresh"], d["kept"]
        return out
