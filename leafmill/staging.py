"""Intermediate tables in the folder that driver and executors share.

``materialize`` cuts lineage by writing a Parquet table under ``spark.checkpoint.dir``, so a lost executor costs a re-read
and not a recomputation.  Tables that a later step replaces are given back with ``release``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; an own one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        own = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
    else:
        own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"
        if own.startswith("file:") or "://" not in own:  # a folder of each machine's own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", own) if spark.conf.isModifiable("spark.checkpoint.dir") else _OWN.setdefault(spark.sparkContext.applicationId, own)
    return _OWN.get(spark.sparkContext.applicationId, own)


_OWN: dict[str, str] = {}


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once into the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by materialize that nothing reads any more."""
    path = getattr(df, "_leafmill_path", None)
    if path:
        p, fs = _hadoop(df.sparkSession, path)
        fs.delete(p, True)
