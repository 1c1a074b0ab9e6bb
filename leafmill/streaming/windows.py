"""Windowed counts over a stream; the same function serves a finished table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.staging import shared_dir


def windowed(df: DataFrame, at: str, *keys: str, width: str = "1 day", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """(starts, keys, n[, total]) by tumbling windows; on a stream, rows later than ``late`` are left to the watermark."""
    df = df.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(at, late)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    g = df.groupBy(F.window(at, width), *keys).agg(*aggs)
    return g.select(F.col("window.start").alias("starts"), *keys, *g.columns[1 + len(keys) :])


def sessions(df: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, starts, ends, n): rows of a key that follow one another within ``gap``; ends is the last row's time plus the gap."""
    df = df.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(at, late)
    g = df.groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), "n")


def drain(stream: DataFrame, name: str = "drained") -> DataFrame:
    """Run a stateful stream over all that its source holds now and return the rows of its last state."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
