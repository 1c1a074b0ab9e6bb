"""A read service over a landing folder: files that arrive are read as pages, and every one is answered by a row.

An answer has a state like a web server's: 200 with the result, 400 for what is no page, 413 for what is too large, 500 where the
reading failed.  Answers go to a table, a batch at a time; a batch that runs again after a crash replaces its own answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Largest file that is read.
MOST_BYTES = 64 << 20

#: Beginnings of files that hold pages, in hex: PNG, JPEG, TIFF twice, BMP, PDF.
HEADS = ["89504e470d0a1a0a", "ffd8ff", "49492a00", "4d4d002a", "424d", "255044462d"]


def judged(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files (path, length, content) with ``state``: 413, 400 or null for what can be read."""
    head = F.lower(F.hex(F.substring("content", 1, 8)))
    known = F.lit(False)
    for h in HEADS:
        known |= head.startswith(h)
    return files.withColumn("state", F.when(F.col("length") > most, 413).when(~F.coalesce(known, F.lit(False)), 400))


def answers(files: DataFrame, read: Callable[[DataFrame], DataFrame], most: int = MOST_BYTES) -> DataFrame:
    """(path, state, result): read turns (path, content) into (path, result, error), in which a failed page has an error."""
    j = judged(files, most)
    done = read(j.filter("state is null").select("path", "content")).select("path", F.when(F.col("error").isNull(), 200).otherwise(500).alias("state"), F.coalesce("error", "result").alias("result"))
    words = F.when(F.col("state") == 413, "the file is too large").otherwise("the file holds no page")
    return j.filter("state is not null").select("path", "state", words.alias("result")).unionByName(done)


def serve(spark: SparkSession, inbox: str, outbox: str, read: Callable[[DataFrame], DataFrame], checkpoint: str, most: int = MOST_BYTES, once: bool = False) -> StreamingQuery:
    """Answers every file of the inbox in ``outbox`` (a table by batch), until stopped, or with once what is there now."""

    def batch(files: DataFrame, number: int) -> None:
        answers(files, read, most).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{outbox.rstrip('/')}/batch={number:08d}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 1000).load(inbox)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
