"""Session construction with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "leafmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Get or create a session; on a cluster leave master to spark-submit.

    AQE does the runtime work (coalescing, skew splits), so the shuffle partition count only has to be an upper bound.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    return b.getOrCreate()
