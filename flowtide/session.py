"""Session settings the library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


# The JVM never compiles methods above 8,000 bytes of bytecode.  Wide projections, such as the
# one from capture text to flow records, exceed that when fused into one method and then run
# interpreted; below this limit Spark splits them instead, which is about three times faster.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for a session somebody else has built."""
    spark.conf.set(*HUGE_METHOD)
    return spark


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution with skew splitting, UTC, and partial merges left on.

    Shuffle partitions start high and are coalesced at run time, so one setting serves
    small and large inputs.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        HUGE_METHOD[0]: HUGE_METHOD[1],
        # No Python stack walk for every column expression: plans of wide tables build faster.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.dataFrameQueryContext.enabled": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def local_session(name: str, cores: int | None = None, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    cores = cores or os.cpu_count() or 8
    spark = (
        configure(SparkSession.builder.master(f"local[{cores}]").appName(name))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
