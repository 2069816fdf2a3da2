"""Cutting lineage with written tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A local temporary folder stands in only on a single machine where nothing is set,
    as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="flowtide-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once as Parquet, with ``options`` of the writer, and read it back.

    Later branches reuse the result instead of recomputing it, an executor loss costs
    nothing before this point, and the optimizer sees the true size of the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CODEC = "spark.sql.parquet.compression.codec"


@contextmanager
def codec(spark: SparkSession, name: str) -> Iterator[None]:
    """Parquet that is written inside is compressed this way."""
    before = spark.conf.get(_CODEC)
    spark.conf.set(_CODEC, name)
    try:
        yield
    finally:
        spark.conf.set(_CODEC, before)


def materialise_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialise`` that also returns aggregates observed while writing: no second job."""
    seen = Observation()
    table = materialise(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return table, seen.get


def stored_bytes(table: DataFrame) -> int:
    """Size of a written table as the optimizer sees it: file sizes, no job."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
