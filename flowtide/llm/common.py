"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space as the operators understand words; fixed values.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where the driver has it.

    On a cluster the package is installed on the executors or sent with ``--py-files``.
    """
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        root = str(Path(__file__).resolve().parents[2])
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """Only the named columns, as ``doc_id``, ``text`` (null becomes empty) and ``more``.

    Whatever else the table has, also under names the operators use inside, is left out here.
    """
    importable(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in more.items()],
    )


#: Rows to an Arrow batch of whole texts: a task holds a few batches on either side, beside what it makes of them.
TEXT_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is written inside sends its rows to Python in Arrow batches of at most ``rows``."""
    before = spark.conf.get(_BATCH_ROWS)
    if not 0 < int(before) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The runs of characters that are not ASCII white space, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` starts with one, whatever its case."""
    taken = [c.lower() for c in df.columns]
    found = []
    for name in names:
        while any(c.startswith(name.lower()) for c in taken):
            name = f"_{name}"
        found.append(name)
    return found
