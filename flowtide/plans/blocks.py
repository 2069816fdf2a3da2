"""Sliding frames over one long, globally ordered series without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

BLOCK_ROWS = 10_000


def overlapping_blocks(
    df: DataFrame,
    group: Sequence[str],
    idx: str,
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, WindowSpec]:
    """Cut each group's series (dense index ``idx``) into blocks that overlap.

    A row is copied into the neighbouring block when a frame reaching ``before`` rows
    back or ``after`` rows ahead could need it there, so a window over (group, block)
    sees everything it needs while no task holds more than one block.  Returns the rows
    with ``_home`` (true on the copy whose frame is complete) and the window to use;
    keep only ``_home`` rows after the window function.
    """
    if max(before, after) >= block_rows:
        raise ValueError("block_rows must exceed the frame")
    block = F.floor(F.col(idx) / block_rows).cast("bigint")
    first = F.floor((F.col(idx) - after) / block_rows).cast("bigint")
    last = F.floor((F.col(idx) + before) / block_rows).cast("bigint")
    rows = df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_block") == block)
    return rows, Window.partitionBy(*group, "_block").orderBy(idx)


def keep_home(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_block")
