"""Row positions inside groups, also for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise, materialise_with

# A window task sorts at most this many rows of one group.
HOT_ROWS = 2_000_000


@dataclass
class GroupSizes:
    """Rows per group in column ``n`` of a written table, and the largest of them."""

    table: DataFrame
    largest: int


def written_sizes(counts: DataFrame) -> GroupSizes:
    table, facts = materialise_with(counts, "sizes", largest=F.max("n"))
    return GroupSizes(table, facts["largest"] or 0)


def group_sizes(df: DataFrame, group: Sequence[str]) -> GroupSizes:
    return written_sizes(df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str,
    sizes: GroupSizes | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the 0-based position of a row in its group, by ``order``.

    Ordinary groups use ``row_number``.  Groups above ``hot_rows`` are range-sorted over
    all tasks instead; a row's position is then its place in its partition plus the rows
    of its group in the partitions before.  Rows equal under ``order`` are spread too.
    """
    cold, hot = split_hot(df, group, sizes or group_sizes(df, group), hot_rows)
    ranked = numbered_by_window(cold, group, order, out)
    return ranked if hot is None else ranked.unionByName(numbered_by_range(hot, group, order, out))


def split_hot(df: DataFrame, group: Sequence[str], sizes: GroupSizes, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups up to ``hot_rows``, and those of larger groups if there are any."""
    if sizes.largest <= hot_rows:
        return df, None
    # At most rows / hot_rows groups.
    hot = materialise(sizes.table.where(F.col("n") > hot_rows).select(*group), "hot_groups")
    return join_lookup(df, hot, group, df.columns, "left_anti"), join_lookup(df, hot, group, df.columns, "left_semi")


def numbered_by_window(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, position.cast("bigint") - 1)


def numbered_by_range(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    # Written first: row ids of a table on disk do not change when a task is retried, so
    # they can break ties, and the sampling pass of the range shuffle reads no lineage.
    base = materialise(df, "hot").withColumn("_tie", F.monotonically_increasing_id())
    keys = [*[F.col(g) for g in group], *order, F.col("_tie")]
    ranged = materialise(
        base.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
        .drop("_tie"),
        "ranged",
    )
    heads = ranged.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per group and range partition: small, and bounded by the partition count.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        heads.select(
            *group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
        ),
        "offsets",
    )
    placed = join_lookup(ranged, offsets, [*group, "_part"], ["_pos"])
    return placed.withColumn(out, F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift")
