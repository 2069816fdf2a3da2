"""Tumbling windows per capture and everything aggregated straight from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.labels import category_index, label_category, severity_category, severity_rank
from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise
from flowtide.schema import WINDOW_FEATURES, WINDOW_KEY

WINDOW_SECONDS = 30


def window_index(flows: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``origin_us`` (first flow of the capture) and ``window_idx``.

    Two passes: a per-capture minimum over two columns, then a lookup join.  Whole seconds
    are taken of the difference to the origin.  Flows without a timestamp are left out.
    """
    timed = flows.where(F.col("timestamp").isNotNull())
    origins = materialise(
        timed.groupBy("source_file").agg(F.min(F.unix_micros("timestamp")).alias("origin_us")), "origins"
    )
    joined = join_lookup(timed, origins, ["source_file"], ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port"])
    return joined.withColumn("window_idx", F.expr(f"(unix_micros(timestamp) - origin_us) div {seconds * 1_000_000}"))


def window_start(seconds: int = WINDOW_SECONDS) -> Column:
    return F.timestamp_micros(F.col("origin_us") + F.col("window_idx") * F.lit(seconds * 1_000_000))


def window_end(seconds: int = WINDOW_SECONDS) -> Column:
    return F.timestamp_micros(F.col("origin_us") + (F.col("window_idx") + 1) * F.lit(seconds * 1_000_000))


def window_bounds(indexed: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Half-open bounds of each non-empty window."""
    return indexed.select(*WINDOW_KEY, "origin_us").distinct().select(
        *WINDOW_KEY, window_start(seconds).alias("start_time"), window_end(seconds).alias("end_time")
    )


def window_label_counts(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy(*WINDOW_KEY, "label").agg(F.count(F.lit(1)).alias("n"))


def window_target(indexed: DataFrame) -> DataFrame:
    """Most severe class present in each window and its index."""
    rank = F.min(severity_rank(label_category(F.col("label"))))
    return _with_target(indexed.groupBy(*WINDOW_KEY).agg(rank.alias("severity")))


def _with_target(df: DataFrame) -> DataFrame:
    category = severity_category(F.col("severity"))
    return df.withColumn("target_category", category).withColumn(
        "target_index", category_index(F.col("target_category"))
    ).drop("severity")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def window_stats(pairs: DataFrame) -> DataFrame:
    """The eight window statistics, from the per-pair totals of ``pair_totals``.

    Flows were already reduced to one row per (window, source, destination), so a window
    with a third of all flows costs only its distinct pairs here, and the distinct counts
    run on that smaller table.
    """
    sums = pairs.groupBy(*WINDOW_KEY).agg(
        F.min("origin_us").alias("origin_us"),
        F.sum("flow_count").alias("flow_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.sum("total_pkts").alias("total_pkts"),
        F.sum("syn_count").alias("syn"),
        F.sum("rst_count").alias("rst"),
        F.sum("duration_sum").alias("duration_sum"),
        F.sum("duration_n").alias("duration_n"),
        F.min("severity").alias("severity"),
        F.count_distinct("src_ip").alias("n_unique_src"),
        F.count_distinct("dst_ip").alias("n_unique_dst"),
    )
    return _with_ratios(sums)


def flow_window_stats(indexed: DataFrame) -> DataFrame:
    """``window_stats`` straight from flows, for those who need no pairs.

    Ports and pairs, which are nearly as many as flows where hosts talk once, are neither
    grouped nor sorted: tasks combine flows to one row per window, per host that sends and
    per host that receives, and only those rows are shuffled.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = indexed.groupBy(*WINDOW_KEY).agg(
        F.min("origin_us").alias("origin_us"),
        F.count(F.lit(1)).alias("flow_count"),
        (total("fwd_bytes") + total("bwd_bytes")).alias("total_bytes"),
        (total("fwd_pkts") + total("bwd_pkts")).alias("total_pkts"),
        total("syn_count").alias("syn"),
        total("rst_count").alias("rst"),
        total("flow_duration").alias("duration_sum"),
        F.count("flow_duration").alias("duration_n"),
        F.min(severity_rank(label_category(F.col("label")))).alias("severity"),
        F.count_distinct("src_ip").alias("n_unique_src"),
        F.count_distinct("dst_ip").alias("n_unique_dst"),
    )
    return _with_ratios(sums)


def _with_ratios(sums: DataFrame) -> DataFrame:
    return (
        sums.withColumn("syn_ratio", _ratio("syn", "total_pkts"))
        .withColumn("rst_ratio", _ratio("rst", "total_pkts"))
        .withColumn("mean_duration", _ratio("duration_sum", "duration_n"))
        .drop("syn", "rst", "duration_sum", "duration_n")
    )


def build_windows(pairs: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Window table: key, bounds, the eight statistics, target class."""
    return _window_rows(window_stats(pairs), seconds)


def build_flow_windows(indexed: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same table from flows with their ``window_index``."""
    return _window_rows(flow_window_stats(indexed), seconds)


def _window_rows(stats: DataFrame, seconds: int) -> DataFrame:
    return _with_target(stats).select(
        *WINDOW_KEY,
        window_start(seconds).alias("start_time"),
        window_end(seconds).alias("end_time"),
        *WINDOW_FEATURES,
        "target_category",
        "target_index",
    )
