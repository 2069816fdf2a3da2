"""Streaming twins of the window statistics and of packet sessions.

Both are two stateful operators in a row, in append mode: what the watermark has closed is emitted once and leaves the
state.  They work on batch tables as well, where everything is closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.labels import category_index, label_category, severity_category, severity_rank
from flowtide.plans.materialise import scratch_path
from flowtide.sources.packets import (
    CONVERSATION,
    FLOW_TIMEOUT_SECONDS,
    SUMS,
    as_flows,
    by_conversation,
    no_gaps,
    packet_measures,
    squared,
)

STREAM_CELL_SECONDS = 10


def stream_window_stats(
    flows: DataFrame, seconds: int = 30, lateness: str = "10 minutes", start: str = "0 seconds"
) -> DataFrame:
    """The eight window statistics and the target over a flow stream, per capture.

    Windows are aligned to the epoch plus ``start`` because the first flow of a capture is
    not known ahead.  A flow counts once for its source, with all its measures, and once for its destination; the first
    operator keeps one row per window, side and host, so hosts are distinct and a busy window is spread by
    host; the second adds up the hosts of a window.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    none = F.lit(None).cast("double")
    measures = {
        "bytes_fwd": F.col("fwd_bytes"), "bytes_bwd": F.col("bwd_bytes"), "pkts_fwd": F.col("fwd_pkts"), "pkts_bwd": F.col("bwd_pkts"),
        "syn": F.col("syn_count"), "rst": F.col("rst_count"), "duration": F.col("flow_duration"),
    }
    source = F.struct(
        F.lit(True).alias("is_src"), F.col("src_ip").alias("ip"), *[c.alias(k) for k, c in measures.items()], severity_rank(label_category(F.col("label"))).alias("severity")
    )
    target = F.struct(F.lit(False).alias("is_src"), F.col("dst_ip").alias("ip"), *[none.alias(k) for k in measures], F.lit(None).cast("int").alias("severity"))
    span = F.window("timestamp", f"{seconds} seconds", startTime=start).alias("span")
    hosts = (
        flows.withWatermark("timestamp", lateness)
        .select("source_file", "timestamp", F.inline(F.array(source, target)))
        .groupBy("source_file", span, "is_src", "ip")
        .agg(
            F.count(F.when(F.col("is_src"), 1)).alias("flow_count"),
            *[F.sum(k).alias(k) for k in measures],
            F.count("duration").alias("timed"),
            F.min("severity").alias("severity"),
        )
    )
    host = lambda side: F.count(F.when((F.col("is_src") == side) & F.col("ip").isNotNull(), 1))
    stats = hosts.groupBy("source_file", "span").agg(
        F.sum("flow_count").alias("flow_count"),
        (zero(F.sum("bytes_fwd")) + zero(F.sum("bytes_bwd"))).alias("total_bytes"),
        (zero(F.sum("pkts_fwd")) + zero(F.sum("pkts_bwd"))).alias("total_pkts"),
        F.sum("syn").alias("syn"),
        F.sum("rst").alias("rst"),
        F.when(F.sum("timed") > 0, F.sum("duration") / F.sum("timed")).otherwise(0.0).alias("mean_duration"),
        host(True).alias("n_unique_src"),
        host(False).alias("n_unique_dst"),
        F.min("severity").alias("severity"),
    )
    ratio = lambda c: F.when(F.col("total_pkts") > 0, F.col(c) / F.col("total_pkts")).otherwise(0.0)
    return stats.select(
        "source_file",
        F.col("span.start").alias("start_time"),
        F.col("span.end").alias("end_time"),
        "flow_count",
        "total_bytes",
        "total_pkts",
        ratio("syn").alias("syn_ratio"),
        ratio("rst").alias("rst_ratio"),
        "mean_duration",
        "n_unique_src",
        "n_unique_dst",
        severity_category(F.col("severity")).alias("target_category"),
        category_index(severity_category(F.col("severity"))).alias("target_index"),
    )


def session_gap(timeout_seconds: int, cell_seconds: int) -> float:
    """Cells further apart than this hold no two packets of one flow; never a whole number of cells when the timeout is one."""
    return timeout_seconds + 1.5 * cell_seconds


def stream_packets_to_flows(
    packets: DataFrame,
    timeout_seconds: int = FLOW_TIMEOUT_SECONDS,
    lateness: str = "10 minutes",
    cell_seconds: int = STREAM_CELL_SECONDS,
) -> DataFrame:
    """Flows over a packet stream, split where a 5-tuple is idle past the timeout, as ``packets_to_flows`` does.

    The first operator sums packets per 5-tuple and time cell, so a busy 5-tuple is spread by cells, and its packets are
    added up before they are shuffled.  The second is a session window over closed cells, wide enough never to
    part a flow; it keeps one small struct per cell.  What it emits is cut at the idle times.  A flow appears, once,
    when the watermark has passed its last cell by ``session_gap``.
    """
    cells = (
        by_conversation(packets.withWatermark("ts", lateness))
        .groupBy(*CONVERSATION, F.window("ts", f"{cell_seconds} seconds").alias("cell"))
        .agg(*packet_measures(), F.array_sort(F.collect_list("us")).alias("times"))
    )
    steps = F.size("times") - 1
    squares = F.zip_with(F.slice("times", F.lit(2), steps), F.slice("times", F.lit(1), steps), lambda x, y: squared(x - y))
    gap_sq = F.aggregate(squares, no_gaps(), lambda total, x: (total + x).cast("decimal(38,0)"))
    fields = ["first_us", "last_us", "a_first", *SUMS, "gap_sq"]
    gap = session_gap(timeout_seconds, cell_seconds)
    near = (
        cells.withColumn("gap_sq", gap_sq)
        .withColumn("closed", F.window_time("cell"))
        .groupBy(*CONVERSATION, F.session_window("closed", f"{int(gap * 1000)} milliseconds").alias("session"))
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cells"))
    )
    flows = near.select(*CONVERSATION, F.inline(_cut_where_idle(F.col("cells"), fields, timeout_seconds * 1_000_000)))
    return as_flows(flows)


def _cut_where_idle(cells: Column, fields: list[str], timeout_us: int) -> Column:
    """Cells in time order -> one struct per flow."""

    def one(flow: Column, cell: Column) -> Column:
        together = {
            "first_us": flow["first_us"],
            "last_us": cell["last_us"],
            "a_first": flow["a_first"],
            **{c: flow[c] + cell[c] for c in SUMS},
            "gap_sq": (flow["gap_sq"] + cell["gap_sq"] + squared(cell["first_us"] - flow["last_us"])).cast("decimal(38,0)"),
        }
        return F.struct(*[together[c].alias(c) for c in fields])

    def step(done: Column, cell: Column) -> Column:
        last = F.element_at(done, -1)
        goes_on = cell["first_us"] - last["last_us"] <= timeout_us
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one(last, cell)))).otherwise(F.concat(done, F.array(cell)))

    rest = F.slice(cells, F.lit(2), F.size(cells))
    return F.aggregate(rest, F.slice(cells, F.lit(1), F.lit(1)), step)


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read back the written result: what the watermark closed."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure replaces what it wrote.
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", path).parquet(path).select(*stream.columns)
