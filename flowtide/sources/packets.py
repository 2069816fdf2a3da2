"""Bidirectional flows from a packet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FLOW_TIMEOUT_SECONDS = 120
# Packets are put in order inside cells of this width only.
CELL_SECONDS = 1.0
FLAGS = ("syn", "rst", "ack", "fin", "psh")
SUMS = ("n", "pkts_a", "pkts_b", "bytes_a", "bytes_b", "len_sq", *[f"{f}_count" for f in FLAGS])
CONVERSATION = ["ip_a", "ip_b", "port_a", "port_b", "protocol"]


def by_conversation(packets: DataFrame) -> DataFrame:
    """Add the direction-free 5-tuple: end ``a`` is the smaller of the two endpoints."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("bigint").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").cast("bigint").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return packets.select(
        low["ip"].alias("ip_a"),
        high["ip"].alias("ip_b"),
        low["port"].alias("port_a"),
        high["port"].alias("port_b"),
        F.col("protocol").cast("int").alias("protocol"),
        (src == low).alias("from_a"),
        "ts",
        F.unix_micros("ts").alias("us"),
        F.col("length").cast("double").alias("length"),
        *[F.col(flag).cast("int").alias(flag) for flag in FLAGS],
    )


def packet_measures() -> list[Column]:
    """Mergeable measures of a set of packets, forward and backward kept apart by end."""
    a, b = F.col("from_a"), ~F.col("from_a")
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))
    return [
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        # At equal times the packet sent by end a counts as the first.
        F.max(F.struct((-F.col("us")).alias("back"), F.col("from_a").cast("int").alias("a")))["a"].alias("a_first"),
        F.count(F.lit(1)).alias("n"),
        total(a, F.lit(1.0)).alias("pkts_a"),
        total(b, F.lit(1.0)).alias("pkts_b"),
        total(a, F.col("length")).alias("bytes_a"),
        total(b, F.col("length")).alias("bytes_b"),
        F.sum(F.col("length") * F.col("length")).alias("len_sq"),
        *[F.sum(F.col(f).cast("double")).alias(f"{f}_count") for f in FLAGS],
    ]


def squared(gap: Column) -> Column:
    """The square of a gap in microseconds, exact: sums of it don't depend on their order."""
    whole = gap.cast("decimal(18,0)")
    return whole * whole


def no_gaps() -> Column:
    return F.lit(0).cast("decimal(38,0)")


def merged_measures() -> list[Column]:
    """Measures of neighbouring cells as one; ``bridge_sq`` is the squared gap to the cell before."""
    return [
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min_by("a_first", "first_us").alias("a_first"),
        *[F.sum(c).alias(c) for c in SUMS],
        (F.sum("gap_sq") + F.coalesce(F.sum("bridge_sq"), no_gaps())).cast("decimal(38,0)").alias("gap_sq"),
    ]


def packet_cells(packets: DataFrame, width_us: int) -> DataFrame:
    """Measures of the packets of one 5-tuple in one time cell, squared gaps between them included."""
    in_cell = Window.partitionBy(*CONVERSATION, "cell").orderBy("us")
    rows = by_conversation(packets).withColumn("cell", F.floor(F.col("us") / width_us).cast("bigint"))
    gap = squared(F.col("us") - F.lag("us").over(in_cell))
    return rows.withColumn("gap_sq", gap).groupBy(*CONVERSATION, "cell").agg(
        *packet_measures(), F.coalesce(F.sum("gap_sq"), no_gaps()).cast("decimal(38,0)").alias("gap_sq")
    )


def as_flows(sessions: DataFrame, source_file: str = "packets", label: str = "BENIGN") -> DataFrame:
    """Session measures -> flow records; forward is the direction of the first packet.

    ``flow_duration`` and inter-arrival times are in microseconds; their spread is that of all gaps of
    the flow (population), as for packet lengths.  Initial window sizes are not in a packet table
    and take their default 0.
    """
    forward_a = F.col("a_first") == 1
    seconds = (F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    length = F.col("bytes_a") + F.col("bytes_b")
    mean = length / F.col("n")
    pick = lambda x, y: F.when(forward_a, F.col(x)).otherwise(F.col(y))
    # One packet has no rate: as in a capture, such cells are null.
    rate = lambda v: F.when(seconds > 0, v / seconds)
    zero = F.lit(0.0)
    gaps, span = (F.col("n") - 1).cast("decimal(12,0)"), squared(F.col("last_us") - F.col("first_us"))
    # n * sum of squares - square of the sum, in whole numbers: nothing cancels before the root.
    spread = F.greatest((gaps * F.col("gap_sq") - span).cast("double"), zero)
    return sessions.select(
        pick("ip_a", "ip_b").alias("src_ip"),
        pick("ip_b", "ip_a").alias("dst_ip"),
        pick("port_a", "port_b").alias("src_port"),
        pick("port_b", "port_a").alias("dst_port"),
        "protocol",
        F.timestamp_micros("first_us").alias("timestamp"),
        (F.col("last_us") - F.col("first_us")).cast("double").alias("flow_duration"),
        pick("pkts_a", "pkts_b").alias("fwd_pkts"),
        pick("pkts_b", "pkts_a").alias("bwd_pkts"),
        pick("bytes_a", "bytes_b").alias("fwd_bytes"),
        pick("bytes_b", "bytes_a").alias("bwd_bytes"),
        rate(length).alias("flow_bytes_s"),
        rate(F.col("n").cast("double")).alias("flow_pkts_s"),
        F.when(F.col("n") > 1, (F.col("last_us") - F.col("first_us")) / (F.col("n") - 1))
        .otherwise(zero)
        .alias("flow_iat_mean"),
        F.when(F.col("n") > 1, F.sqrt(spread) / (F.col("n") - 1)).otherwise(zero).alias("flow_iat_std"),
        mean.alias("pkt_len_mean"),
        F.sqrt(F.greatest(F.col("len_sq") / F.col("n") - mean * mean, zero)).alias("pkt_len_std"),
        zero.alias("init_win_fwd"),
        zero.alias("init_win_bwd"),
        *[f"{f}_count" for f in FLAGS],
        F.lit(label).alias("label"),
        F.lit(source_file).alias("source_file"),
    )


def packets_to_flows(packets: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS, cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """Group packets of a 5-tuple into flows split where it is idle past the timeout.

    Packets are put in order inside narrow time cells, so a 5-tuple that owns a third of all packets is as many
    tasks' work as it has cells.  A cell keeps first, last, sums and squared gaps; cells merge by adding the
    squared gap between them.  They merge first inside spans as long as the timeout, where no gap
    ends a flow, then along the whole 5-tuple, which has no more spans than the capture has timeouts.
    """
    timeout_us = timeout_seconds * 1_000_000
    cells = packet_cells(packets, int(min(cell_seconds, timeout_seconds) * 1_000_000))
    span = [*CONVERSATION, "span"]
    in_span = Window.partitionBy(*span).orderBy("first_us")
    spans = (
        cells.withColumn("span", F.floor(F.col("first_us") / timeout_us).cast("bigint"))
        .withColumn("bridge_sq", squared(F.col("first_us") - F.lag("last_us").over(in_span)))
        .groupBy(*span)
        .agg(*merged_measures())
    )
    in_time = Window.partitionBy(*CONVERSATION).orderBy("first_us")
    idle = F.col("first_us") - F.lag("last_us").over(in_time)
    sessions = (
        spans.withColumn("idle", idle)
        .withColumn("starts", F.when(F.col("idle") <= timeout_us, 0).otherwise(1))
        .withColumn("bridge_sq", F.when(F.col("starts") == 0, squared(F.col("idle"))))
        .withColumn("session", F.sum("starts").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*CONVERSATION, "session")
        .agg(*merged_measures())
    )
    return as_flows(sessions)
