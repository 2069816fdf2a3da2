"""Audits of raw captures: sizes, bad tokens, time range, labels, topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowtide.functions.labels import profile_label
from flowtide.functions.values import fix_12h_clock, parse_timestamp, strip
from flowtide.plans.materialise import materialise
from flowtide.schema import INFINITY_TOKENS, NAN_TOKENS, NEG_INFINITY_TOKENS
from flowtide.sources.captures import valid_row, valid_rows

RATE_COLUMNS = {"flow_bytes_s": "Flow Bytes/s", "flow_pkts_s": "Flow Packets/s"}


def _count(condition) -> "F.Column":
    return F.count(F.when(condition, 1))


def _zero(name: str) -> "F.Column":
    return F.lit(0).cast("bigint").alias(name)


def profile_columns() -> list[str]:
    """Header names the audits read."""
    return ["Flow ID", "Source IP", "Destination IP", "Timestamp", "Label", *RATE_COLUMNS.values()]


def _with_files(per_file: DataFrame, files: DataFrame | None, counts: list[str]) -> DataFrame:
    """Counts per file with the facts of its header, and the files that have no row, with counts of zero."""
    none = {"raw_columns_count": F.lit(0), "duplicate_columns": F.array().cast("array<string>")}
    if files is None:
        return per_file.withColumns(none)
    facts = files.withColumns({c: v for c, v in none.items() if c not in files.columns})
    listed = facts.select("source_file", "file_path", "file_size", *none, *[_zero(c) for c in counts])
    return per_file.unionByName(listed, allowMissingColumns=True)


def file_profile(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per capture: bytes, columns, repeated headers, raw / valid / padding rows.

    ``files`` (``captures.header_table``) adds what the headers tell and the captures that have no row.
    """
    valid = valid_row(F.col("Flow ID"), F.col("Source IP"), F.col("Timestamp"))
    # A capture may be stored in several files; each counts once.
    per_file = raw.groupBy("source_file", "file_path").agg(
        F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("raw"), _count(valid).alias("valid")
    )
    per_file = _with_files(per_file, files, ["raw", "valid"]).groupBy("source_file", "file_path").agg(
        F.max("file_size").alias("size"), F.sum("raw").alias("raw"), F.sum("valid").alias("valid"),
        F.max("raw_columns_count").alias("raw_columns_count"), F.max("duplicate_columns").alias("duplicate_columns"),
    )
    return (
        per_file.groupBy("source_file")
        .agg(
            F.sum("size").alias("file_size_bytes"),
            F.sum("raw").alias("total_raw_rows"),
            F.sum("valid").alias("valid_rows"),
            F.max("raw_columns_count").alias("raw_columns_count"),
            F.max("duplicate_columns").alias("duplicate_columns"),
        )
        .withColumn("file_size_mb", F.round(F.col("file_size_bytes") / F.lit(1048576.0), 2))
        .withColumn("empty_padding_rows", F.col("total_raw_rows") - F.col("valid_rows"))
    )


def inf_nan_audit(raw: DataFrame) -> DataFrame:
    """Per capture and rate column: counts of infinities, NaN and nulls among valid rows."""
    tokens = valid_rows(raw).select(
        "source_file",
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("rate_column"), strip(F.col(f"`{header}`")).alias("token"))
            for name, header in RATE_COLUMNS.items()
        ])),
    )
    return (
        tokens.groupBy("source_file", "rate_column")
        .agg(
            _count(F.col("token").isin(INFINITY_TOKENS)).alias("infinity"),
            _count(F.col("token").isin(NEG_INFINITY_TOKENS)).alias("negative_infinity"),
            _count(F.col("token").isin(NAN_TOKENS)).alias("nan"),
            _count(F.col("token").isNull()).alias("null_count"),
        )
        .withColumn(
            "total_problematic", F.col("infinity") + F.col("negative_infinity") + F.col("nan") + F.col("null_count")
        )
    )


def time_range_audit(raw: DataFrame) -> DataFrame:
    """Per capture: first and last corrected timestamp, unparsed stamps, duration."""
    ts = fix_12h_clock(parse_timestamp(F.col("Timestamp")))
    seconds = F.coalesce((F.unix_micros("max_ts") - F.unix_micros("min_ts")) / F.lit(1e6), F.lit(0.0))
    return (
        valid_rows(raw)
        .select("source_file", ts.alias("ts"))
        .groupBy("source_file")
        .agg(
            F.min("ts").alias("min_ts"),
            F.max("ts").alias("max_ts"),
            _count(F.col("ts").isNull()).alias("unparsed_timestamp_count"),
        )
        .withColumn("duration_seconds", seconds)
        .withColumn("duration_hours", F.round(seconds / F.lit(3600.0), 2))
    )


def label_distribution(raw: DataFrame) -> DataFrame:
    """Flows per sanitised label for each capture and over all (``source_file`` = ALL),
    most frequent first, with the share of valid rows in percent."""
    per_file = (
        valid_rows(raw).groupBy("source_file", profile_label(F.col("Label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    # (capture, label) counts are few; the overall rows are summed from them.
    both = per_file.unionByName(
        per_file.groupBy("label").agg(F.sum("n").alias("n")).select(F.lit("ALL").alias("source_file"), "label", "n")
    )
    total = F.sum("n").over(Window.partitionBy("source_file"))
    return both.select(
        "source_file", "label", "n", F.round(F.lit(100.0) * F.col("n") / total, 4).alias("pct")
    ).orderBy("source_file", F.desc("n"), "label")


def topology_profile(flows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct sources, destinations, hosts and directed pairs with graph densities.

    ``by`` are the grouping columns (a capture by default, ``[]`` for everything).  Flows
    collapse to directed pairs first, pairs to hosts, so every step counts rows of an
    already distinct table and a large capture is spread by host.
    """
    by = ["source_file"] if by is None else by
    return _topology(flows.groupBy(*by, "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("flows")), by)


def _topology(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Topology from one row per directed pair with its number of flows."""
    ends = pairs.select(
        *by,
        F.inline(F.array(
            F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("is_src"), F.lit(0).alias("is_dst"), F.col("flows"), F.lit(1).alias("pair")),
            F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("is_src"), F.lit(1).alias("is_dst"), F.lit(0).cast("bigint").alias("flows"), F.lit(0).alias("pair")),
        )),
    )
    hosts = ends.groupBy(*by, "ip").agg(
        F.max("is_src").alias("is_src"), F.max("is_dst").alias("is_dst"), F.sum("flows").alias("flows"), F.sum("pair").alias("pairs")
    )
    v, e = F.col("total_unique_hosts"), F.col("unique_directed_pairs")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 2)).otherwise(0.0)
    return (
        hosts.groupBy(*by)
        .agg(
            F.sum("is_src").alias("unique_source_ips"),
            F.sum("is_dst").alias("unique_destination_ips"),
            F.count(F.lit(1)).alias("total_unique_hosts"),
            F.sum("pairs").alias("unique_directed_pairs"),
            F.sum("flows").alias("flow_rows"),
        )
        .withColumn("graph_density", F.when(v > 1, e / (v.cast("double") * (v - 1))).otherwise(0.0))
        .withColumn("average_out_degree", ratio(e, v))
        .withColumn("flows_per_edge_ratio", ratio(F.col("flow_rows"), e))
        .drop("flow_rows")
    )


def dataset_summary(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: files, raw / valid / padding rows, number of label classes; ``files`` adds captures without rows."""
    valid = valid_row(F.col("Flow ID"), F.col("Source IP"), F.col("Timestamp"))
    # Counted per (capture, label) with map-side combine, then added up.
    cells = raw.groupBy("source_file", F.when(valid, profile_label(F.col("Label"))).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), _count(valid).alias("valid")
    )
    if files is not None:
        cells = cells.unionByName(files.select("source_file", _zero("n"), _zero("valid")), allowMissingColumns=True)
    return cells.agg(
        F.count_distinct("source_file").alias("total_files"),
        F.sum("n").alias("total_raw_lines"),
        F.sum("valid").alias("total_valid_rows"),
        (F.sum("n") - F.sum("valid")).alias("total_padding_rows"),
        F.count_distinct("label").alias("unique_classes"),
    )


def profile_cells(raw: DataFrame) -> DataFrame:
    """Everything the audits count, per (file, source, destination, label), in one scan.

    All measures merge, so map-side combine shrinks a capture to its distinct cells; rows
    without a valid key share one cell.  The report below reads only this table.
    """
    valid = valid_row(F.col("Flow ID"), F.col("Source IP"), F.col("Timestamp"))
    keep = lambda c: F.when(valid, c)
    rows = raw.select(
        "source_file",
        "file_path",
        "file_size",
        valid.alias("ok"),
        keep(strip(F.col("Source IP"))).alias("src_ip"),
        keep(strip(F.col("Destination IP"))).alias("dst_ip"),
        keep(profile_label(F.col("Label"))).alias("label"),
        keep(fix_12h_clock(parse_timestamp(F.col("Timestamp")))).alias("ts"),
        *[strip(F.col(f"`{header}`")).alias(name) for name, header in RATE_COLUMNS.items()],
    )
    ok = F.col("ok")
    audits = []
    for name in RATE_COLUMNS:
        token = F.col(name)
        audits += [
            _count(ok & token.isin(INFINITY_TOKENS)).alias(f"{name}_infinity"),
            _count(ok & token.isin(NEG_INFINITY_TOKENS)).alias(f"{name}_negative_infinity"),
            _count(ok & token.isin(NAN_TOKENS)).alias(f"{name}_nan"),
            _count(ok & token.isNull()).alias(f"{name}_null"),
        ]
    return rows.groupBy("source_file", "file_path", "src_ip", "dst_ip", "label").agg(
        F.max("file_size").alias("file_size"),
        F.count(F.lit(1)).alias("rows"),
        _count(ok).alias("flows"),
        _count(ok & F.col("ts").isNull()).alias("unparsed"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        *audits,
    )


def profile_report(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The whole profile, one row per capture, from a single scan of the captures; ``files`` as for ``file_profile``."""
    cells = materialise(profile_cells(raw), "profile_cells")
    audits = [f"{c}_{kind}" for c in RATE_COLUMNS for kind in ("infinity", "negative_infinity", "nan", "null")]
    sums = ["rows", "flows", "unparsed", *audits]
    cells = _with_files(cells, files, sums)
    by_file = cells.groupBy("source_file", "file_path").agg(
        F.max("file_size").alias("size"),
        F.max("raw_columns_count").alias("raw_columns_count"),
        F.max("duplicate_columns").alias("duplicate_columns"),
        *[F.sum(c).alias(c) for c in sums],
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
    )
    totals = by_file.groupBy("source_file").agg(
        F.sum("size").alias("file_size_bytes"),
        F.max("raw_columns_count").alias("raw_columns_count"),
        F.max("duplicate_columns").alias("duplicate_columns"),
        *[F.sum(c).alias(c) for c in sums],
        F.min("min_ts").alias("min_datetime"),
        F.max("max_ts").alias("max_datetime"),
        ((F.unix_micros(F.max("max_ts")) - F.unix_micros(F.min("min_ts"))) / F.lit(1e6)).alias("seconds"),
    )
    flows = cells.where(F.col("flows") > 0)
    per_label = flows.groupBy("source_file", "label").agg(F.sum("flows").alias("n"))
    label_maps = per_label.groupBy("source_file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_distribution")
    )
    topology = _topology(
        flows.groupBy("source_file", "src_ip", "dst_ip").agg(F.sum("flows").alias("flows")), ["source_file"]
    )
    duration = F.coalesce("seconds", F.lit(0.0))
    return (
        totals.join(label_maps, "source_file", "left")
        .join(topology, "source_file", "left")
        .select(
            "source_file",
            "file_size_bytes",
            F.round(F.col("file_size_bytes") / F.lit(1048576.0), 2).alias("file_size_mb"),
            "raw_columns_count",
            "duplicate_columns",
            F.col("rows").alias("total_raw_rows"),
            F.col("flows").alias("valid_rows"),
            (F.col("rows") - F.col("flows")).alias("empty_padding_rows"),
            "min_datetime",
            "max_datetime",
            duration.alias("duration_seconds"),
            F.round(duration / F.lit(3600.0), 2).alias("duration_hours"),
            F.col("unparsed").alias("unparsed_timestamp_count"),
            *audits,
            *[sum((F.col(a) for a in audits if a.startswith(c)), F.lit(0)).alias(f"{c}_problematic") for c in RATE_COLUMNS],
            "label_distribution",
            *[c for c in topology.columns if c != "source_file"],
        )
    )


def host_union(flows: DataFrame) -> DataFrame:
    """Every address that occurs as source or destination, once."""
    return flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def pair_distinct(flows: DataFrame) -> DataFrame:
    return flows.select("src_ip", "dst_ip").distinct()
