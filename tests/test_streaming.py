from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowtide import fixtures as fx
from flowtide.sources.packets import packets_to_flows
from flowtide.streaming.flows import run_available, session_gap, stream_packets_to_flows, stream_window_stats
from tests.conftest import SF

HOUR = 3600


def source(spark, fields, path=f"{SF}/[e]vents.parquet", **options):
    schema = fx.events(spark, SF).schema
    return spark.readStream.schema(schema).options(**options).parquet(path).selectExpr(*fx.select_list(fields, "STRING"))


def rows(df):
    return sorted(repr(r.asDict()) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events as files in the order of time, two of them swapped by some minutes."""
    folder = str(tmp_path_factory.mktemp("parts"))
    events = fx.events(spark, SF).toPandas().sort_values("ts")
    n = len(events) // 5 + 1
    for i in range(5):
        spark.createDataFrame(events.iloc[i * n : (i + 1) * n], fx.events(spark, SF).schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def watermark(spark, seconds):
    latest = fx.flows(spark, SF).agg(F.max("timestamp")).first()[0]
    return latest.replace(microsecond=latest.microsecond // 1000 * 1000) - timedelta(seconds=seconds)


@pytest.mark.parametrize("files", [False, True])
def test_closed_windows_equal_batch(spark, parts, files):
    """From one batch, and from five batches that share windows."""
    how = {"path": parts, "maxFilesPerTrigger": "1"} if files else {}
    stream = run_available(stream_window_stats(source(spark, fx.flow_fields(), **how), 7200, "1 hour"), "w")
    batch = stream_window_stats(fx.flows(spark, SF), 7200)
    closed = batch.where(F.col("end_time") <= F.lit(watermark(spark, HOUR)))
    assert rows(stream) == rows(closed) and 0 < closed.count() < batch.count()


def test_window_statistics_are_exact(spark):
    got = stream_window_stats(fx.flows(spark, SF), 7200).select("source_file", "start_time", "flow_count", "n_unique_src", "n_unique_dst", "total_bytes", "mean_duration")
    want = fx.flows(spark, SF).groupBy("source_file", F.window("timestamp", "7200 seconds")["start"].alias("start_time")).agg(
        F.count(F.lit(1)).alias("flow_count"), F.count_distinct("src_ip").alias("n_unique_src"), F.count_distinct("dst_ip").alias("n_unique_dst"),
        F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("total_bytes"), F.avg("flow_duration").alias("mean_duration"),
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("files", [False, True])
def test_closed_flows_equal_batch(spark, parts, files):
    how = {"path": parts, "maxFilesPerTrigger": "1"} if files else {}
    stream = run_available(stream_packets_to_flows(source(spark, fx.packet_fields(), **how), fx.PACKET_TIMEOUT, "1 hour", fx.PACKET_CELL), "p")
    batch = packets_to_flows(fx.packets(spark, SF), fx.PACKET_TIMEOUT, fx.PACKET_CELL)
    got, every = rows(stream), rows(batch)
    assert set(got) <= set(every) and len(got) == len(set(got))
    # Flows that ended a whole gap and cell before the watermark are out; those within the gap may not be.
    gone = watermark(spark, HOUR + session_gap(fx.PACKET_TIMEOUT, fx.PACKET_CELL) + fx.PACKET_CELL)
    ended = batch.where(F.timestamp_micros((F.unix_micros("timestamp") + F.col("flow_duration")).cast("bigint")) < F.lit(gone))
    near = session_gap(fx.PACKET_TIMEOUT, fx.PACKET_CELL) - fx.PACKET_TIMEOUT + 2 * fx.PACKET_CELL
    assert len(got) >= 0.9 * ended.count() > 0 and near < fx.PACKET_TIMEOUT


def test_streams_equal_batch_tables_where_all_is_closed(spark):
    got = stream_packets_to_flows(fx.packets(spark, SF), fx.PACKET_TIMEOUT, cell_seconds=fx.PACKET_CELL)
    assert rows(got) == rows(packets_to_flows(fx.packets(spark, SF), fx.PACKET_TIMEOUT, fx.PACKET_CELL))


@pytest.mark.parametrize("name", ["windows", "flows"])
def test_closed_state_is_dropped(spark, parts, name):
    """Each of both operators has dropped nearly all it held; what stays is what the watermark hasn't passed."""
    if name == "windows":
        stream = stream_window_stats(source(spark, fx.flow_fields(), parts, maxFilesPerTrigger="1"), 7200, "1 hour")
    else:
        stream = stream_packets_to_flows(source(spark, fx.packet_fields(), parts, maxFilesPerTrigger="1"), fx.PACKET_TIMEOUT, "1 hour", fx.PACKET_CELL)
    query = stream.writeStream.format("memory").queryName(f"closed_{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 5
    held = [[s["numRowsTotal"] for s in p["stateOperators"]] for p in query.recentProgress]
    removed = [sum(p["stateOperators"][i]["numRowsRemoved"] for p in query.recentProgress) for i in (0, 1)]
    assert len(held[-1]) == 2 and all(x > 100 for x in removed)
    assert all(now < 0.2 * gone for now, gone in zip(held[-1], removed))
