from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowtide import fixtures as fx
from flowtide.operators import profile
from flowtide.schema import CSV_FIELDS, FLOW_SCHEMA
from flowtide.sources import captures as C
from flowtide.sources import packets as P
from flowtide.sources import storage
from tests.conftest import SF

HEADERS = ["Flow ID"] + [h for _, h, _ in CSV_FIELDS]


def line(**cells):
    base = {h: "1" for h in HEADERS} | {"Flow ID": "f1", "Source IP": "10.0.0.1", "Destination IP": "10.0.0.2", "Timestamp": "3/7/2017 9:01", "Label": "BENIGN"}
    return ",".join({**base, **cells}[h] for h in HEADERS)


def write(path, lines, headers=None):
    head = ",".join([h if i % 2 else f" {h}" for i, h in enumerate(headers or HEADERS)])
    path.write_bytes("\n".join([head, *lines]).encode("utf-8", "surrogateescape") + b"\n")
    return str(path)


def test_dirty_capture(spark, tmp_path):
    lines = [
        line(**{"Flow Bytes/s": "Infinity", "Destination Port": "53.7", "Protocol": ""}),
        line(**{"Flow Bytes/s": "-Infinity", "Timestamp": "7/7/2017 3:30", "Total Length of Fwd Packets": "1.23E+07"}),
        line(**{"Flow Bytes/s": "NaN", "Timestamp": "03/07/2017 08:55:58", "Source IP": " 10.0.0.9 "}),
        line(**{"Flow Bytes/s": "", "Timestamp": "2017-07-03 12:59"}),
        line(Timestamp="x", Label="Web Attack \udcff XSS"),
        line(Timestamp="2017-07-03 10:00:01") + ",extra,cells",
        line().split(",", 9)[0] + "," + ",".join(line().split(",")[1:9]),
        "," * (len(HEADERS) - 1),
        " , ,,,,,,",
    ]
    flows = C.read_flows(spark, write(tmp_path / "day.csv", lines))
    rows = flows.collect()
    assert len(rows) == 7 and {r.source_file for r in rows} == {"day.csv"}
    assert rows[0].flow_bytes_s is None and rows[0].dst_port == 53 and rows[0].protocol == 6
    assert rows[1].timestamp == datetime(2017, 7, 7, 15, 30) and rows[1].fwd_bytes == 1.23e7
    assert rows[2].timestamp == datetime(2017, 7, 3, 8, 55, 58) and rows[2].src_ip == "10.0.0.9"
    assert rows[3].timestamp == datetime(2017, 7, 3, 12, 59) and rows[3].flow_bytes_s is None
    assert rows[4].timestamp is None and rows[4].label == "Web Attack - XSS"
    assert rows[5].timestamp == datetime(2017, 7, 3, 10, 0, 1)
    assert rows[6].psh_count == 0.0 and rows[6].label is None  # short row padded

    raw = C.normalize_headers(C.read_raw_untyped(spark, str(tmp_path)))
    report = profile.file_profile(raw).first()
    assert (report.total_raw_rows, report.valid_rows, report.empty_padding_rows) == (9, 7, 2)
    assert report.file_size_bytes == (tmp_path / "day.csv").stat().st_size
    audit = {r.rate_column: r for r in profile.inf_nan_audit(raw).collect()}["flow_bytes_s"]
    assert (audit.infinity, audit.negative_infinity, audit.nan, audit.null_count, audit.total_problematic) == (1, 1, 1, 2, 5)  # the short row has no rate either


def test_repeated_header(spark, tmp_path):
    headers = HEADERS + ["Fwd Header Length", "Other", "Fwd Header Length"]
    path = write(tmp_path / "a.csv", [line() + ",5,6,7"], headers)
    assert C.read_flow_csv(spark, path).first().src_ip == "10.0.0.1"
    raw = C.read_raw_untyped(spark, path, check_headers=False)
    names = raw.columns[: len(headers)]
    assert C.duplicate_headers(names) == ["Fwd Header Length"]
    clean = C.normalize_headers(raw)
    assert tuple(clean.select("Fwd Header Length", "Other", "Fwd Header Length_28", "Source IP").first()) == ("5", "6", "7", "10.0.0.1")
    assert len(set(clean.columns)) == len(clean.columns)


def test_folder_reads_every_capture_once(spark, tmp_path):
    for name, n in (("b.csv", 2), ("a.csv", 3)):
        write(tmp_path / name, [line()] * n)
    (tmp_path / "notes.txt").write_text("no capture")
    flows = C.read_flow_dir(spark, str(tmp_path))
    assert {r.source_file: r["count"] for r in flows.groupBy("source_file").count().collect()} == {"a.csv": 3, "b.csv": 2}


def test_captures_of_other_column_orders_are_mapped_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", [line()])
    write(tmp_path / "b b.csv", [",".join(line().split(",")[::-1])] * 2, HEADERS[::-1])
    write(tmp_path / "none.csv", [])
    rows = C.read_flow_dir(spark, str(tmp_path)).collect()
    assert sorted(r.source_file for r in rows) == ["a.csv"] + ["b b.csv"] * 2
    assert {tuple(r)[:-1] for r in rows} == {tuple(rows[0])[:-1]}


def test_capture_without_header_fails(spark, tmp_path):
    write(tmp_path / "a.csv", [line()])
    (tmp_path / "b.csv").write_text(line() + "\n")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="b.csv"):
        C.read_flow_dir(spark, str(tmp_path))


def test_captures_without_rows_are_profiled(spark, tmp_path):
    write(tmp_path / "a.csv", [line()] * 3)
    write(tmp_path / "none.csv", [])
    files = C.list_captures(spark, str(tmp_path))
    raw = C.normalize_headers(C.read_raw_untyped(spark, str(tmp_path)))
    size = (tmp_path / "none.csv").stat().st_size
    counts = lambda df: {r.source_file: (r.file_size_bytes, r.total_raw_rows, r.valid_rows) for r in df.collect()}
    for report in (profile.file_profile(raw, files), profile.profile_report(raw, files)):
        found = counts(report)
        assert set(found) == {"a.csv", "none.csv"} and found["none.csv"] == (size, 0, 0) and found["a.csv"][1:] == (3, 3)
    assert profile.dataset_summary(raw, files).first().total_files == 2


def test_missing_column_and_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", [line()], ["Unknown"] + HEADERS[1:])
    with pytest.raises(Exception):
        C.read_flow_csv(spark, path).collect()
    with pytest.raises(Exception):
        C.read_flow_csv(spark, str(tmp_path / "none.csv")).collect()
    with pytest.raises(Exception):
        storage.load_fitted(spark, str(tmp_path / "none")).collect()


def test_custom_reader_is_checked(spark):
    with pytest.raises(TypeError):
        C.read_flows(spark, "", lambda s, p: s.range(1))
    assert C.read_flows(spark, "", lambda s, p: C.empty_flows(s)).count() == 0


def test_scan_reads_only_needed_columns(spark, tmp_path):
    write(tmp_path / "a.csv", [line()])
    plan = C.read_flow_csv(spark, str(tmp_path)).select("src_ip", "fwd_pkts")._jdf.queryExecution().toString()
    schema = plan.rsplit("ReadSchema", 1)[1]
    assert "Total Fwd Packets" in schema and "Flow IAT Std" not in schema


def packet(t, src="a", sport=1, dst="b", dport=2, length=10, **flags):
    return (datetime.fromtimestamp(t / 1e6), src, dst, sport, dport, 6, length, *[flags.get(f, False) for f in ("syn", "rst", "ack", "fin", "psh")])


PACKETS = "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, syn boolean, rst boolean, ack boolean, fin boolean, psh boolean"


def test_packet_sessions(spark):
    s = 1_000_000
    base = 1_500_000_000 * s
    df = spark.createDataFrame(
        [
            packet(base + 100 * s, "b", 2, "a", 1, 40, syn=True),  # first packet sets the direction
            packet(base + 101 * s, length=10, ack=True),
            packet(base + 221 * s, length=20),  # idle exactly the timeout: same flow
            packet(base + 341 * s + 1, length=5),  # a microsecond more: next flow
            packet(base + 100 * s, "a", 1, "c", 2),
        ],
        PACKETS,
    )
    flows = {(r.src_ip, r.dst_ip, r.fwd_bytes): r for r in P.packets_to_flows(df, 120).collect()}
    assert len(flows) == 3
    first = flows["b", "a", 40.0]
    assert (first.fwd_pkts, first.bwd_pkts, first.bwd_bytes, first.syn_count, first.ack_count) == (1.0, 2.0, 30.0, 1.0, 1.0)
    assert first.flow_duration == 121 * s and first.flow_iat_mean == pytest.approx(60.5 * s)
    assert flows["a", "b", 5.0].flow_bytes_s is None
    assert [f.name for f in P.packets_to_flows(df).schema] == FLOW_SCHEMA.names
    assert P.packets_to_flows(df.limit(0)).count() == 0


def test_split_tables_prune(spark, tables, tmp_path):
    storage.write_windows(tables.series, str(tmp_path / "w"))
    test = storage.read_split(spark, str(tmp_path / "w"), "test")
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    assert test.count() == tables.series.where(F.col("split") == "test").count()


def test_captures_round_trip(spark):
    raw = C.valid_rows(fx.raw_flows(spark, SF))
    read = C.valid_rows(fx.capture_rows(spark, SF))
    columns = ["Flow ID", "Source IP", "Timestamp", "Flow Bytes/s", "Label", "source_file"]
    assert sorted(map(repr, read.select(*columns).collect())) == sorted(map(repr, raw.select(*columns).collect()))


def test_gaps_of_a_busy_tuple(spark):
    """A third of all packets is one 5-tuple's; the spread of its gaps is the plain one, whatever the cells."""
    import numpy as np

    draw = np.random.default_rng(4)
    times = np.sort(draw.integers(0, 600_000_000, 900)) + 1_500_000_000_000_000
    times[100:110] = times[100]  # equal times: gaps of zero
    rest = [packet(int(t), f"h{i % 300}", 1, "x", 2) for i, t in enumerate(draw.integers(0, 600_000_000, 1800) + 1_500_000_000_000_000)]
    df = spark.createDataFrame([packet(int(t), "b", 2, "a", 1) for t in times] + rest, PACKETS)
    for cell in (0.05, 1.0, 5.0, 60.0):
        flows = P.packets_to_flows(df, 5, cell).where("src_ip in ('a', 'b') and dst_ip in ('a', 'b')").orderBy("timestamp").collect()
        cuts = np.flatnonzero(np.diff(times) > 5_000_000) + 1
        parts = np.split(times, cuts)
        assert [f.fwd_pkts + f.bwd_pkts for f in flows] == [len(x) for x in parts] and len(parts) > 1
        assert [f.flow_iat_std for f in flows] == pytest.approx([np.diff(x).std() if len(x) > 1 else 0.0 for x in parts])


def test_headers_without_scanning(spark, tmp_path):
    """Three layouts, repeated names, a header only, an empty file, a byte order mark; long files are not read on."""
    write(tmp_path / "a.csv", [line()] * 60_000)
    write(tmp_path / "b b.csv", [",".join(line().split(",")[::-1])], HEADERS[::-1])
    write(tmp_path / "c.csv", [line() + ",5,6"], HEADERS + [" Fwd Header Length", "Fwd Header Length "])
    write(tmp_path / "none.csv", [])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "mark.csv").write_bytes(b"\xef\xbb\xbf" + (tmp_path / "none.csv").read_bytes().replace(b"\n", b"\r\n"))
    table = C.header_table(spark, str(tmp_path))
    found = {r.source_file: (r.raw_columns_count, r.duplicate_columns) for r in table.collect()}
    n = len(HEADERS)
    assert found == {"a.csv": (n, []), "b b.csv": (n, []), "c.csv": (n + 2, ["Fwd Header Length"]), "none.csv": (n, []), "mark.csv": (n, [])}
    raw = C.read_raw_dir(spark, str(tmp_path), [*profile.profile_columns(), "Lost"], table)
    counts = {r.source_file: r for r in profile.file_profile(raw, table).collect()}
    assert {k: (r.total_raw_rows, r.valid_rows, r.raw_columns_count) for k, r in counts.items()} == {
        "a.csv": (60_000, 60_000, n), "b b.csv": (1, 1, n), "c.csv": (1, 1, n + 2), "none.csv": (0, 0, n), "mark.csv": (0, 0, n)
    }
    assert {r.source_file: r.duplicate_columns for r in profile.profile_report(raw, table).collect()}["c.csv"] == ["Fwd Header Length"]
    assert profile.dataset_summary(raw, table).first().total_files == 5
    assert raw.where("`Lost` is not null").count() == 0 and raw.select("Source IP").distinct().count() == 1
    assert C.read_flow_dir(spark, str(tmp_path), table).groupBy("src_ip", "dst_port").count().first()["count"] == 60_002
