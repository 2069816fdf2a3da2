"""Flow, raw-capture and packet views over the ``events`` table.

The select lists are plain SQL that Spark and DuckDB read alike, except for the name of
the text type, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.sources.captures import normalize_headers, read_raw_untyped
from flowtide.plans.materialise import scratch_path
from flowtide.schema import CSV_FIELDS, FLOW_SCHEMA, N_CLASSES, NODE_FEATURES, WINDOW_FEATURES

WINDOW_SECONDS = 7_200
HISTORY = 10
HORIZON = 5
MAX_EDGES = 20
PACKET_TIMEOUT = 21_600
PACKET_CELL = 600
# What a stream waits for late rows, in seconds; the streams' default.
LATENESS = 600

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
SLOT = "((hour(ts) + 3 * day(ts)) % 12)"

COMMON = {
    "flow_id": "event_id",
    "source_file": "'capture_' || CAST(CAST(floor((day(ts) - 1) / 4) AS INT) AS {text})",
    "src_ip": "'10.0.0.' || CAST(user_id % 50 AS {text})",
    "dst_ip": f"'10.0.0.' || CAST(({K} * 7) % 60 AS {{text}})",
    "src_port": "CAST(1024 + event_id % 5000 AS BIGINT)",
    "dst_port": f"CAST({K} AS BIGINT)",
    "protocol": "CAST(CASE WHEN event_id % 3 = 0 THEN 17 ELSE 6 END AS INT)",
    "label": (
        f"CASE WHEN event_id % 5 <> 0 THEN 'BENIGN' WHEN {SLOT} = 5 THEN 'PortScan' WHEN {SLOT} = 6 THEN 'SSH-Patator' "
        f"WHEN {SLOT} = 7 THEN 'Web Attack - XSS' WHEN {SLOT} = 8 THEN 'DoS Hulk' WHEN {SLOT} = 9 THEN 'DDoS' "
        f"WHEN {SLOT} = 10 THEN 'Bot' WHEN {SLOT} = 11 THEN 'Infiltration' ELSE 'BENIGN' END"
    ),
}

NUMBERS = {
    "flow_duration": "round(value * 100)",
    "fwd_pkts": "event_id % 7",
    "bwd_pkts": "event_id % 5",
    "fwd_bytes": "round(value * 10)",
    "bwd_bytes": f"{K} * 10",
    "flow_bytes_s": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(value) END",
    "flow_pkts_s": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(value) END",
    "flow_iat_mean": "event_id % 13",
    "syn_count": "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END",
    "rst_count": "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END",
}

RAW_TEXT = {
    "flow_id_txt": "CASE WHEN event_id % 40 = 0 THEN '' ELSE 'f' || CAST(event_id AS {text}) END",
    "ts_txt": (
        "CASE WHEN event_id % 97 = 0 THEN 'x' ELSE CAST(day(ts) AS {text}) || '/' || CAST(month(ts) AS {text}) || '/' || "
        "CAST(year(ts) AS {text}) || ' ' || CAST(CASE WHEN hour(ts) BETWEEN 13 AND 19 THEN hour(ts) - 12 ELSE hour(ts) END AS {text}) "
        "|| ':' || lpad(CAST(minute(ts) AS {text}), 2, '0') END"
    ),
    "flow_bytes_s_txt": (
        "CASE WHEN event_id % 50 = 0 THEN 'Infinity' WHEN event_id % 50 = 1 THEN '-Infinity' WHEN event_id % 50 = 2 THEN 'NaN' "
        "WHEN event_id % 50 = 3 THEN NULL ELSE CAST(CAST(round(value * 100) AS BIGINT) AS {text}) END"
    ),
}


def stored_coefficients() -> dict[str, tuple[list[list[float]], list[float]]]:
    """Rows and biases of models of full size, from a formula: transition, threat head and baseline.

    Ratios over a tiny range make some state values millions of times larger than others; weights go by that size.
    """
    width = 2 * len(NODE_FEATURES)
    size = [1e6 if i % len(NODE_FEATURES) in (6, 7) else 10.0 for i in range(width)]
    step = lambda j, lag, i: (
        size[j] / size[i] * ((j * 5 + lag * 3 + i * 7) % 13 - 6) / 1000.0 + (0.5 if lag == HISTORY - 1 and i == j else 0.0)
    )
    return {
        "transition": ([[step(j, lag, i) for lag in range(HISTORY) for i in range(width)] for j in range(width)], [size[j] * (j % 3 - 1) / 100.0 for j in range(width)]),
        "head": ([[((c * 3 + j * 5) % 11 - 5) / size[j] / 4.0 for j in range(width)] for c in range(N_CLASSES)], [(c * 2 % 7) / 5.0 for c in range(N_CLASSES)]),
        "baseline": ([[((c * 4 + j * 3) % 9 - 4) / 4.0 for j in range(len(WINDOW_FEATURES))] for c in range(N_CLASSES)], [(c * 3 % 7) / 5.0 for c in range(N_CLASSES)]),
    }


def select_list(fields: dict[str, str], text: str) -> list[str]:
    return [f"{expression.format(text=text)} AS {name}" for name, expression in fields.items()]


def flow_fields() -> dict[str, str]:
    doubles = {
        f.name: f"CAST({NUMBERS.get(f.name, '0.0')} AS DOUBLE)"
        for f in FLOW_SCHEMA
        if f.dataType.simpleString() == "double"
    }
    return {**COMMON, "timestamp": "CAST(ts AS TIMESTAMP)", **doubles}


def raw_fields() -> dict[str, str]:
    """Text columns of a capture, under flow field names."""
    numbers = {
        name: f"CAST(CAST({expression} AS BIGINT) AS {{text}})"
        for name, expression in NUMBERS.items()
        if name not in ("flow_bytes_s", "flow_pkts_s")
    }
    return {
        "flow_id": RAW_TEXT["flow_id_txt"],
        "source_file": COMMON["source_file"],
        "src_ip": COMMON["src_ip"],
        "dst_ip": COMMON["dst_ip"],
        "src_port": f"CAST({COMMON['src_port']} AS {{text}})",
        "dst_port": f"CAST({COMMON['dst_port']} AS {{text}})",
        "protocol": f"CAST({COMMON['protocol']} AS {{text}})",
        "timestamp": RAW_TEXT["ts_txt"],
        **numbers,
        "flow_bytes_s": RAW_TEXT["flow_bytes_s_txt"],
        "flow_pkts_s": RAW_TEXT["flow_bytes_s_txt"],
        "label": COMMON["label"],
    }


def packet_fields() -> dict[str, str]:
    names = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    return {
        "ts": "CAST(ts AS TIMESTAMP)",
        # One packet an event is too sparse for 5-tuples, so ports depend on the host only.
        **{n: COMMON[n] for n in names},
        "src_port": "CAST(1024 + user_id % 50 AS BIGINT)",
        "dst_port": "CAST(80 AS BIGINT)",
        "protocol": "CAST(6 AS INT)",
        "length": "CAST(round(value) AS INT)",
        "syn": "event_id % 4 = 0",
        "rst": "false",
        "ack": "false",
        "fin": "false",
        "psh": "false",
    }


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed flows plus ``flow_id``, the tie key."""
    return events(spark, sf_dir).selectExpr(*select_list(flow_fields(), "STRING"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*select_list(packet_fields(), "STRING"))


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture rows as text under clean capture headers, plus ``event_id``."""
    headers = {name: header for name, header, _ in CSV_FIELDS} | {"flow_id": "Flow ID", "source_file": "source_file"}
    present = raw_fields()
    text = events(spark, sf_dir).selectExpr("event_id", *select_list(present, "STRING"))
    rest = [F.lit("0").alias(header) for name, header, _ in CSV_FIELDS if name not in present]
    return text.select("event_id", *[F.col(n).alias(headers[n]) for n in present], *rest)


def write_captures(spark: SparkSession, sf_dir: str, mixed: bool = False) -> str:
    """The raw rows as a folder of CSV captures with dirty headers; returns its path.

    ``mixed`` captures differ: every second one has its columns in the opposite order and one less, the others repeat a
    header, and one capture has a header only.
    """
    raw = raw_flows(spark, sf_dir)
    path = scratch_path(spark, "captures")
    columns = [c for c in raw.columns if c not in ("event_id", "source_file")]
    dirty = [F.col(f"`{c}`").alias(c if c == "Flow ID" else f" {c}") for c in columns]
    length = F.lit("0")
    tie = F.col("event_id").cast("string").alias("event_id")
    again = "Fwd Header Length " if mixed else " Fwd Header Length.1"
    plain = raw.select(*dirty, length.alias(" Fwd Header Length"), length.alias(again), tie, "source_file")
    cells = [c for c in plain.columns if c != "source_file"]

    def write(df: DataFrame, folder: str, partitioned: bool = True) -> None:
        out = df.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False)
        out = out.option("ignoreTrailingWhiteSpace", False).option("emptyValue", "")
        (out.partitionBy("source_file") if partitioned else out).csv(folder)

    if not mixed:
        write(plain, path)
        return path
    odd = F.substring("source_file", -1, 1).cast("int") % 2 == 1
    write(plain.where(~odd), path)
    write(plain.where(odd).select(*[F.col(f"`{c}`") for c in reversed(cells) if c != again], "source_file"), path)
    write(plain.drop("source_file").limit(0).coalesce(1), f"{path}/source_file=capture_none", partitioned=False)
    return path


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_headers(read_raw_untyped(spark, write_captures(spark, sf_dir)))
