"""DuckDB SQL that computes each query on its own from the same Parquet tables."""

from __future__ import annotations

import re

from flowtide import fixtures as fx
from flowtide.queries import SIMPLE_FEATURES, SIMPLE_WEIGHTS
from flowtide.streaming.flows import session_gap
from flowtide.schema import (
    CLASS_NAMES,
    CSV_FIELDS,
    EDGE_FEATURES,
    FLOW_SCHEMA,
    KNOWLEDGE,
    KNOWLEDGE_FIELDS,
    LABEL_CLASSES,
    N_CLASSES,
    NODE_FEATURES,
    NULL_TOKENS,
    NUMERIC_FIELDS,
    SEVERITY,
    WINDOW_FEATURES,
)

W = fx.WINDOW_SECONDS
N = fx.HISTORY
K = fx.HORIZON
CELL_US = fx.PACKET_CELL * 1_000_000
GAP_US = int(session_gap(fx.PACKET_TIMEOUT, fx.PACKET_CELL) * 1_000_000)
EDGE = "source_file, window_idx, src_ip, dst_ip"
KEY = "source_file, window_idx"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r(x: str, digits: int = 6) -> str:
    """Rounded as in ``queries.rounded``, with minus zero written as zero."""
    x = f"({x}) + CAST({0.0123456 * 10.0**-digits!r} AS DOUBLE)"
    return f"(CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END)"


def r4(x: str) -> str:
    """Rounded to four decimals, as the operators themselves do."""
    return f"(CASE WHEN round({x}, 4) = 0 THEN 0.0 ELSE round({x}, 4) END)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def case(value: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"(CASE {value} {arms} ELSE {default} END)"


def category(label: str) -> str:
    return case(label, LABEL_CLASSES, q(CLASS_NAMES[0]))


def class_index(cat: str) -> str:
    return f"CAST({case(cat, {n: i for i, n in enumerate(CLASS_NAMES)}, '0')} AS INTEGER)"


def class_name(index: str) -> str:
    return case(index, dict(enumerate(CLASS_NAMES)), q("UNKNOWN"))


def severity(cat: str) -> str:
    return case(cat, {n: i for i, n in enumerate(SEVERITY)}, str(len(SEVERITY) - 1))


def tier(x: str, suffix: str = "") -> str:
    return f"CASE WHEN {x} >= CAST(0.70 AS DOUBLE) THEN 'CRITICAL / HIGH{suffix}' WHEN {x} >= CAST(0.30 AS DOUBLE) THEN 'ELEVATED / MEDIUM{suffix}' ELSE 'NOMINAL / LOW{suffix}' END"


def each(columns, wrap=r, digits: int = 6) -> str:
    return ", ".join(f"{wrap(c, digits)} AS {c}" for c in columns)


def number(cell: str) -> str:
    tokens = ", ".join(q(t) for t in NULL_TOKENS)
    return f"(CASE WHEN {cell} IN ({tokens}) THEN NULL ELSE TRY_CAST({cell} AS DOUBLE) END)"


FORMATS = "['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M']"


def parsed(cell: str) -> str:
    return f"try_strptime(trim({cell}), {FORMATS})"


def clock(x: str) -> str:
    return f"(CASE WHEN hour({x}) BETWEEN 1 AND 7 THEN {x} + INTERVAL 12 HOUR ELSE {x} END)"


def typed_fields() -> str:
    """Typed flow record from the raw text columns."""
    raw = fx.raw_fields()
    out = []
    for name, _, default in CSV_FIELDS:
        kind = FLOW_SCHEMA[name].dataType.simpleString()
        cell = name if name in raw else "'0'"
        if name == "timestamp":
            value = clock(parsed("timestamp"))
        elif name == "label":
            value = "label"
        elif kind == "string":
            value = f"trim({cell})"
        elif kind == "double":
            value = number(cell)
        else:
            value = f"CAST(trunc({number(cell)}) AS {'BIGINT' if kind == 'bigint' else 'INTEGER'})"
        out.append(f"{f'coalesce({value}, {default})' if default is not None else value} AS {name}")
    return ", ".join(out) + ", source_file"


HAS = lambda c: f"({c} IS NOT NULL AND trim({c}) <> '')"
VALID = f"{HAS('flow_id')} AND {HAS('src_ip')} AND {HAS('timestamp')}"
RAW_FIELDS = ", ".join(["event_id", *fx.select_list(fx.raw_fields(), "VARCHAR")])
FLOW_FIELDS = ", ".join(fx.select_list(fx.flow_fields(), "VARCHAR"))
PACKET_FIELDS = ", ".join(fx.select_list(fx.packet_fields(), "VARCHAR"))
LAYER_WIDTH = len(NODE_FEATURES)
#: Record fields, flow id, two repeated headers and the tie key.
# Every second capture has one column less; the others name one twice.
ODD_CAPTURE = "right(source_file, 1) IN ('1', '3', '5', '7', '9')"
RAW_COLUMNS = f"CAST(CASE WHEN {ODD_CAPTURE} THEN {len(CSV_FIELDS) + 1 + 2} ELSE {len(CSV_FIELDS) + 1 + 3} END AS INTEGER)"
REPEATED = f"CASE WHEN {ODD_CAPTURE} THEN '' ELSE 'Fwd Header Length' END"


def _layer(name: str, before: str) -> list[tuple[str, str]]:
    padded = [f"e.{f}" for f in EDGE_FEATURES] + ["0.0"] * (LAYER_WIDTH - len(EDGE_FEATURES))
    sums = ", ".join(f"sum(greatest(s.h_{i} + {e}, 0.0)) AS m_{i}" for i, e in enumerate(padded))
    own = ", ".join(f"greatest(v.h_{i} + coalesce(m.m_{i}, 0.0), 0.0) AS h_{i}" for i in range(LAYER_WIDTH))
    return [
        (
            f"{name}_sums",
            f"SELECT e.source_file, e.window_idx, e.dst_ip AS ip, {sums} FROM scaled_edges e JOIN {before} s "
            "ON e.source_file = s.source_file AND e.window_idx = s.window_idx AND e.src_ip = s.ip GROUP BY 1, 2, 3",
        ),
        (name, f"SELECT v.source_file, v.window_idx, v.ip, {own} FROM {before} v LEFT JOIN {name}_sums m USING (source_file, window_idx, ip)"),
    ]


def _fit(table: str, features, kind: str) -> str:
    one = lambda f: (
        f"SELECT {q(kind)} AS kind, {q(f)} AS feature, quantile_cont({f}, 0.5) AS center, "
        f"CASE WHEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) = 0 THEN 1.0 "
        f"ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END AS scale FROM {table}"
    )
    return " UNION ALL ".join(one(f) for f in features)


def _scaled(features, kind: str) -> str:
    pick = lambda f, c: f"(SELECT {c} FROM scalers WHERE kind = {q(kind)} AND feature = {q(f)})"
    return ", ".join(f"({f} - {pick(f, 'center')}) / {pick(f, 'scale')} AS {f}" for f in features)


def _rank(value: str) -> str:
    return f"(row_number() OVER (PARTITION BY {KEY} ORDER BY {value}, src_ip, dst_ip) - 1) / (n - 1 + CAST(1e-6 AS DOUBLE))"


SUM_COLUMNS = ["flow_count", "total_bytes", "total_pkts", "duration_sum", "duration_n", "iat_sum", "iat_n", "syn_count", "rst_count"]
STATE = {"z0": "syn_ratio", "z1": "rst_ratio", "z2": "flow_count / CAST(100.0 AS DOUBLE)"}
MAX_RATIO = "CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0.0 END"


def ratio(a: str, b: str) -> str:
    return MAX_RATIO.format(a=a, b=b)


CTES: list[tuple[str, str]] = [
    ("raw", f"SELECT {RAW_FIELDS} FROM events"),
    ("flows", f"SELECT {FLOW_FIELDS} FROM events"),
    ("packets", f"SELECT {PACKET_FIELDS} FROM events"),
    ("origins", "SELECT source_file, min(epoch_us(timestamp)) AS origin_us FROM flows GROUP BY 1"),
    (
        "indexed",
        f"SELECT f.*, origin_us, (epoch_us(timestamp) - origin_us) // {W * 1_000_000} AS window_idx FROM flows f JOIN origins USING (source_file)",
    ),
    (
        "port_counts",
        f"SELECT {EDGE}, dst_port, count(*) AS c FROM indexed GROUP BY {EDGE}, dst_port",
    ),
    (
        "entropies",
        f"SELECT {EDGE}, round(-sum(p * log2(p + CAST(1e-12 AS DOUBLE))), 10) AS dst_port_entropy FROM "
        f"(SELECT *, c / CAST(sum(c) OVER (PARTITION BY {EDGE}) AS DOUBLE) AS p FROM port_counts) GROUP BY {EDGE}",
    ),
    (
        "pairs",
        f"SELECT {EDGE}, min(origin_us) AS origin_us, count(*) AS flow_count, sum(fwd_bytes) + sum(bwd_bytes) AS total_bytes, "
        "sum(fwd_pkts) + sum(bwd_pkts) AS total_pkts, sum(flow_duration) AS duration_sum, count(flow_duration) AS duration_n, "
        "sum(flow_iat_mean) AS iat_sum, count(flow_iat_mean) AS iat_n, sum(syn_count) AS syn_count, sum(rst_count) AS rst_count, "
        f"min({severity(category('label'))}) AS severity FROM indexed GROUP BY {EDGE}",
    ),
    (
        "edges",
        f"SELECT {EDGE}, CAST(flow_count AS DOUBLE) AS flow_count, total_bytes, total_pkts, {ratio('duration_sum', 'duration_n')} AS mean_duration, "
        f"{ratio('iat_sum', 'iat_n')} AS mean_iat, syn_count, dst_port_entropy FROM pairs JOIN entropies USING ({EDGE})",
    ),
    (
        "windows",
        f"SELECT {KEY}, min(origin_us) AS origin_us, count(*) AS flow_count, sum(fwd_bytes) + sum(bwd_bytes) AS total_bytes, "
        "sum(fwd_pkts) + sum(bwd_pkts) AS total_pkts, "
        f"{ratio('sum(syn_count)', '(sum(fwd_pkts) + sum(bwd_pkts))')} AS syn_ratio, {ratio('sum(rst_count)', '(sum(fwd_pkts) + sum(bwd_pkts))')} AS rst_ratio, "
        "coalesce(avg(flow_duration), 0.0) AS mean_duration, count(DISTINCT src_ip) AS n_unique_src, count(DISTINCT dst_ip) AS n_unique_dst, "
        f"{case(f'min({severity(category('label'))})', dict(enumerate(SEVERITY)), q(CLASS_NAMES[0]))} AS target_category FROM indexed GROUP BY {KEY}",
    ),
    (
        "placed",
        f"SELECT w.*, {class_index('target_category')} AS target_index, row_number() OVER (PARTITION BY source_file ORDER BY window_idx) - 1 AS place, "
        "count(*) OVER (PARTITION BY source_file) AS n FROM windows w",
    ),
    (
        "split_windows",
        "SELECT *, CASE WHEN place < floor(CAST(0.70 AS DOUBLE) * n) THEN 'train' "
        "WHEN place < floor(CAST(0.70 AS DOUBLE) * n) + floor(CAST(0.15 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM placed",
    ),
    (
        "series",
        f"SELECT *, row_number() OVER (PARTITION BY split ORDER BY {KEY}) - 1 AS split_idx FROM split_windows",
    ),
    (
        "train_flows",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY timestamp, flow_id) - 1 AS rn, "
        "count(*) OVER (PARTITION BY source_file) AS n FROM flows) WHERE rn < floor(CAST(0.70 AS DOUBLE) * n)",
    ),
    (
        "ends",
        f"SELECT {KEY}, src_ip AS ip, dst_ip AS peer, 0.0 AS ind, 1.0 AS outd, 0.0 AS inb, total_bytes AS outb, 0.0 AS inp, total_pkts AS outp, syn_count AS syn, rst_count AS rst FROM pairs "
        f"UNION ALL SELECT {KEY}, dst_ip, src_ip, 1.0, 0.0, total_bytes, 0.0, total_pkts, 0.0, 0.0, 0.0 FROM pairs",
    ),
    (
        "nodes",
        f"SELECT {KEY}, ip, CAST(sum(ind) AS DOUBLE) AS in_degree, CAST(sum(outd) AS DOUBLE) AS out_degree, sum(inb) AS in_bytes, sum(outb) AS out_bytes, sum(inp) AS in_pkts, sum(outp) AS out_pkts, "
        "sum(syn) / (sum(outp) + sum(inp) + CAST(1e-6 AS DOUBLE)) AS syn_ratio, sum(rst) / (sum(outp) + sum(inp) + CAST(1e-6 AS DOUBLE)) AS rst_ratio, "
        f"CAST(count(DISTINCT peer) AS DOUBLE) AS peer_count FROM ends GROUP BY {KEY}, ip",
    ),
    ("train_nodes", f"SELECT n.* FROM nodes n JOIN series USING ({KEY}) WHERE split = 'train'"),
    ("train_edges", f"SELECT e.* FROM edges e JOIN series USING ({KEY}) WHERE split = 'train'"),
    ("scalers", f"{_fit('train_nodes', NODE_FEATURES, 'node_scaler')} UNION ALL {_fit('train_edges', EDGE_FEATURES, 'edge_scaler')}"),
    (
        "medians",
        " UNION ALL ".join(
            f"SELECT 'flow_median' AS kind, {q(c)} AS feature, coalesce(quantile_cont({c}, 0.5), 0.0) AS center, CAST(1.0 AS DOUBLE) AS scale FROM train_flows"
            for c in NUMERIC_FIELDS
        ),
    ),
    (
        "ranked",
        f"SELECT *, {_rank('total_bytes')} AS rank_total_bytes, {_rank('flow_count')} AS rank_flow_count, {_rank('syn_count')} AS rank_syn_count, "
        f"{_rank('dst_port_entropy')} AS rank_dst_port_entropy FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM edges)",
    ),
    (
        "sampled",
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY CAST(0.35 AS DOUBLE) * rank_total_bytes + CAST(0.25 AS DOUBLE) * rank_flow_count "
        f"+ CAST(0.20 AS DOUBLE) * rank_syn_count + CAST(0.20 AS DOUBLE) * rank_dst_port_entropy DESC, src_ip, dst_ip) AS place FROM ranked) "
        f"WHERE n <= {fx.MAX_EDGES} OR place <= {fx.MAX_EDGES}",
    ),
    ("indexed_nodes", f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ip) - 1 AS node_idx FROM nodes"),
    (
        "linked",
        "SELECT e.*, s.node_idx AS src_idx, d.node_idx AS dst_idx FROM {table} e "
        "JOIN indexed_nodes s ON e.source_file = s.source_file AND e.window_idx = s.window_idx AND e.src_ip = s.ip "
        "JOIN indexed_nodes d ON e.source_file = d.source_file AND e.window_idx = d.window_idx AND e.dst_ip = d.ip",
    ),
    ("scaled_nodes", f"SELECT {KEY}, ip, node_idx, {_scaled(NODE_FEATURES, 'node_scaler')} FROM indexed_nodes"),
    ("scaled_edges", f"SELECT {EDGE}, src_idx, dst_idx, {_scaled(EDGE_FEATURES, 'edge_scaler')} FROM linked"),
    ("layer0", f"SELECT {KEY}, ip, {', '.join(f'{f} AS h_{i}' for i, f in enumerate(NODE_FEATURES))} FROM scaled_nodes"),
    *_layer("layer1", "layer0"),
    *_layer("layer2", "layer1"),
    (
        "states",
        f"SELECT split, split_idx, source_file, target_index, {', '.join(f'{v} AS {k}' for k, v in STATE.items())} FROM series",
    ),
    ("steps", f"SELECT CAST(unnest(range(1, {K + 1})) AS INTEGER) AS step"),
    (
        "made",
        "SELECT split, split_idx AS origin_idx, 'forecaster' AS model, step, target_index AS y_pred FROM series, steps UNION ALL "
        f"SELECT split, split_idx, 'baseline', step, CAST((target_index * 3 + 1) % {N_CLASSES} AS INTEGER) FROM series, steps",
    ),
    (
        "scored",
        "SELECT m.split, m.model, m.step AS horizon, m.origin_idx, s.target_index AS y_true, m.y_pred FROM made m "
        "JOIN series s ON m.split = s.split AND m.origin_idx + m.step = s.split_idx "
        "JOIN (SELECT split, count(*) AS n FROM series GROUP BY 1) c ON m.split = c.split "
        f"WHERE m.origin_idx >= {N - 1} AND m.origin_idx - {N - 1} < c.n - {N} - {K}",
    ),
    ("confusion", "SELECT model, horizon, y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL"),
    ("classes", "SELECT CAST(unnest(range(7)) AS INTEGER) AS class_index"),
    (
        "per_class",
        "SELECT g.model, g.horizon, c.class_index, coalesce(sum(n) FILTER (WHERE y_true = class_index), 0) AS support, "
        "coalesce(sum(n) FILTER (WHERE y_pred = class_index), 0) AS predicted, coalesce(sum(n) FILTER (WHERE y_true = class_index AND y_pred = class_index), 0) AS hits "
        "FROM (SELECT DISTINCT model, horizon FROM confusion) g, classes c JOIN confusion k ON k.model = g.model AND k.horizon = g.horizon GROUP BY 1, 2, 3",
    ),
    (
        "class_scores",
        f"SELECT model, horizon, class_index, {ratio('hits', 'predicted')} AS precision, {ratio('hits', 'support')} AS recall, "
        f"{ratio('2 * hits', '(support + predicted)')} AS f1, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted FROM per_class",
    ),
    (
        "macro",
        "SELECT model, horizon, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall "
        "FROM class_scores WHERE support + predicted > 0 GROUP BY 1, 2",
    ),
    (
        "alarms",
        "SELECT model, horizon, CASE WHEN coalesce(sum(n) FILTER (WHERE y_true = 0), 0) > 0 THEN coalesce(sum(n) FILTER (WHERE y_true = 0 AND y_pred > 0), 0) / "
        "CAST(sum(n) FILTER (WHERE y_true = 0) AS DOUBLE) ELSE 0.0 END AS false_positive_rate FROM confusion GROUP BY 1, 2",
    ),
    ("all_metrics", "SELECT * FROM macro JOIN alarms USING (model, horizon)"),
    (
        "compared",
        "SELECT f.horizon, "
        + ", ".join(
            f"{a}.{m} AS {name}_{m}"
            for a, name in (("f", "forecaster"), ("b", "baseline"))
            for m in ("macro_f1", "weighted_f1", "macro_precision", "macro_recall", "false_positive_rate")
        )
        + ", f.macro_f1 - b.macro_f1 AS gain FROM all_metrics f JOIN all_metrics b USING (horizon) WHERE f.model = 'forecaster' AND b.model = 'baseline'",
    ),
    (
        "trajectory",
        "SELECT split, split_idx AS origin_idx, step, target_index AS class_index, CAST(0.9 AS DOUBLE) - CAST(0.08 AS DOUBLE) * step AS confidence, "
        "(1.0 - (CAST(0.9 AS DOUBLE) - CAST(0.08 AS DOUBLE) * step)) / CAST(6.0 AS DOUBLE) AS other FROM series, steps",
    ),
    (
        "threats",
        f"SELECT *, {class_name('class_index')} AS predicted_class, 1.0 - CASE WHEN class_index = 0 THEN confidence ELSE other END AS threat_score, "
        "CASE WHEN class_index = 6 THEN confidence ELSE other END AS p_infiltration FROM trajectory",
    ),
    (
        "logits",
        f"SELECT event_id, {', '.join(f'((event_id * {c + 1}) % 11) / CAST(3.0 AS DOUBLE) AS l{c}' for c in range(N_CLASSES))} FROM events",
    ),
    (
        "softmax",
        f"SELECT event_id, {', '.join(f'exp(l{c} - m) / ({' + '.join(f'exp(l{d} - m)' for d in range(N_CLASSES))}) AS p{c}' for c in range(N_CLASSES))}, "
        f"{', '.join(f'l{c}' for c in range(N_CLASSES))}, m FROM (SELECT *, greatest({', '.join(f'l{c}' for c in range(N_CLASSES))}) AS m FROM logits)",
    ),
]

SHARES = [
    ("sums", f"SELECT split, split_idx AS origin_idx, {' + '.join(WINDOW_FEATURES)} AS total, {', '.join(WINDOW_FEATURES)} FROM series"),
    (
        "shares",
        " UNION ALL ".join(f"SELECT split, origin_idx, {q(f)} AS feature, round({f} / total, 4) AS importance FROM sums" for f in WINDOW_FEATURES),
    ),
]


def sql(final: str, extra: list[tuple[str, str]] | None = None, linked: str = "edges") -> str:
    """``final`` after the common table expressions it needs, directly or not."""
    tables = {name: body.replace("{table}", linked) for name, body in [*CTES, *(extra or [])]}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(tables[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    # A table stands in ``needed`` after those it is made of.
    return f"WITH {', '.join(f'{n} AS ({tables[n]})' for n in needed)} {final}" if needed else final


def _sequence_rows(within_file: bool = False, slid: bool = False) -> str:
    base = (
        "SELECT t.split, t.split_idx - 1 AS origin_idx, t.target_index, CAST(s.split_idx - (t.split_idx - {n}) AS INTEGER) AS lag, "
        "s.z0, s.z1, s.z2, t.z0 AS next_z0, t.z1 AS next_z1, t.z2 AS next_z2, f.source_file AS first_file, t.source_file AS next_file "
        "FROM states t JOIN states f ON f.split = t.split AND f.split_idx = t.split_idx - {n} "
        "JOIN states s ON s.split = t.split AND s.split_idx BETWEEN {lo} AND {hi}"
    ).format(n=N, lo=f"t.split_idx - {N}" if not slid else f"t.split_idx - {N - 1}", hi="t.split_idx - 1" if not slid else "t.split_idx")
    shift = "lag - 1" if slid else "lag"
    where = " WHERE first_file = next_file" if within_file else ""
    return (
        f"SELECT split, origin_idx, target_index, CAST({shift} AS INTEGER) AS lag, {each(['z0', 'z1', 'z2', 'next_z0', 'next_z1', 'next_z2'])} FROM ({base}){where}"
    )


def _horizon_metrics() -> str:
    names = [f"{m}_{x}" for m in ("forecaster", "baseline") for x in ("macro_f1", "weighted_f1", "macro_precision", "macro_recall", "false_positive_rate")]
    return each(names) + ", " + r("round(gain, 4)") + " AS f1_improvement"


def _evaluation(extra: list[tuple[str, str]] | None = None) -> str:
    return sql(
        f"SELECT horizon, 't+' || horizon AS horizon_label, CAST(horizon * {W} AS BIGINT) AS lead_time_seconds, "
        f"round(horizon * {W} / CAST(60.0 AS DOUBLE), 2) AS lead_time_minutes, {_horizon_metrics()}, "
        + ", ".join(f"(SELECT told FROM class_texts c WHERE c.horizon = compared.horizon AND c.model = {q(m)}) AS {m}_classes" for m in ("forecaster", "baseline"))
        + " FROM compared",
        [
            *(extra or []),
            (
                "class_texts",
                f"SELECT model, horizon, string_agg({class_name('class_index')} || ':' || "
                + " || ':' || ".join(f"CAST(round({c} * 10000) AS BIGINT)" for c in ("precision", "recall", "f1"))
                + " || ':' || support, ',' ORDER BY class_index) AS told FROM class_scores GROUP BY 1, 2",
            ),
        ],
    )


EVALUATION = _evaluation()

FLOW_OUT = ", ".join(
    f"{ts(f.name)} AS {f.name}" if f.name == "timestamp" else (f"{r(f.name)} AS {f.name}" if f.dataType.simpleString() == "double" else f.name)
    for f in FLOW_SCHEMA
)
TYPED = f"(SELECT {typed_fields()} FROM raw WHERE {VALID})"
TYPED_ALL = f"(SELECT {typed_fields()} FROM raw)"

CONVERSATIONS = [
    (
        "talks",
        "SELECT ts, length, syn, protocol, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip ELSE dst_ip END AS ip_a, "
        "CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_ip ELSE src_ip END AS ip_b, "
        "CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_port ELSE dst_port END AS port_a, "
        "CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_port ELSE src_port END AS port_b, "
        "(src_ip, src_port) <= (dst_ip, dst_port) AS from_a FROM packets",
    ),
    (
        "marked",
        "SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= "
        f"{fx.PACKET_TIMEOUT * 1_000_000} THEN 0 ELSE 1 END AS starts, ((epoch_us(ts) // {CELL_US} + 1) - (epoch_us(lag(ts) OVER w) // {CELL_US} + 1)) * {CELL_US} AS cell_gap FROM talks WINDOW w AS (PARTITION BY ip_a, ip_b, port_a, port_b, protocol ORDER BY ts)",
    ),
    (
        "numbered",
        "SELECT *, sum(starts) OVER (PARTITION BY ip_a, ip_b, port_a, port_b, protocol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session, "
        f"sum(CASE WHEN cell_gap <= {GAP_US} THEN 0 ELSE 1 END) OVER (PARTITION BY ip_a, ip_b, port_a, port_b, protocol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS near FROM marked",
    ),
    (
        "closing",
        f"SELECT *, max((epoch_us(ts) // {CELL_US} + 1) * {CELL_US} - 1 + {GAP_US}) OVER (PARTITION BY ip_a, ip_b, port_a, port_b, protocol, near) AS closes, "
        f"max(epoch_us(ts)) OVER () // 1000 * 1000 - {fx.LATENESS * 1_000_000} AS watermark FROM numbered",
    ),
    (
        "sessions",
        "SELECT ip_a, ip_b, port_a, port_b, protocol, session, arg_min(from_a, ts) AS fwd_a, min(ts) AS t0, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, "
        "count(*) AS n, CAST(count(*) FILTER (WHERE from_a) AS DOUBLE) AS pa, CAST(count(*) FILTER (WHERE NOT from_a) AS DOUBLE) AS pb, "
        "CAST(coalesce(sum(length) FILTER (WHERE from_a), 0) AS DOUBLE) AS ba, CAST(coalesce(sum(length) FILTER (WHERE NOT from_a), 0) AS DOUBLE) AS bb, "
        "coalesce(stddev_pop(length), 0.0) AS sd, CAST(count(*) FILTER (WHERE syn) AS DOUBLE) AS syn_count, "
        "CAST(coalesce(sum(gap::HUGEINT * gap) FILTER (WHERE starts = 0), 0) AS HUGEINT) AS gap_sq, max(closes) <= max(watermark) AS closed FROM closing GROUP BY ALL",
    ),
]


def _packet_flows(only: str = "") -> str:
    pick = lambda x, y, out: f"CASE WHEN fwd_a THEN {x} ELSE {y} END AS {out}"
    zero = lambda *names: ", ".join(f"CAST(0.0 AS DOUBLE) AS {n}" for n in names)
    return sql(
        f"SELECT {pick('ip_a', 'ip_b', 'src_ip')}, {pick('ip_b', 'ip_a', 'dst_ip')}, {pick('port_a', 'port_b', 'src_port')}, {pick('port_b', 'port_a', 'dst_port')}, "
        f"protocol, {ts('t0')} AS timestamp, CAST(us AS DOUBLE) AS flow_duration, {pick('pa', 'pb', 'fwd_pkts')}, {pick('pb', 'pa', 'bwd_pkts')}, "
        f"{pick('ba', 'bb', 'fwd_bytes')}, {pick('bb', 'ba', 'bwd_bytes')}, CASE WHEN us > 0 THEN {r('(ba + bb) / (us / CAST(1e6 AS DOUBLE))')} END AS flow_bytes_s, "
        f"CASE WHEN us > 0 THEN {r('n / (us / CAST(1e6 AS DOUBLE))')} END AS flow_pkts_s, CASE WHEN n > 1 THEN {r('us / CAST(n - 1 AS DOUBLE)')} ELSE 0.0 END AS flow_iat_mean, "
        f"{r('(ba + bb) / n')} AS pkt_len_mean, {r('sd')} AS pkt_len_std, "
        f"CASE WHEN n > 1 THEN {r('round(sqrt(greatest(CAST((n - 1) * gap_sq - us::HUGEINT * us AS DOUBLE), 0.0)) / (n - 1), 2)')} ELSE 0.0 END AS flow_iat_std, "
        f"{zero('init_win_fwd', 'init_win_bwd', 'rst_count', 'ack_count', 'fin_count', 'psh_count')}, syn_count, "
        f"'BENIGN' AS label, 'packets' AS source_file FROM sessions {only}",
        CONVERSATIONS,
    )


def _rollout_fixed() -> str:
    """Moving average over the last N states, unrolled over the steps."""
    d = ["z0", "z1", "z2"]
    ctes = [
        (
            "past0",
            "SELECT split, split_idx AS origin_idx, "
            + ", ".join(f"list({z}) OVER w AS {z}" for z in d)
            + f" FROM states WINDOW w AS (PARTITION BY split ORDER BY split_idx ROWS {N - 1} PRECEDING)",
        )
    ]
    for k in range(1, K + 1):
        ctes.append((
            f"past{k}",
            "SELECT split, origin_idx, " + ", ".join(f"list_append({z}, list_avg(list_slice({z}, -{N}, -1))) AS {z}" for z in d) + f" FROM past{k - 1}",
        ))
    ctes.append((
        "forecasts",
        " UNION ALL ".join(
            f"SELECT split, origin_idx, {k} AS step, " + ", ".join(f"{z}[{N + k}] AS {z}" for z in d) + f" FROM past{K}" for k in range(1, K + 1)
        ),
    ))
    logit = lambda c: f"({c} * z0 + {6 - c} * z1 + {c % 3} * z2)"
    ctes.append(("heads", "SELECT split, origin_idx, step, " + ", ".join(f"{logit(c)} AS l{c}" for c in range(N_CLASSES)) + " FROM forecasts WHERE z0 IS NOT NULL"))
    all_l = ", ".join(f"l{c}" for c in range(N_CLASSES))
    total = " + ".join(f"exp(l{c} - greatest({all_l}))" for c in range(N_CLASSES))
    ctes.append(("probs", f"SELECT *, exp(l0 - greatest({all_l})) / ({total}) AS p0, 1.0 / ({total}) AS confidence, list_position([{all_l}], greatest({all_l})) - 1 AS top FROM heads"))
    ctes = [(n, b.replace("FROM past0", f"FROM (SELECT * FROM past0 WHERE len(z0) = {N})")) if n == "past1" else (n, b) for n, b in ctes]
    return sql(
        f"SELECT split, origin_idx, CAST(step AS INTEGER) AS step, 't+' || step AS horizon_label, CAST(top AS INTEGER) AS class_index, {class_name('top')} AS predicted_class, "
        f"{r('confidence')} AS confidence, {r('1.0 - p0')} AS threat_score, {tier('(1.0 - p0)')} AS risk_tier FROM probs",
        ctes,
    )


#: Weight of each state value in the sum of all attack logits under ``queries.fixed_models``, over the history length.
ATTACK = {f"z{j}": sum((c, N_CLASSES - 1 - c, c % 3)[j] for c in range(1, N_CLASSES)) / N for j in range(3)}


def _past_windows() -> list[tuple[str, str]]:
    return [(
        "past",
        f"SELECT o.split, o.split_idx AS origin_idx, s.split_idx - o.split_idx + {N - 1} AS lag, s.z0, s.z1, s.z2 FROM states o "
        f"JOIN states s ON s.split = o.split AND s.split_idx BETWEEN o.split_idx - {N - 1} AND o.split_idx WHERE o.split_idx >= {N - 1}",
    )]


def _shared(parts: str, names: str) -> str:
    share = "round(part / (sum(part) OVER (PARTITION BY split, origin_idx) + CAST(1e-12 AS DOUBLE)), 4)"
    return sql(f"SELECT split, origin_idx, {names}, {r(share)} AS importance FROM ({parts})", _past_windows())


def _temporal_attribution() -> str:
    part = " + ".join(f"CAST({w} AS DOUBLE) * {z}" for z, w in ATTACK.items())
    label = f"CASE WHEN lag < {N - 1} THEN 't-' || ({N - 1} - lag) ELSE 't (Current)' END AS lag_label"
    return _shared(f"SELECT split, origin_idx, lag, abs({part}) AS part FROM past", f"CAST(lag AS INTEGER) AS lag, {label}")


def _feature_attribution() -> str:
    one = "SELECT split, origin_idx, {f} AS feature, abs(sum(CAST({w} AS DOUBLE) * {z})) AS part FROM past GROUP BY split, origin_idx"
    return _shared(" UNION ALL ".join(one.format(f=q(f), w=w, z=z) for f, (z, w) in zip(SIMPLE_FEATURES, ATTACK.items())), "feature")


def _certificates() -> dict[str, str]:
    """What is zero at an optimum, in every cell, and how many rows were fitted."""
    zero = "CAST(0.0 AS DOUBLE)"
    cells = lambda names: ", ".join(f"({q(n)})" for n in names)
    nexts = [("nexts", "SELECT t.target_index AS y FROM series s JOIN series t ON s.split = t.split AND t.split_idx = s.split_idx + 1 WHERE s.split = 'train'")]
    return {
        "baseline_fit": sql(
            f"SELECT CAST(c AS INTEGER) AS class_index, feature, {zero} AS gradient, (SELECT count(*) FROM nexts) AS rows "
            f"FROM (SELECT unnest(range(0, max(y) + 1)) AS c FROM nexts), (VALUES {cells(['intercept', *WINDOW_FEATURES])}) f(feature)",
            nexts,
        ),
        "transition_fit": sql(
            f"SELECT CAST(j AS INTEGER) AS state_dim, CAST(i AS INTEGER) AS lag_dim, {zero} AS residual, (SELECT count(*) - {N} FROM series WHERE split = 'train') AS rows "
            f"FROM range(0, {2 * LAYER_WIDTH}) a(j), range(-1, {2 * LAYER_WIDTH * N}) b(i)"
        ),
        "threat_head_fit": sql(
            f"SELECT CAST(c AS INTEGER) AS class_index, CAST(j AS INTEGER) AS state_dim, {zero} AS gradient, (SELECT count(*) FROM series WHERE split = 'train') AS rows "
            f"FROM range(0, {N_CLASSES}) a(c), range(-1, {2 * LAYER_WIDTH}) b(j)"
        ),
    }


def _literal(numbers) -> str:
    kind = "[][]" if isinstance(numbers[0], list) else "[]"
    return repr(numbers) + "::DOUBLE" + kind


def _stored_tables() -> list[tuple[str, str]]:
    """Encoded windows, and what the stored models make of them: trajectories and baseline predictions."""
    models = fx.stored_coefficients()
    values = ", ".join(f"{_literal(rows)} AS {name}, {_literal(bias)} AS {name}_bias" for name, (rows, bias) in models.items())
    dims = range(LAYER_WIDTH)
    z = ", ".join([*[f"avg(h_{i})" for i in dims], *[f"max(h_{i})" for i in dims]])
    pick = lambda f: f"({f} - avg({f}) FILTER (WHERE split = 'train') OVER ()) / coalesce(nullif(stddev_pop({f}) FILTER (WHERE split = 'train') OVER (), 0), 1.0)"
    linear = lambda name, x: f"list_transform(m.{name}, lambda w, i: list_dot_product(w, {x}) + m.{name}_bias[i])"
    exps = "list_transform(l, lambda x: exp(x - list_max(l)))"
    tables = [
        ("stored", f"SELECT {values}"),
        ("coded", f"SELECT s.split, s.split_idx, r.z FROM (SELECT {KEY}, [{z}]::DOUBLE[] AS z FROM layer2 GROUP BY {KEY}) r JOIN series s USING ({KEY})"),
        ("runs", f"SELECT split, split_idx AS origin_idx, list(z) OVER (PARTITION BY split ORDER BY split_idx ROWS {N - 1} PRECEDING) AS h FROM coded"),
        ("kept0", f"SELECT split, origin_idx, h FROM runs WHERE len(h) = {N}"),
        *[(f"kept{k}", f"SELECT split, origin_idx, list_append(h[2:], {linear('transition', 'flatten(h)')}) AS h FROM kept{k - 1}, stored m") for k in range(1, K + 1)],
        ("ahead", " UNION ALL ".join(f"SELECT split, origin_idx, {k} AS step, h[{N}] AS z FROM kept{k}" for k in range(1, K + 1))),
        ("head_logits", f"SELECT split, origin_idx, step, {linear('head', 'z')} AS l FROM ahead, stored m"),
        ("head_exps", f"SELECT *, {exps} AS e FROM head_logits"),
        (
            "stored_path",
            "SELECT split, origin_idx, CAST(step AS INTEGER) AS step, list_position(l, list_max(l)) - 1 AS class_index, list_max(e) / list_sum(e) AS confidence, "
            f"1.0 - e[1] / list_sum(e) AS threat_score, e[{N_CLASSES}] / list_sum(e) AS p_infiltration FROM head_exps",
        ),
        ("standardised", f"SELECT split, split_idx, [{', '.join(pick(f) for f in WINDOW_FEATURES)}]::DOUBLE[] AS x FROM series"),
        ("base_logits", f"SELECT split, split_idx, {linear('baseline', 'x')} AS l FROM standardised, stored m"),
        ("base_exps", f"SELECT *, {exps} AS e FROM base_logits"),
        ("base_path", "SELECT split, split_idx, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS y_pred, list_max(e) / list_sum(e) AS confidence FROM base_exps"),
    ]
    transition, head = models["transition"][0], models["head"][0]
    attack = [sum(row[j] for c, row in enumerate(head) if c) for j in range(2 * LAYER_WIDTH)]
    weights = [sum(attack[j] * transition[j][i] for j in range(len(attack))) for i in range(len(transition[0]))]
    d = len(attack)
    masked = [[w if i % d % LAYER_WIDTH == f else 0.0 for i, w in enumerate(weights)] for f in range(LAYER_WIDTH)]
    share = "round(part / (sum(part) OVER (PARTITION BY split, origin_idx) + CAST(1e-12 AS DOUBLE)), 4) AS importance"
    lags = " UNION ALL ".join(
        f"SELECT split, origin_idx, {i} AS lag, abs(list_dot_product(h[{i + 1}], {_literal(weights[i * d : (i + 1) * d])})) AS part FROM kept0" for i in range(N)
    )
    features = " UNION ALL ".join(
        f"SELECT split, origin_idx, {q(name)} AS feature, abs(list_dot_product(flatten(h), {_literal(masked[f])})) AS part FROM kept0" for f, name in enumerate(NODE_FEATURES)
    )
    label = f"CASE WHEN lag < {N - 1} THEN 't-' || ({N - 1} - lag) ELSE 't (Current)' END AS lag_label"
    return [
        *tables,
        ("lag_shares", f"SELECT split, origin_idx, CAST(lag AS INTEGER) AS lag, {label}, {share} FROM ({lags})"),
        ("feature_shares", f"SELECT split, origin_idx, feature, {share} FROM ({features})"),
    ]


def _stored_queries() -> dict[str, str]:
    tables = _stored_tables()
    made = (
        "made",
        "SELECT split, origin_idx, 'forecaster' AS model, step, class_index AS y_pred FROM stored_path WHERE split = 'test' "
        "UNION ALL SELECT split, split_idx, 'baseline', step, y_pred FROM base_path, steps WHERE split = 'test'",
    )
    part = lambda x: f"CAST(round({x} * 10000) AS BIGINT)"
    told = [
        (
            "path_text",
            f"SELECT p.split, p.origin_idx, count(*) AS n, string_agg(step || ':+' || (step * {W}) || 's:' || {class_name('p.class_index')} || ':' || {part('confidence')} || ':' || {part('threat_score')} || ':' || "
            f"s.target_category || ':' || CASE WHEN s.target_category = {class_name('p.class_index')} THEN 'MATCH' ELSE 'MISMATCH' END, ',' ORDER BY step) AS trajectory "
            "FROM stored_path p JOIN series s ON s.split = p.split AND s.split_idx = p.origin_idx + p.step GROUP BY 1, 2",
        ),
        (
            "path_risk",
            f"SELECT split, origin_idx, {r4('max(threat_score)')} AS max_threat_score, {r4('avg(threat_score)')} AS mean_threat_score, {tier('max(threat_score)', ' RISK')} AS overall_risk_level, "
            f"{r4('max(p_infiltration)')} AS max_step_infiltration_prob, {r4('1.0 - product(1.0 - p_infiltration)')} AS infiltration_risk_horizon, max(class_index) FILTER (WHERE step = 1) AS first_class FROM stored_path GROUP BY 1, 2",
        ),
        ("ranked_features", "SELECT *, row_number() OVER (PARTITION BY split, origin_idx ORDER BY importance DESC, feature) AS rn FROM feature_shares"),
        ("feature_text", f"SELECT split, origin_idx, string_agg(rn || ':' || feature || ':' || {part('importance')}, ',' ORDER BY rn) AS top_features FROM ranked_features WHERE rn <= 5 GROUP BY 1, 2"),
        ("lag_text", f"SELECT split, origin_idx, string_agg(lag_label || ':' || {part('importance')}, ',' ORDER BY lag) AS past_windows FROM lag_shares GROUP BY 1, 2"),
        ("host_sizes", f"SELECT {KEY}, count(*) AS active_hosts FROM nodes GROUP BY ALL"),
        ("edge_sizes", f"SELECT {KEY}, count(*) AS active_edges FROM edges GROUP BY ALL"),
    ]
    known = ", ".join(
        f"{case(class_name('k.first_class'), {n: v[i] for n, v in KNOWLEDGE.items()}, q(KNOWLEDGE['BENIGN'][i]))} AS {name}" for i, name in enumerate(KNOWLEDGE_FIELDS)
    )
    return {
        "rollout": sql(
            f"SELECT split, origin_idx, step, 't+' || step AS horizon_label, CAST(class_index AS INTEGER) AS class_index, {class_name('class_index')} AS predicted_class, "
            f"{r('confidence')} AS confidence, {r('threat_score')} AS threat_score, {tier('threat_score')} AS risk_tier FROM stored_path",
            tables,
        ),
        "baseline_predict": sql(f"SELECT split, split_idx, y_pred, {r('confidence')} AS confidence FROM base_path", tables),
        "baseline_project": sql("SELECT split, split_idx AS origin_idx, step, y_pred FROM base_path, steps", tables),
        "evaluate_models": _evaluation([*tables, made]),
        "temporal_attribution": sql(f"SELECT split, origin_idx, lag, lag_label, {r('importance')} AS importance FROM lag_shares", tables),
        "feature_attribution": sql(f"SELECT split, origin_idx, feature, {r('importance')} AS importance FROM feature_shares", tables),
        "forecast_report": sql(
            f"SELECT p.split, p.origin_idx, {ts(f'make_timestamp(o.origin_us + s.window_idx * {W * 1_000_000})')} AS start_time, active_hosts, active_edges, s.target_category, "
            f"{each(['max_threat_score', 'mean_threat_score'])}, overall_risk_level, {each(['max_step_infiltration_prob', 'infiltration_risk_horizon'])}, "
            f"'1 - prod(1 - p_k) [Temporally-dependent approximation]' AS infiltration_risk_formula, {known}, p.trajectory, f.top_features, l.past_windows "
            f"FROM path_text p JOIN path_risk k USING (split, origin_idx) JOIN feature_text f USING (split, origin_idx) JOIN lag_text l USING (split, origin_idx) "
            "JOIN series s ON s.split = p.split AND s.split_idx = p.origin_idx JOIN origins o ON o.source_file = s.source_file "
            "JOIN host_sizes h ON h.source_file = s.source_file AND h.window_idx = s.window_idx JOIN edge_sizes e ON e.source_file = s.source_file AND e.window_idx = s.window_idx "
            f"WHERE p.n = {K}",
            [*tables, *told],
        ),
    }


def _transition_line() -> str:
    """Ridge with a penalty of a thousandth of the lag's variance."""
    pairs = "SELECT s.total_bytes AS x, t.total_bytes AS y FROM series s JOIN series t ON s.split = t.split AND t.split_idx = s.split_idx + 1 WHERE s.split = 'train'"
    line = f"SELECT covar_pop(y, x) / (var_pop(x) * CAST(1.001 AS DOUBLE)) AS b, avg(x) AS mx, avg(y) AS my FROM ({pairs})"
    return sql(f"SELECT round(b, 9) AS slope, round(my - b * mx, 3) AS intercept FROM ({line})")


def _dual_loss() -> str:
    pairs = [
        (
            "nexts",
            "SELECT s.z0, s.z1, s.z2, t.z0 AS a0, t.z1 AS a1, t.z2 AS a2, t.target_index AS y FROM states s JOIN states t ON s.split = t.split AND t.split_idx = s.split_idx + 1",
        )
    ]
    logits = lambda z: [f"({c} * {z}0 + {6 - c} * {z}1 + {c % 3} * {z}2)" for c in range(N_CLASSES)]
    weight = case("y", SIMPLE_WEIGHTS, "1.0")

    def ce(z: str) -> str:
        ls = logits(z)
        own = "(CASE y " + " ".join(f"WHEN {c} THEN {x}" for c, x in enumerate(ls)) + " END)"
        return f"sum(CAST({weight} AS DOUBLE) * (ln({' + '.join(f'exp({x})' for x in ls)}) - {own})) / sum(CAST({weight} AS DOUBLE))"

    mse = "avg(((z0 - a0) * (z0 - a0) + (z1 - a1) * (z1 - a1) + (z2 - a2) * (z2 - a2)) / 3.0)"
    return sql(
        f"SELECT {r('m + c')} AS total_loss, {r('m')} AS mse_loss, {r('c')} AS ce_loss FROM (SELECT {mse} AS m, 0.5 * ({ce('z')} + {ce('a')}) AS c FROM nexts)",
        pairs,
    )


def _class_weights() -> str:
    counts = [("counted", "SELECT class_index, count(s.target_index) AS n FROM classes LEFT JOIN (SELECT target_index FROM series WHERE split = 'train') s ON s.target_index = class_index GROUP BY 1")]
    raw = f"sum(n) OVER () / ({N_CLASSES}.0 * greatest(n, 1))"
    return sql(
        f"SELECT class_index, {class_name('class_index')} AS class_name, n, {r(f'least(greatest(CASE WHEN class_index = 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST({raw} AS DOUBLE) END, CAST(0.2 AS DOUBLE)), CAST(5.0 AS DOUBLE))')} AS weight, "
        f"CASE WHEN n > 0 THEN {r('CAST(sum(n) OVER () AS DOUBLE) / ((count(*) FILTER (WHERE n > 0) OVER ()) * n)')} END AS balanced_weight FROM counted",
        counts,
    )


def _stream_windows() -> str:
    body = (
        f"SELECT source_file, (epoch_us(timestamp) // {W * 1_000_000}) AS slot, count(*) AS flow_count, sum(fwd_bytes) + sum(bwd_bytes) AS total_bytes, "
        "sum(fwd_pkts) + sum(bwd_pkts) AS total_pkts, sum(syn_count) AS syn, sum(rst_count) AS rst, avg(flow_duration) AS mean_duration, "
        "count(DISTINCT src_ip) AS n_unique_src, count(DISTINCT dst_ip) AS n_unique_dst, "
        f"{case(f'min({severity(category('label'))})', dict(enumerate(SEVERITY)), q(CLASS_NAMES[0]))} AS target_category FROM flows GROUP BY 1, 2"
    )
    return sql(
        f"SELECT source_file, {ts(f'make_timestamp(slot * {W * 1_000_000})')} AS start_time, {ts(f'make_timestamp((slot + 1) * {W * 1_000_000})')} AS end_time, "
        f"flow_count, {each(['total_bytes', 'total_pkts'])}, {r(ratio('syn', 'total_pkts'))} AS syn_ratio, {r(ratio('rst', 'total_pkts'))} AS rst_ratio, {r('mean_duration')} AS mean_duration, "
        f"n_unique_src, n_unique_dst, target_category, {class_index('target_category')} AS target_index FROM ({body}) "
        f"WHERE (slot + 1) * {W * 1_000_000} <= (SELECT max(epoch_us(timestamp)) // 1000 * 1000 FROM flows) - {fx.LATENESS * 1_000_000}"
    )


def _empty_windows() -> str:
    step = 60_000_000
    ctes = [
        ("minute_idx", f"SELECT f.*, (epoch_us(timestamp) - origin_us) // {step} AS window_idx FROM flows f JOIN origins USING (source_file)"),
        ("minute_pairs", f"SELECT DISTINCT {EDGE} FROM minute_idx"),
        ("minute_ends", f"SELECT {KEY}, src_ip AS ip, dst_ip AS peer, 0.0 AS i, 1.0 AS o FROM minute_pairs UNION ALL SELECT {KEY}, dst_ip, src_ip, 1.0, 0.0 FROM minute_pairs"),
        ("calendar", "SELECT source_file, unnest(range(0, max(window_idx) + 1)) AS window_idx FROM minute_pairs GROUP BY source_file"),
    ]
    return sql(
        f"SELECT {KEY}, coalesce(ip, 'dummy') AS ip, CAST(coalesce(sum(i), 0.0) AS DOUBLE) AS in_degree, CAST(coalesce(sum(o), 0.0) AS DOUBLE) AS out_degree, "
        f"CAST(count(DISTINCT peer) AS DOUBLE) AS peer_count FROM calendar LEFT JOIN minute_ends USING ({KEY}) GROUP BY 1, 2, 3",
        ctes,
    )


def _graph_rows() -> str:
    n = len(NODE_FEATURES)
    values = lambda features: ", ".join(f"{r(f't.{features[i]}') if i < len(features) else 'CAST(NULL AS DOUBLE)'} AS f{i}" for i in range(n))
    part = lambda name, table, ends, features: (
        f"SELECT {q(name)} AS part, s.split, t.source_file, t.window_idx, {ends}, {values(features)} FROM {table} t JOIN series s ON s.source_file = t.source_file AND s.window_idx = t.window_idx"
    )
    return sql(f"{part('nodes', 'scaled_nodes', 't.ip AS host, NULL AS peer', NODE_FEATURES)} UNION ALL {part('edges', 'scaled_edges', 't.src_ip, t.dst_ip', EDGE_FEATURES)}")


def _knowledge() -> str:
    said = "(CASE WHEN step = 5 THEN 'Unheard of' WHEN step = 4 THEN lower(predicted_class) ELSE predicted_class END)"
    cls = f"upper(trim({said}))"
    fields = ", ".join(
        f"{case(cls, {n: v[i] for n, v in KNOWLEDGE.items()}, q(KNOWLEDGE['BENIGN'][i]))} AS {name}" for i, name in enumerate(KNOWLEDGE_FIELDS)
    )
    return sql(f"SELECT split, origin_idx, step, {said} AS predicted_category, {r4('confidence')} AS confidence, {r4('threat_score')} AS threat_score, {fields} FROM threats")


def _audit() -> str:
    one = lambda name, cell: (
        f"SELECT source_file, {q(name)} AS rate_column, trim({cell}) AS token FROM raw WHERE {VALID}"
    )
    return sql(
        "SELECT source_file, rate_column, count(*) FILTER (WHERE token IN ('Infinity', '+Infinity')) AS infinity, count(*) FILTER (WHERE token = '-Infinity') AS negative_infinity, "
        "count(*) FILTER (WHERE token IN ('NaN', 'nan')) AS nan, count(*) FILTER (WHERE token IS NULL) AS null_count, "
        "count(*) FILTER (WHERE token IS NULL OR token IN ('Infinity', '+Infinity', '-Infinity', 'NaN', 'nan')) AS total_problematic "
        f"FROM ({one('flow_bytes_s', 'flow_bytes_s')} UNION ALL {one('flow_pkts_s', 'flow_pkts_s')}) GROUP BY 1, 2"
    )


def _topology(by: str) -> str:
    group = f"{by}, " if by else ""
    v, e = "v", "e"
    body = (
        f"SELECT {group}count(DISTINCT src_ip) AS unique_source_ips, count(DISTINCT dst_ip) AS unique_destination_ips, "
        f"count(DISTINCT src_ip || '>' || dst_ip) AS e, count(*) AS f FROM flows {f'GROUP BY {by}' if by else ''}"
    )
    hosts = (
        f"SELECT {group}count(DISTINCT ip) AS v FROM (SELECT {group}src_ip AS ip FROM flows UNION ALL SELECT {group}dst_ip FROM flows) {f'GROUP BY {by}' if by else ''}"
    )
    join = f"JOIN ({hosts}) h USING ({by})" if by else f"CROSS JOIN ({hosts}) h"
    return sql(
        f"SELECT {group}unique_source_ips, unique_destination_ips, v AS total_unique_hosts, e AS unique_directed_pairs, "
        f"{r(f'CASE WHEN {v} > 1 THEN {e} / (CAST({v} AS DOUBLE) * ({v} - 1)) ELSE 0.0 END')} AS graph_density, "
        f"round(e / CAST(v AS DOUBLE), 2) AS average_out_degree, round(f / CAST(e AS DOUBLE), 2) AS flows_per_edge_ratio FROM ({body}) b {join}"
    )


def _profile() -> str:
    """Every audit over the valid raw rows, joined by capture."""
    token = lambda c: f"trim({c})"
    counts = ", ".join(
        f"count(*) FILTER (WHERE ok AND {token(c)} IN ('Infinity', '+Infinity')) AS {c}_infinity, count(*) FILTER (WHERE ok AND {token(c)} = '-Infinity') AS {c}_negative_infinity, "
        f"count(*) FILTER (WHERE ok AND {token(c)} IN ('NaN', 'nan')) AS {c}_nan, count(*) FILTER (WHERE ok AND {c} IS NULL) AS {c}_null"
        for c in ("flow_bytes_s", "flow_pkts_s")
    )
    ctes = [
        ("checked", f"SELECT *, ({VALID}) AS ok, {clock(parsed('timestamp'))} AS t FROM raw"),
        (
            "totals",
            "SELECT source_file, count(*) AS total_raw_rows, count(*) FILTER (WHERE ok) AS valid_rows, count(*) FILTER (WHERE NOT ok) AS empty_padding_rows, "
            "min(t) FILTER (WHERE ok) AS lo, max(t) FILTER (WHERE ok) AS hi, count(*) FILTER (WHERE ok AND t IS NULL) AS unparsed_timestamp_count, "
            f"{counts}, count(DISTINCT src_ip) FILTER (WHERE ok) AS unique_source_ips, count(DISTINCT dst_ip) FILTER (WHERE ok) AS unique_destination_ips, "
            "count(DISTINCT src_ip || '>' || dst_ip) FILTER (WHERE ok) AS e FROM checked GROUP BY 1",
        ),
        ("label_counts", "SELECT source_file, label, count(*) AS n FROM checked WHERE ok GROUP BY 1, 2"),
        ("label_text", "SELECT source_file, string_agg(label || '=' || n, ',' ORDER BY label) AS label_distribution FROM label_counts GROUP BY 1"),
        ("both_ends", "SELECT source_file, src_ip AS ip FROM checked WHERE ok UNION SELECT source_file, dst_ip FROM checked WHERE ok"),
        ("host_counts", "SELECT source_file, count(*) AS v FROM both_ends GROUP BY 1"),
    ]
    seconds = "((epoch_us(hi) - epoch_us(lo)) / CAST(1e6 AS DOUBLE))"
    audits = ", ".join(f"{c}_{k}" for c in ("flow_bytes_s", "flow_pkts_s") for k in ("infinity", "negative_infinity", "nan", "null"))
    kinds = ("infinity", "negative_infinity", "nan", "null")
    problems = ", ".join(f"{' + '.join(f'{c}_{k}' for k in kinds)} AS {c}_problematic" for c in ("flow_bytes_s", "flow_pkts_s"))
    return sql(
        f"SELECT source_file, {RAW_COLUMNS} AS raw_columns_count, {REPEATED} AS duplicate_columns, total_raw_rows, valid_rows, empty_padding_rows, {ts('lo')} AS min_datetime, {ts('hi')} AS max_datetime, {r(seconds)} AS duration_seconds, "
        f"round({seconds} / 3600.0, 2) AS duration_hours, unparsed_timestamp_count, {audits}, {problems}, label_distribution, unique_source_ips, unique_destination_ips, v AS total_unique_hosts, "
        f"e AS unique_directed_pairs, {r('e / (CAST(v AS DOUBLE) * (v - 1))')} AS graph_density, round(e / CAST(v AS DOUBLE), 2) AS average_out_degree, "
        "round(valid_rows / CAST(e AS DOUBLE), 2) AS flows_per_edge_ratio FROM totals JOIN label_text USING (source_file) JOIN host_counts USING (source_file) "
        f"UNION ALL SELECT source_file, {RAW_COLUMNS}, {REPEATED}, 0, 0, 0, NULL, NULL, 0.0, 0.0, 0, {', '.join(['0'] * 10)}, '', {', '.join(['NULL'] * 7)} FROM (SELECT 'capture_none' AS source_file)",
        ctes,
    )


def _labels() -> str:
    clean = "CASE WHEN label = '' OR label IS NULL THEN 'UNKNOWN' ELSE label END"
    body = (
        f"SELECT source_file, {clean} AS label, count(*) AS n FROM raw WHERE {VALID} GROUP BY 1, 2 UNION ALL SELECT 'ALL', {clean}, count(*) FROM raw WHERE {VALID} GROUP BY 1, 2"
    )
    return sql(f"SELECT source_file, label, n, round(100.0 * n / CAST(sum(n) OVER (PARTITION BY source_file) AS DOUBLE), 4) AS pct FROM ({body})")


def _standard() -> str:
    pick = lambda f: f"({f} - avg({f}) FILTER (WHERE split = 'train') OVER ()) / coalesce(nullif(stddev_pop({f}) FILTER (WHERE split = 'train') OVER (), 0), 1.0)"
    return sql(f"SELECT split, split_idx, {', '.join(f'{r(pick(f))} AS {f}' for f in WINDOW_FEATURES)} FROM series")


def _window_row(features) -> str:
    ints = ("flow_count", "n_unique_src", "n_unique_dst")
    return ", ".join(f if f in ints else f"{r(f)} AS {f}" for f in features)


def _readout(table: str, digits: int) -> str:
    dims = LAYER_WIDTH
    cols = [f"{r(f'avg(h_{i})', digits)} AS z{i}" for i in range(dims)] + [f"{r(f'max(h_{i})', digits)} AS z{dims + i}" for i in range(dims)]
    return f"SELECT {KEY}, {', '.join(cols)} FROM {table} GROUP BY {KEY}"


def _subgraph() -> str:
    hosts = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ip) AS rn FROM nodes) WHERE rn <= 25"
    links = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY src_ip, dst_ip) AS rn FROM edges) WHERE rn <= 40"
    ctes = [("first_hosts", hosts), ("first_links", links)]
    inside = lambda c: f"EXISTS (SELECT 1 FROM first_hosts h WHERE h.source_file = l.source_file AND h.window_idx = l.window_idx AND h.ip = l.{c})"
    return sql(f"SELECT {EDGE} FROM first_links l WHERE {inside('src_ip')} AND {inside('dst_ip')}", ctes)


def oracle_sql() -> dict[str, str]:
    dirty = "' ' || replace(label, '-', [chr(65533), chr(8211), chr(8212)][flow_id % 3 + 1])"
    cleaned = f"trim(replace(replace(replace({dirty}, chr(65533), '-'), chr(8211), '-'), chr(8212), '-'))"
    header_names = {"Flow ID": "flow_id", "Source IP": "src_ip", "Destination IP": "dst_ip", "Source Port": "src_port", "Timestamp": "timestamp", "Label": "label"}
    ranks = ["rank_total_bytes", "rank_flow_count", "rank_syn_count", "rank_dst_port_entropy"]
    range_body = (
        f"SELECT source_file, min(t) AS min_ts, max(t) AS max_ts, count(*) FILTER (WHERE t IS NULL) AS unparsed_timestamp_count "
        f"FROM (SELECT source_file, {clock(parsed('timestamp'))} AS t FROM raw WHERE {VALID}) GROUP BY 1"
    )
    seconds = "coalesce((epoch_us(max_ts) - epoch_us(min_ts)) / CAST(1e6 AS DOUBLE), 0.0)"
    score = "((event_id % 101) / CAST(100.0 AS DOUBLE))"
    step = "CAST(event_id % 5 + 1 AS INTEGER)"
    return {
        "read_flow_csv": sql(f"SELECT {FLOW_OUT.rsplit(', ', 1)[0]} FROM {TYPED}"),
        "read_flow_dir": sql(f"SELECT {FLOW_OUT} FROM {TYPED}"),
        "normalize_headers": sql("SELECT " + ", ".join(f"nullif({c}, '') AS \"{h}\"" for h, c in header_names.items()) + ", source_file FROM raw"),
        "read_raw_untyped": sql("SELECT CAST(event_id AS VARCHAR) AS event_id, flow_bytes_s AS rate_text, timestamp AS time_text FROM raw"),
        "packets_to_flows": _packet_flows(),
        "empty_flows": sql("SELECT source_file, count(*) AS n, sum(fwd_bytes) AS fwd_bytes FROM flows GROUP BY 1"),
        "write_windows": sql(f"SELECT split, {KEY}, {_window_row(WINDOW_FEATURES)}, target_category FROM series"),
        "write_graphs": _graph_rows(),
        "write_json_report": EVALUATION,
        "save_load_fitted": sql(f"SELECT kind, feature, {each(['center', 'scale'])} FROM (SELECT * FROM medians UNION ALL SELECT * FROM scalers)"),
        "valid_rows": sql(f"SELECT event_id, flow_id, timestamp AS ts_txt FROM raw WHERE {VALID}"),
        "null_tokens": sql(f"SELECT event_id, {number('flow_bytes_s')} AS flow_bytes_s FROM raw"),
        "flow_projection": sql(f"SELECT {FLOW_OUT} FROM {TYPED_ALL}"),
        "impute_median": sql(
            "SELECT flow_id, "
            + ", ".join(
                f"{r(f'coalesce({c}, (SELECT center FROM medians WHERE feature = {q(c)}))')} AS {c}" for c in ("flow_bytes_s", "flow_pkts_s", "flow_duration")
            )
            + " FROM flows"
        ),
        "drop_null_timestamp": sql(f"SELECT source_file, src_ip, dst_ip, {ts('timestamp')} AS timestamp, fwd_bytes FROM {TYPED_ALL} WHERE timestamp IS NOT NULL"),
        "parse_timestamp": sql(f"SELECT event_id, {ts(parsed('timestamp'))} AS ts FROM raw"),
        "fix_12h_clock": sql(f"SELECT event_id, {ts(clock('t'))} AS ts FROM (SELECT event_id, {parsed('timestamp')} AS t FROM raw)"),
        "sanitize_label": sql(
            f"SELECT flow_id, {cleaned} AS clean, CASE WHEN flow_id % 7 = 0 THEN 'UNKNOWN' ELSE {cleaned} END AS profile_clean FROM flows"
        ),
        "label_category": sql(f"SELECT flow_id, CASE WHEN flow_id % 31 = 0 THEN 'BENIGN' ELSE {category('label')} END AS category FROM flows"),
        "category_index": sql(f"SELECT flow_id, {class_index(category('label'))} AS class_index, {category('label')} AS class_name FROM flows"),
        "window_index": sql("SELECT flow_id, source_file, window_idx FROM indexed"),
        "window_bounds": sql(
            f"SELECT DISTINCT {KEY}, {ts(f'make_timestamp(origin_us + window_idx * {W * 1_000_000})')} AS start_time, {ts(f'make_timestamp(origin_us + (window_idx + 1) * {W * 1_000_000})')} AS end_time FROM indexed"
        ),
        "shannon_entropy": sql(
            f"SELECT source_file, {r('-sum(p * log2(p + CAST(1e-12 AS DOUBLE)))')} AS entropy FROM (SELECT source_file, c / CAST(sum(c) OVER (PARTITION BY source_file) AS DOUBLE) AS p "
            "FROM (SELECT source_file, dst_port, count(*) AS c FROM flows GROUP BY 1, 2)) GROUP BY 1"
        ),
        "softmax_threat": sql(f"SELECT event_id, {each([f'p{c}' for c in range(N_CLASSES)])}, {r('1.0 - p0')} AS threat FROM softmax"),
        "top_class": sql(
            f"SELECT event_id, CAST(top AS INTEGER) AS class_index, {class_name('top')} AS class_name, {r('best')} AS confidence, {r('p0')} AS p_benign, {r('p6')} AS p_infiltration FROM "
            f"(SELECT *, greatest({', '.join(f'p{c}' for c in range(N_CLASSES))}) AS best, list_position([{', '.join(f'l{c}' for c in range(N_CLASSES))}], m) - 1 AS top FROM softmax)"
        ),
        "risk_tier": f"SELECT event_id, {tier(score)} AS tier, {tier(score, ' RISK')} AS horizon_tier FROM events",
        "lead_time": f"SELECT event_id, 't+' || {step} AS horizon_label, CAST({step} * {W} AS BIGINT) AS lead_time_seconds, round({step} * {W} / CAST(60.0 AS DOUBLE), 2) AS lead_time_minutes FROM events",
        "fit_medians": sql(f"SELECT kind, feature, {each(['center', 'scale'])} FROM medians"),
        "window_stats": sql(f"SELECT {KEY}, {_window_row(WINDOW_FEATURES)} FROM windows"),
        "window_target": sql(f"SELECT {KEY}, target_category, {class_index('target_category')} AS target_index FROM windows"),
        "window_label_counts": sql(f"SELECT {KEY}, label, count(*) AS n FROM indexed GROUP BY {KEY}, label"),
        "edge_features": sql(f"SELECT {EDGE}, {each(EDGE_FEATURES)} FROM edges"),
        "port_entropy": sql(f"SELECT {EDGE}, {r('dst_port_entropy')} AS dst_port_entropy FROM entropies"),
        "node_features": sql(f"SELECT {KEY}, ip, {each(NODE_FEATURES)} FROM nodes"),
        "rst_by_source": sql(f"SELECT {KEY}, src_ip, sum(rst_count) AS rst_sum FROM indexed GROUP BY {KEY}, src_ip"),
        "fit_robust_scaler": sql(f"SELECT kind, feature, {each(['center', 'scale'])} FROM scalers"),
        "apply_robust_scaler": sql(f"SELECT {KEY}, ip, {each(NODE_FEATURES)} FROM scaled_nodes"),
        "standard_scale": _standard(),
        "file_profile": sql(
            f"SELECT source_file, true AS has_size, {RAW_COLUMNS} AS raw_columns_count, {REPEATED} AS duplicates, count(*) AS total_raw_rows, count(*) FILTER (WHERE {VALID}) AS valid_rows, "
            f"count(*) - count(*) FILTER (WHERE {VALID}) AS empty_padding_rows FROM raw GROUP BY 1 "
            f"UNION ALL SELECT source_file, true, {RAW_COLUMNS}, {REPEATED}, 0, 0, 0 FROM (SELECT 'capture_none' AS source_file)"
        ),
        "inf_nan_audit": _audit(),
        "time_range_audit": sql(
            f"SELECT source_file, {ts('min_ts')} AS min_ts, {ts('max_ts')} AS max_ts, unparsed_timestamp_count, {r(seconds)} AS duration_seconds, round({seconds} / 3600.0, 2) AS duration_hours FROM ({range_body})"
        ),
        "label_distribution": _labels(),
        "topology_profile": _topology("source_file"),
        "topology_global": _topology(""),
        "dataset_summary": sql(
            f"SELECT count(DISTINCT source_file) + 1 AS total_files, count(*) AS total_raw_lines, count(*) FILTER (WHERE {VALID}) AS total_valid_rows, "
            f"count(*) - count(*) FILTER (WHERE {VALID}) AS total_padding_rows, count(DISTINCT label) FILTER (WHERE {VALID}) AS unique_classes FROM raw"
        ),
        "split_class_counts": sql("SELECT split, target_category, count(*) AS n FROM series GROUP BY 1, 2"),
        "class_weights": _class_weights(),
        "confusion_matrix": sql("SELECT * FROM confusion"),
        "class_metrics": sql(f"SELECT model, horizon, class_index, {class_name('class_index')} AS class_name, {each(['precision', 'recall', 'f1'])}, support, predicted FROM class_scores"),
        "macro_metrics": sql(f"SELECT model, horizon, {each(['macro_f1', 'weighted_f1', 'macro_precision', 'macro_recall'])} FROM macro"),
        "false_positive_rate": sql(f"SELECT model, horizon, {r('false_positive_rate')} AS false_positive_rate FROM alarms"),
        "horizon_risk": sql(
            f"SELECT split, origin_idx, {r4('max(threat_score)')} AS max_threat_score, {r4('avg(threat_score)')} AS mean_threat_score, {tier('max(threat_score)', ' RISK')} AS overall_risk_level, "
            f"{r4('max(p_infiltration)')} AS max_step_infiltration_prob, {r4('1.0 - product(1.0 - p_infiltration)')} AS infiltration_risk_horizon, "
            "'1 - prod(1 - p_k) [Temporally-dependent approximation]' AS infiltration_risk_formula FROM threats GROUP BY 1, 2"
        ),
        "dual_loss": _dual_loss(),
        "chrono_split": sql(f"SELECT {KEY}, split FROM split_windows"),
        "train_flow_slice": sql("SELECT flow_id, source_file FROM train_flows"),
        "reindex_split": sql(f"SELECT split, split_idx, {KEY} FROM series"),
        "sequences": sql(_sequence_rows()),
        "sequences_within_file": sql(_sequence_rows(within_file=True)),
        "next_step_pairs": sql(
            f"SELECT * FROM (SELECT split, split_idx, {_window_row(WINDOW_FEATURES)}, lead(target_index) OVER (PARTITION BY split ORDER BY split_idx) AS next_index FROM series) WHERE next_index IS NOT NULL"
        ),
        "horizon_pairs": sql("SELECT * FROM scored"),
        "normalized_rank": sql(f"SELECT {EDGE}, {each(ranks)} FROM ranked"),
        "slide_state": sql(_sequence_rows(slid=True)),
        "priority_edge_sample": sql(f"SELECT {EDGE}, flow_count, total_bytes FROM sampled"),
        "top_features": sql(
            "SELECT split, origin_idx, CAST(rank AS INTEGER) AS rank, feature, importance FROM (SELECT *, row_number() OVER (PARTITION BY split, origin_idx ORDER BY importance DESC, feature) AS rank FROM shares) WHERE rank <= 5",
            SHARES,
        ),
        "window_subgraph": _subgraph(),
        "window_graph_sampled": sql(f"SELECT {EDGE}, src_idx, dst_idx, {each(EDGE_FEATURES)} FROM scaled_edges", linked="sampled"),
        "node_index": sql(f"SELECT {EDGE}, src_idx, dst_idx FROM linked", linked="edges"),
        "attack_knowledge": _knowledge(),
        "forecast_vs_actual": sql(
            f"SELECT p.split, p.origin_idx, p.step, 't+' || p.step AS horizon_label, '+' || (p.step * {W}) || 's' AS lead_time, predicted_class, {r('confidence')} AS confidence, {r('threat_score')} AS threat_score, "
            "s.target_category AS actual_class, CASE WHEN s.target_category = predicted_class THEN 'MATCH' ELSE 'MISMATCH' END AS outcome "
            "FROM threats p JOIN series s ON p.split = s.split AND s.split_idx = p.origin_idx + p.step"
        ),
        "model_comparison": sql(f"SELECT horizon, {_horizon_metrics()} FROM compared"),
        "profile_report": _profile(),
        "host_union": sql("SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows"),
        "pair_distinct": sql("SELECT DISTINCT src_ip, dst_ip FROM flows"),
        "concat_slices": sql("SELECT source_file, count(*) AS n, sum(fwd_bytes) AS fwd_bytes FROM train_flows GROUP BY 1"),
        "window_graph_nodes": sql(f"SELECT {KEY}, ip, node_idx, {each(NODE_FEATURES)} FROM scaled_nodes"),
        "window_graph": sql(f"SELECT {EDGE}, src_idx, dst_idx, {each(EDGE_FEATURES)} FROM scaled_edges"),
        "self_loops": sql(
            f"SELECT {EDGE}, {each(EDGE_FEATURES)} FROM edges UNION ALL SELECT {KEY}, ip, ip, {', '.join('CAST(0.0 AS DOUBLE)' for _ in EDGE_FEATURES)} FROM nodes"
        ),
        "empty_window_node": _empty_windows(),
        "message_pass": sql(f"SELECT {KEY}, ip, {each([f'h_{i}' for i in range(LAYER_WIDTH)])} FROM layer2"),
        "graph_readout": sql(
            _readout("plain", 6), [("plain", f"SELECT {KEY}, {', '.join(f'{f} AS h_{i}' for i, f in enumerate(NODE_FEATURES))} FROM nodes")]
        ),
        "encode_windows": sql(_readout("layer2", 6)),
        "window_overview": sql(
            f"SELECT w.source_file, w.window_idx, {ts(f'make_timestamp(origin_us + w.window_idx * {W * 1_000_000})')} AS start_time, target_category, "
            f"(SELECT count(*) FROM nodes n WHERE n.source_file = w.source_file AND n.window_idx = w.window_idx) AS active_hosts, "
            f"(SELECT count(*) FROM edges e WHERE e.source_file = w.source_file AND e.window_idx = w.window_idx) AS active_edges FROM windows w"
        ),
        "evaluate_horizons": EVALUATION,
        "rollout_fixed": _rollout_fixed(),
        "transition_fit_line": _transition_line(),
        "temporal_attribution_fixed": _temporal_attribution(),
        "feature_attribution_fixed": _feature_attribution(),
        **_stored_queries(),
        **_certificates(),
        "stream_window_stats": _stream_windows(),
        "stream_packets_to_flows": _packet_flows("WHERE closed"),
    }
