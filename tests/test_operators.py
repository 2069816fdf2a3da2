from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.functions import labels, threat, values
from flowtide.operators import attribution, cleaning, encode, forecast, graphs, metrics, profile, risk, sampling, scaling, sequences, windows
from flowtide.plans.materialise import materialise
from flowtide.schema import CLASS_NAMES, EDGE_FEATURES, NODE_FEATURES, WINDOW_FEATURES, WINDOW_KEY
from flowtide.sources import storage
from flowtide.sources.captures import empty_flows
from tests.conftest import make_flows


def pairs_of(spark, rows, seconds=30):
    return materialise(graphs.pair_totals(windows.window_index(make_flows(spark, rows), seconds)))


def test_timestamps_and_tokens(spark):
    cells = ["7/7/2017 3:30", "03/07/2017 08:55:58", " 2017-07-03 12:59 ", "2017-7-3 7:59:59", "12:59", "x", "1/2/3/4 5:6", "2017-13-40 1:1", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(values.fix_12h_clock(values.parse_timestamp(F.col("c")))).collect()]
    assert got[:4] == [datetime(2017, 7, 7, 15, 30), datetime(2017, 7, 3, 8, 55, 58), datetime(2017, 7, 3, 12, 59), datetime(2017, 7, 3, 19, 59, 59)]
    assert got[4:] == [None] * 6
    numbers = spark.createDataFrame([(c,) for c in ["1.5", "+Infinity", "nan", "null", "", "abc", None]], "c string")
    assert [r[0] for r in numbers.select(values.to_number(F.col("c"))).collect()] == [1.5] + [None] * 6


def test_labels(spark):
    df = spark.createDataFrame([("Web Attack � XSS",), ("Web Attack – Brute Force",), ("nope",), ("",), (None,)], "l string")
    rows = df.select(labels.label_category(F.col("l")), labels.profile_label(F.col("l"))).collect()
    assert [r[0] for r in rows] == ["WEB_EXPLOIT", "BRUTE_FORCE", "BENIGN", "BENIGN", "BENIGN"]
    assert [r[1] for r in rows][2:] == ["nope", "UNKNOWN", "UNKNOWN"]


def test_tiers_and_top_class(spark):
    df = spark.createDataFrame([(x,) for x in (0.70, 0.30, 0.2999)], "t double")
    assert [r[0] for r in df.select(threat.risk_tier(F.col("t"))).collect()] == ["CRITICAL / HIGH", "ELEVATED / MEDIUM", "NOMINAL / LOW"]
    p = threat.softmax(F.array(*[F.lit(x) for x in (900.0, 900.0, 1.0, 0.0, 0.0, 0.0, -900.0)]))
    row = spark.range(1).select(threat.top_index(p), threat.threat_score(p), threat.array_sum(p)).first()
    assert row[0] == 0 and row[1] == pytest.approx(0.5) and row[2] == pytest.approx(1.0)


def test_window_edges_of_time(spark):
    start = datetime(2017, 7, 3, 9, 0, 0, 500_000)
    at = lambda s, **k: dict(timestamp=start + timedelta(seconds=s), **k)
    rows = [
        at(0), at(29.999999, label="Infiltration"), at(30, src_ip="b", dst_ip="b", fwd_pkts=2.0, syn_count=1.0), at(100),
        dict(timestamp=datetime(2017, 7, 4), source_file="g.csv"), dict(timestamp=None),
    ]
    out = {(r.source_file, r.window_idx): r for r in windows.build_windows(pairs_of(spark, rows), 30).collect()}
    assert sorted(out) == [("f.csv", 0), ("f.csv", 1), ("f.csv", 3), ("g.csv", 0)]
    first, second = out["f.csv", 0], out["f.csv", 1]
    assert first.target_category == "INFILTRATION" and first.target_index == 6 and first.syn_ratio == 0.0
    assert first.start_time == start and first.end_time == start + timedelta(seconds=30)
    assert second.syn_ratio == 0.5 and second.n_unique_src == 1 and second.mean_duration == 0.0


def test_windows_from_flows_are_those_from_pairs(spark, flows):
    """Missing hosts, numbers and labels, repeated ports and loops: every window as its pair totals give it."""
    at = lambda s: datetime(2017, 7, 3, 9, 0, s)
    odd = [
        dict(timestamp=at(0), src_ip=None, flow_duration=None, fwd_bytes=None, label="DDoS"),
        dict(timestamp=at(1), src_ip=None, dst_ip=None, fwd_bytes=2.0, bwd_bytes=3.0, flow_duration=7.0, label=None),
        dict(timestamp=at(31), dst_port=1, fwd_pkts=4.0, syn_count=1.0, rst_count=3.0, label="Bot"),
        dict(timestamp=at(32), dst_port=1, src_ip="b", bwd_pkts=None, rst_count=None, flow_duration=5.0),
        dict(timestamp=at(33), dst_port=2, dst_ip="a"),
        dict(timestamp=None, label="Infiltration"),
    ]
    for found, seconds in ((make_flows(spark, odd), 30), (flows, 7200)):
        indexed = windows.window_index(found, seconds)
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        want = windows.build_windows(materialise(graphs.pair_totals(indexed)), seconds)
        got = windows.build_flow_windows(indexed, seconds)
        assert got.dtypes == want.dtypes and rows(got) == rows(want) != []


def test_windows_and_baseline_need_no_pair_table(spark, monkeypatch):
    """Flows are neither grouped by pair and port nor sorted by pair for what only windows are needed for."""
    from flowtide.queries import QUERIES, Tables
    from tests.conftest import SF

    def refuse(indexed):
        raise AssertionError("pair totals are made")

    monkeypatch.setattr(Tables, "_all", {})
    monkeypatch.setattr(graphs, "pair_totals", refuse)
    assert QUERIES["baseline_predict_fitted"](spark, SF).count() == QUERIES["window_stats"](spark, SF).count() > 0


def test_graph_features_by_hand(spark):
    rows = [
        dict(dst_port=1, fwd_bytes=10.0, bwd_bytes=5.0, fwd_pkts=1.0, syn_count=1.0, rst_count=1.0, flow_duration=4.0),
        dict(dst_port=2, fwd_pkts=1.0, flow_duration=8.0),
        dict(src_ip="b", dst_ip="a", fwd_bytes=1.0, bwd_pkts=2.0),
        dict(src_ip="a", dst_ip="a", fwd_bytes=3.0),
    ]
    pairs = pairs_of(spark, rows)
    edges = {(r.src_ip, r.dst_ip): r for r in graphs.edge_features(pairs).collect()}
    assert edges["a", "b"].dst_port_entropy == pytest.approx(1.0) and edges["b", "a"].dst_port_entropy == 0.0
    assert edges["a", "b"].mean_duration == 6.0 and edges["a", "b"].flow_count == 2.0
    nodes = {r.ip: r for r in graphs.node_features(pairs).collect()}
    a, b = nodes["a"], nodes["b"]
    assert (a.in_degree, a.out_degree, a.peer_count) == (2.0, 2.0, 2.0)
    assert (a.in_bytes, a.out_bytes, b.in_bytes, b.out_bytes) == (4.0, 18.0, 15.0, 1.0)
    assert a.syn_ratio == pytest.approx(1 / (4 + 1e-6)) and a.rst_ratio == pytest.approx(1 / (4 + 1e-6)) and b.rst_ratio == 0.0
    loops = graphs.self_loops(graphs.edge_features(pairs), graphs.node_features(pairs))
    assert loops.count() == 3 + 2 and loops.where("src_ip = 'a' AND dst_ip = 'a'").count() == 2


def test_graph_invariants(tables):
    edges, nodes, windows_ = tables.edges, tables.nodes, tables.windows
    e = edges.agg(F.count("*"), F.sum("flow_count"), F.sum("total_bytes")).first()
    n = nodes.agg(F.sum("out_degree"), F.sum("in_degree"), F.sum("out_bytes"), F.sum("in_bytes")).first()
    assert e[1] == tables.flows.count() == windows_.agg(F.sum("flow_count")).first()[0]
    assert n[0] == n[1] == e[0] and n[2] == n[3] == e[2]
    sizes = {r.split: r["count"] for r in tables.series.groupBy("split").count().collect()}
    assert sum(sizes.values()) == windows_.count()


def test_sampling_limits_and_hot_path(tables):
    edges = tables.edges
    sizes = edges.groupBy(*WINDOW_KEY).count()
    top = sizes.agg(F.max("count")).first()[0]
    assert sampling.priority_edge_sample(edges, top).count() == edges.count()
    limit = top - 2
    plain = sampling.priority_edge_sample(edges, limit)
    hot = sampling.priority_edge_sample(edges, limit, hot_rows=limit)
    key = lambda df: sorted(map(tuple, df.select(*graphs.EDGE_KEY).collect()))
    assert key(plain) == key(hot)
    assert plain.groupBy(*WINDOW_KEY).count().agg(F.max("count")).first()[0] == limit


def test_sampling_matches_brute_force(tables):
    limit = 3
    rows = tables.edges.collect()
    kept = {(r.source_file, r.window_idx, r.src_ip, r.dst_ip) for r in sampling.priority_edge_sample(tables.edges, limit).collect()}
    by_window = {}
    for r in rows:
        by_window.setdefault((r.source_file, r.window_idx), []).append(r)
    want = set()
    for (f, w), es in by_window.items():
        score = {}
        for name, weight in sampling.PRIORITY_WEIGHTS:
            for i, e in enumerate(sorted(es, key=lambda e: (e[name], e.src_ip, e.dst_ip))):
                score[e.src_ip, e.dst_ip] = score.get((e.src_ip, e.dst_ip), 0.0) + weight * i / (len(es) - 1 + 1e-6)
        best = sorted(score, key=lambda k: (-score[k], k)) if len(es) > limit else list(score)
        want |= {(f, w, *k) for k in best[: limit if len(es) > limit else None]}
    assert kept == want


def test_scaler_zero_range_and_unfitted(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    stats = cleaning.fitted_values(scaling.fit_robust_scaler(df, ["x", "y"], "k"), "k")
    assert stats == {"x": (2.0, 1.0), "y": (5.0, 1.0)}
    assert [tuple(r) for r in scaling.apply_robust_scaler(df, stats, ["x", "y"]).collect()] == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    assert scaling.apply_robust_scaler(df, None, ["x"]).collect() == df.collect()


def test_medians_and_imputation(spark):
    flows = make_flows(spark, [dict(flow_bytes_s=1.0), dict(flow_bytes_s=4.0), dict(), dict(timestamp=None)])
    stats = cleaning.fit_medians(flows)
    values_ = cleaning.fitted_values(stats, "flow_median")
    assert values_["flow_bytes_s"][0] == 2.5 and values_["flow_pkts_s"][0] == 0.0
    assert sorted(r.flow_bytes_s for r in cleaning.impute_median(flows, stats).collect()) == [1.0, 2.5, 4.0]
    assert cleaning.impute_median(flows, None).where("flow_bytes_s IS NULL").count() == 1


@pytest.mark.parametrize("copies", [1, 50])
def test_train_slice_counts_with_ties(spark, copies):
    stamp = datetime(2017, 7, 3, 9)
    rows = [dict(timestamp=stamp + timedelta(seconds=i // 7), fwd_bytes=float(i // copies)) for i in range(333)]
    flows = make_flows(spark, rows)
    out = cleaning.train_flow_slice(flows, ["fwd_bytes"])
    assert sorted(r.fwd_bytes for r in out.collect()) == sorted(float(i // copies) for i in range(int(0.7 * 333)))


def test_split_of_90_windows(spark):
    rows = [dict(timestamp=datetime(2017, 7, 3, 9) + timedelta(seconds=30 * i)) for i in range(90)]
    w = materialise(windows.build_windows(pairs_of(spark, rows), 30))
    for hot in (10**6, 20):
        split = sequences.chrono_split(w, hot_rows=hot)
        assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 62, "val": 13, "test": 15}
        series = sequences.reindex_split(split, hot_rows=hot)
        got = [r.window_idx for r in series.where("split = 'test'").orderBy("split_idx").collect()]
        assert got == list(range(75, 90))


def test_sequences_block_size_does_not_matter(tables):
    state = F.array("syn_ratio", "rst_ratio")
    small = sequences.sequences(tables.series, state, 10, block_rows=11)
    large = sequences.sequences(tables.series, state, 10)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
    sizes = {r.split: r["count"] for r in tables.series.groupBy("split").count().collect()}
    assert {r.split: r["count"] for r in large.groupBy("split").count().collect()} == {s: n - 10 for s, n in sizes.items()}


def test_horizon_pairs_lose_one_origin(tables):
    from flowtide.queries import simple_pairs

    n = tables.series.where("split = 'test'").count()
    got = simple_pairs(tables.series).where("split = 'test' AND model = 'baseline'")
    assert got.count() == 5 * (n - 10 - 5)


def test_class_metrics_by_hand(spark):
    pairs = spark.createDataFrame([("m", 1, 0, 0), ("m", 1, 0, 3), ("m", 1, 3, 3), ("m", 1, 5, 0)], "model string, horizon int, y_true int, y_pred int")
    confusion = metrics.confusion_matrix(pairs)
    per = {r.class_name: r for r in metrics.class_metrics(confusion).collect()}
    assert len(per) == 7 and per["BOTNET"].f1 == 0.0 and per["BOTNET"].support == 1 and per["INFILTRATION"].support == 0
    assert per["BENIGN"].precision == 0.5 and per["WEB_EXPLOIT"].recall == 1.0 and per["WEB_EXPLOIT"].f1 == pytest.approx(2 / 3)
    macro = metrics.macro_metrics(metrics.class_metrics(confusion)).first()
    assert macro.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert metrics.false_positive_rate(confusion).first().false_positive_rate == 0.5


def test_horizon_risk_edges(spark):
    steps = [("s", 0, k, 0.5, {"INFILTRATION": p}) for k, p in ((1, 0.1), (2, 0.2))] + [("s", 1, 1, 0.7, {})]
    t = spark.createDataFrame(steps, "split string, origin_idx long, step int, threat_score double, class_probabilities map<string,double>")
    origins = spark.createDataFrame([("s", 0), ("s", 1), ("s", 2)], "split string, origin_idx long")
    out = {r.origin_idx: r for r in risk.horizon_risk(t, origins).collect()}
    assert out[0].infiltration_risk_horizon == 0.28 and out[0].overall_risk_level == "ELEVATED / MEDIUM RISK"
    assert out[1].overall_risk_level == "CRITICAL / HIGH RISK" and out[1].infiltration_risk_horizon == 0.0
    assert out[2].overall_risk_level == "NOMINAL / LOW" and out[2].infiltration_risk_formula == "N/A"


def test_every_operator_accepts_no_rows(spark):
    flows = empty_flows(spark)
    pairs = pairs_of(spark, [])
    w = materialise(windows.build_windows(pairs, 30))
    nodes, edges = graphs.window_graph(pairs)
    series = materialise(sequences.reindex_split(sequences.chrono_split(w)))
    assert [x.count() for x in (w, nodes, edges, series)] == [0, 0, 0, 0]
    assert sequences.sequences(series, F.array("syn_ratio")).count() == 0
    assert encode.encode_windows(nodes, edges).count() == 0
    assert cleaning.train_flow_slice(flows, ["fwd_bytes"]).count() == 0
    assert {r.center for r in cleaning.fit_medians(flows).collect()} == {0.0}
    assert profile.topology_profile(flows).count() == 0 and profile.host_union(flows).count() == 0
    assert scaling.fit_robust_scaler(edges, EDGE_FEATURES, "k").count() == 0


def dense_messages(nodes, edges):
    """Two layers in the identity form with plain matrices, one window at a time."""
    out = {}
    for key, hosts in nodes.items():
        h = np.array([list(hosts[ip]) for ip in sorted(hosts)])
        pos = {ip: i for i, ip in enumerate(sorted(hosts))}
        for _ in range(2):
            total = h.copy()
            for src, dst, e in edges.get(key, []):
                total[pos[dst]] += np.maximum(h[pos[src]] + np.pad(e, (0, 2)), 0)
            h = np.maximum(total, 0)
        out[key] = np.concatenate([h.mean(axis=0), h.max(axis=0)])
    return out


@pytest.mark.parametrize("hot_degree", [10**6, 1])
def test_encoding_matches_dense_form(tables, hot_degree):
    nodes_df, edges_df = tables.graph
    nodes, edges = {}, {}
    for r in nodes_df.collect():
        nodes.setdefault((r.source_file, r.window_idx), {})[r.ip] = [r[f] for f in NODE_FEATURES]
    for r in edges_df.collect():
        edges.setdefault((r.source_file, r.window_idx), []).append((r.src_ip, r.dst_ip, np.array([r[f] for f in EDGE_FEATURES])))
    want = dense_messages(nodes, edges)
    got = encode.encode_windows(nodes_df, edges_df, hot=encode.hot_sources(edges_df, hot_degree)).collect()
    assert len(got) == len(want)
    for r in got:
        np.testing.assert_allclose(r.z, want[r.source_file, r.window_idx], rtol=1e-9, atol=1e-9)


def test_weighted_layers(spark):
    nodes = spark.createDataFrame([("f", 0, ip, *[float(i + j) for j in range(9)]) for i, ip in enumerate("ab")], "source_file string, window_idx long, ip string, " + ", ".join(f"{f} double" for f in NODE_FEATURES))
    edges = spark.createDataFrame([("f", 0, "a", "b", *[float(j) for j in range(7)])], "source_file string, window_idx long, src_ip string, dst_ip string, " + ", ".join(f"{f} double" for f in EDGE_FEATURES))
    rng = np.random.default_rng(1)
    we, wn, bias = rng.normal(size=(9, 7)), rng.normal(size=(4, 9)), rng.normal(size=4)
    layer = encode.Layer(we.tolist(), wn.tolist(), bias.tolist(), 0.5)
    got = {r.ip: [r[f"h_{i}"] for i in range(4)] for r in encode.message_pass(nodes, edges, [layer]).collect()}
    xa, xb, e = np.arange(9.0), np.arange(9.0) + 1, np.arange(7.0)
    message = np.maximum(xa + np.maximum(we @ e, 0), 0)
    np.testing.assert_allclose(got["a"], np.maximum(wn @ (1.5 * xa) + bias, 0), atol=1e-12)
    np.testing.assert_allclose(got["b"], np.maximum(wn @ (1.5 * xb + message) + bias, 0), atol=1e-12)


def test_transition_is_ridge_solution(spark):
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(80, 6)) * [1, 10, 0.1, 5, 1, 0] + 3, rng.normal(size=(80, 2)) * 0.1
    y = x[:, :2] * 0.5 + x[:, 4:] @ np.array([[1.0, 0.0], [0.0, 1.0]]) + noise
    rows = [("train", i, x[i].reshape(3, 2).tolist(), y[i].tolist(), 0) for i in range(80)]
    seqs = spark.createDataFrame(rows, "split string, origin_idx long, history array<array<double>>, target_z array<double>, target_index int")
    fit = forecast.transition_fit(seqs, 2, 3, reg=0.01)
    xc, yc = x - x.mean(0), y - y.mean(0)
    var = xc.var(0)
    a = xc.T @ xc / 80 + np.diag(np.where(var > 1e-12, 0.01 * var, 1.0))
    want = np.linalg.solve(a, xc.T @ yc / 80).T
    np.testing.assert_allclose(fit.rows, want, atol=1e-6)
    np.testing.assert_allclose(fit.bias, y.mean(0) - want @ x.mean(0), atol=1e-5)


def test_transition_fit_far_from_zero(spark):
    rng = np.random.default_rng(7)
    x = 1e8 + rng.uniform(-1, 1, size=400)
    rows = [("train", i, [[float(v)]], [float(2 * v)]) for i, v in enumerate(x)]
    seqs = spark.createDataFrame(rows, "split string, origin_idx long, history array<array<double>>, target_z array<double>")
    assert forecast.transition_fit(seqs, 1, 1, reg=0.0).rows[0][0] == pytest.approx(2.0, abs=1e-6)


def test_white_space_of_any_kind_is_no_text(spark):
    from flowtide.functions.values import has_text, strip

    df = spark.createDataFrame([("\t",), (" \u00a0\n",), ("\tx ",)], "c string")
    got = df.select(has_text(df["c"]).alias("t"), strip(df["c"]).alias("s")).collect()
    assert [tuple(r) for r in got] == [(False, ""), (False, ""), (True, "x")]


def test_rollout_and_attribution_match_brute_force(spark):
    rng = np.random.default_rng(5)
    n, d = 4, 3
    model = forecast.Transition(rng.normal(size=(d, n * d)).tolist(), rng.normal(size=d).tolist(), n)
    head = forecast.ThreatHead(rng.normal(size=(7, d)).tolist(), rng.normal(size=7).tolist())
    past = rng.normal(size=(6, n, d))
    df = spark.createDataFrame([("s", i, past[i].tolist()) for i in range(6)], "split string, origin_idx long, history array<array<double>>")
    got = {(r.origin_idx, r.step): r for r in forecast.rollout(df, model, head, 3).collect()}
    a, b, h, c = map(np.array, (model.rows, model.bias, head.rows, head.bias))
    for i in range(6):
        seq = list(past[i])
        for k in range(1, 4):
            z = a @ np.concatenate(seq[-n:]) + b
            seq.append(z)
            p = np.exp(h @ z + c - (h @ z + c).max())
            p /= p.sum()
            r = got[i, k]
            np.testing.assert_allclose(r.state, z, rtol=1e-9)
            assert r.class_index == p.argmax() and r.confidence == pytest.approx(p.max()) and r.threat_score == pytest.approx(1 - p[0])
            assert r.class_probabilities == pytest.approx(dict(zip(CLASS_NAMES, p, strict=True)))

    score = lambda seq: float((h @ (a @ np.concatenate(seq) + b) + c)[1:].sum())
    lags = {(r.origin_idx, r.lag): r for r in attribution.temporal_attribution(df, model, head).collect()}
    feats = {(r.origin_idx, r.feature): r for r in attribution.feature_attribution(df, model, head, ["x", "y", "w"]).collect()}
    for i in range(6):
        drop = [abs(score(past[i]) - score([z * (j != lag) for j, z in enumerate(past[i])])) for lag in range(n)]
        for lag in range(n):
            assert lags[i, lag].importance == pytest.approx(drop[lag] / sum(drop), abs=1e-4)
        drop = [abs(score(past[i]) - score(past[i] * (np.arange(d) != f))) for f in range(d)]
        for f, name in enumerate(["x", "y", "w"]):
            assert feats[i, name].importance == pytest.approx(drop[f] / sum(drop), abs=1e-4)
    assert lags[0, 0].lag_label == "t-3" and lags[0, 3].lag_label == "t (Current)"


def test_baseline_reaches_the_penalised_optimum(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) * [3, 50] + 10
    y = (x[:, 0] > 10).astype(int) + (x[:, 1] > 30).astype(int)
    pairs = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "f double, g double, next_index int")
    model = forecast.baseline_fit(pairs, ["f", "g"])
    lr = model.stages[-1]
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    z = (x - x.mean(0)) / x.std(0)
    counts = np.bincount(y)
    weight = (200 / (len(counts) * counts))[y]

    def gradient(w, b):
        p = np.exp(z @ w.T + b)
        p = p / p.sum(1, keepdims=True) - np.eye(len(counts))[y]
        return (weight[:, None] * p).T @ z + w, (weight[:, None] * p).sum(0)

    gw, gb = gradient(w, b)
    assert np.abs(gw).max() < 0.05 and np.abs(gb).max() < 0.05
    from flowtide.sources import storage

    storage.save_model(model, str(tmp_path / "m"))
    again = storage.load_model(str(tmp_path / "m"))
    left, right = (forecast.baseline_predict(m, pairs).select("y_pred").collect() for m in (model, again))
    assert left == right


def test_report_falls_back_to_first_full_origin(tables):
    overview = graphs.window_overview(tables.nodes, tables.edges, tables.windows).join(tables.series.select(*WINDOW_KEY, "split", "split_idx"), WINDOW_KEY)
    shares = attribution.top_features(attribution.feature_attribution(tables.histories, tables.transition, tables.head))
    shares = shares.groupBy("split", "origin_idx").agg(F.collect_list("feature").alias("top_features"))
    for asked, used in ((10**6, 10), (3, 10), (12, 12)):
        r = forecast.forecast_report(tables.trajectory, tables.series, overview, shares, "test", asked, 7200).collect()
        assert len(r) == 1 and r[0].origin_idx == used and len(r[0].trajectory) == 5 and len(r[0].top_features) == 5


def test_no_window_is_lost_by_standard_scaling(tables):
    stats = cleaning.fitted_values(scaling.fit_standard_scaler(tables.series.where("split = 'train'"), WINDOW_FEATURES), "std_scaler")
    z = scaling.standard_scale(tables.series.where("split = 'train'"), stats, WINDOW_FEATURES)
    r = z.agg(F.avg("total_bytes"), F.stddev_pop("total_bytes")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(1)


def test_certificates_are_not_zero_away_from_the_optimum(tables):
    from flowtide.queries import _train_sequences

    pairs = sequences.next_step_pairs(tables.series, WINDOW_FEATURES).where(F.col("split") == "train")
    train = tables.states.where(F.col("split") == "train")
    worst = lambda df, c: df.agg(F.max(F.abs(c))).first()[0]
    assert worst(forecast.baseline_certificate(tables.baseline, pairs), "gradient") < 5e-6
    assert worst(forecast.head_certificate(tables.head, train), "gradient") < 5e-6
    assert worst(forecast.transition_certificate(tables.transition, _train_sequences(tables)), "residual") < 5e-6
    moved = forecast.ThreatHead([[x * 1.05 for x in row] for row in tables.head.rows], tables.head.bias)
    assert worst(forecast.head_certificate(moved, train), "gradient") > 1e-3
    off = forecast.Transition([[x * 1.05 for x in row] for row in tables.transition.rows], tables.transition.bias)
    assert worst(forecast.transition_certificate(off, _train_sequences(tables)), "residual") > 1e-3


def test_coefficients_stored_and_read_score_as_the_fitted_model(spark, tables, tmp_path):
    head = forecast.baseline_head(tables.baseline)
    table = forecast.coefficient_table(spark, {"transition": tables.transition, "baseline": head})
    storage.save_coefficients(table, str(tmp_path / "c"))
    back = forecast.models_of(storage.load_coefficients(spark, str(tmp_path / "c")))
    assert back["transition"].rows == tables.transition.rows and back["transition"].bias == tables.transition.bias and back["baseline"] == head
    with pytest.raises(ValueError, match="incomplete"):
        forecast.models_of(table.where("row <> 0 or position <> 3"))
    train = tables.series.where(F.col("split") == "train")
    pairs = sequences.next_step_pairs(train, WINDOW_FEATURES)
    stats = cleaning.fitted_values(scaling.fit_standard_scaler(pairs, WINDOW_FEATURES), "std_scaler")
    mine = forecast.linear_predict(back["baseline"], scaling.standard_scale(tables.series, stats, WINDOW_FEATURES))
    want = {(r.split, r.split_idx): (r.y_pred, r.probabilities) for r in forecast.baseline_predict(tables.baseline, tables.series).collect()}
    for r in mine.collect():
        y, p = want[r.split, r.split_idx]
        assert r.y_pred == y and r.probabilities == pytest.approx(p, abs=1e-9)


def test_calendar_of_a_stray_timestamp(spark):
    """A flow decades early: every window in between, and no array above a block."""
    present = spark.createDataFrame([("a", 0), ("a", 2_000_003), ("a", 2_000_004), ("b", 3), ("b", 3), ("c", 0)], "source_file string, window_idx long")
    found = graphs.dense_calendar(present, 1000)
    rows = {r.source_file: tuple(r)[1:] for r in found.groupBy("source_file").agg(F.count("*"), F.count_distinct("window_idx"), F.min("window_idx"), F.max("window_idx")).collect()}
    assert rows == {"a": (2_000_005, 2_000_005, 0, 2_000_004), "b": (4, 4, 0, 3), "c": (1, 1, 0, 0)}
    assert graphs.dense_calendar(present.limit(0)).count() == 0


def test_broken_graph_files_are_detected(spark, tables, tmp_path):
    import shutil

    nodes, edges = (materialise(tables.with_split(x, s)) for x, s in zip(tables.graph, (["ip"], ["src_ip", "dst_ip"])))
    path = tmp_path / "graph"
    storage.write_graphs(nodes, edges, str(path))
    back = storage.read_graphs(spark, str(path))
    assert [b.count() for b in back] == [nodes.count(), edges.count()]
    assert storage.read_graphs(spark, str(path), "test")[1].count() == edges.where("split = 'test'").count() > 0
    changed = edges.withColumn("flow_count", F.when((F.col("split") == "train") & (F.col("src_idx") == 0), 7.5).otherwise(F.col("flow_count")))
    changed.write.mode("overwrite").partitionBy("split").parquet(str(path / "edges"))
    with pytest.raises(ValueError, match="edges.*train"):
        storage.read_graphs(spark, str(path))
    storage.read_graphs(spark, str(path), "val")
    shutil.rmtree(path / "nodes" / "split=val")
    with pytest.raises(ValueError, match="nodes.*val"):
        storage.read_graphs(spark, str(path), "val")
