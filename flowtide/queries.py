"""Every operator as a query over the driver's tables.

Operators that build on one another share written intermediate tables per (session,
folder): pair totals, windows, the split series, graphs, states and fitted models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide import fixtures as fx
from flowtide.functions import labels, threat, values
from flowtide.operators import (
    attribution,
    cleaning,
    encode,
    forecast,
    graphs,
    metrics,
    profile,
    risk,
    sampling,
    scaling,
    sequences,
    windows,
)
from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise, scratch_path
from flowtide.plans.ranking import group_sizes
from flowtide.schema import (
    CSV_FIELDS,
    EDGE_FEATURES,
    FLOW_SCHEMA,
    N_CLASSES,
    NODE_FEATURES,
    NUMERIC_FIELDS,
    WINDOW_FEATURES,
    WINDOW_KEY,
)
from flowtide.session import tune
from flowtide.sources import captures, packets, storage
from flowtide.streaming import flows as streaming

W = fx.WINDOW_SECONDS
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


class Tables:
    """Intermediate tables and fitted models of one folder, each made on first use."""

    _all: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self._made: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        key = (spark.sparkContext.applicationId, sf_dir)
        return cls._all.setdefault(key, cls(spark, sf_dir))

    @classmethod
    def forget(cls) -> None:
        cls._all.clear()

    def _once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def flows(self) -> DataFrame:
        return fx.flows(self.spark, self.sf_dir)

    @property
    def captures(self) -> DataFrame:
        return self._once("captures", lambda: captures.normalize_headers(captures.read_raw_untyped(self.spark, self.capture_folder)))

    @property
    def capture_folder(self) -> str:
        return self._once("capture_folder", lambda: fx.write_captures(self.spark, self.sf_dir))

    @property
    def mixed_folder(self) -> str:
        """Captures of two layouts, and one without rows."""
        return self._once("mixed_folder", lambda: fx.write_captures(self.spark, self.sf_dir, mixed=True))

    @property
    def headers(self) -> DataFrame:
        return self._once("headers", lambda: captures.header_table(self.spark, self.mixed_folder))

    @property
    def mixed_captures(self) -> DataFrame:
        return captures.read_raw_dir(self.spark, self.mixed_folder, profile.profile_columns(), self.headers)

    @property
    def indexed(self) -> DataFrame:
        return self._once("indexed", lambda: windows.window_index(self.flows, W))

    @property
    def pairs(self) -> DataFrame:
        return self._once("pairs", lambda: materialise(graphs.pair_totals(self.indexed), "pairs"))

    @property
    def windows(self) -> DataFrame:
        return self._once("windows", lambda: materialise(windows.build_flow_windows(self.indexed, W), "windows"))

    @property
    def series(self) -> DataFrame:
        split = lambda: sequences.reindex_split(materialise(sequences.chrono_split(self.windows), "split"))
        return self._once("series", lambda: materialise(split(), "series"))

    @property
    def edges(self) -> DataFrame:
        return graphs.edge_features(self.pairs)

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: materialise(graphs.node_features(self.pairs), "nodes"))

    def with_split(self, df: DataFrame, spread: list[str]) -> DataFrame:
        keys = self._once("split_keys", lambda: materialise(self.series.select(*WINDOW_KEY, "split"), "split_keys"))
        return join_lookup(df, keys, WINDOW_KEY, spread)

    @property
    def scalers(self) -> DataFrame:
        def fit():
            train = lambda df, spread: self.with_split(df, spread).where(F.col("split") == "train")
            nodes = scaling.fit_robust_scaler(train(self.nodes, ["ip"]), NODE_FEATURES, "node_scaler")
            edges = scaling.fit_robust_scaler(train(self.edges, ["src_ip", "dst_ip"]), EDGE_FEATURES, "edge_scaler")
            return materialise(nodes.unionByName(edges), "scalers")

        return self._once("scalers", fit)

    @property
    def medians(self) -> DataFrame:
        return self._once(
            "medians",
            lambda: materialise(cleaning.fit_medians(cleaning.train_flow_slice(self.flows, ["flow_id"])), "medians"),
        )

    @property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        def build():
            node_stats = cleaning.fitted_values(self.scalers, "node_scaler")
            edge_stats = cleaning.fitted_values(self.scalers, "edge_scaler")
            nodes, edges = graphs.window_graph(self.pairs, node_stats, edge_stats, raw_nodes=self.nodes)
            return materialise(nodes, "graph_nodes"), materialise(edges, "graph_edges")

        return self._once("graph", build)

    @property
    def states(self) -> DataFrame:
        """The split series with each window's encoded state ``z``."""
        return self._once(
            "states", lambda: materialise(self.series.join(encode.encode_windows(*self.graph), WINDOW_KEY), "states")
        )

    @property
    def histories(self) -> DataFrame:
        return self._once(
            "histories", lambda: materialise(sequences.histories(self.states, F.col("z"), fx.HISTORY), "histories")
        )

    @property
    def baseline(self):
        def fit():
            pairs = sequences.next_step_pairs(self.series, WINDOW_FEATURES).where(F.col("split") == "train")
            return forecast.baseline_fit(pairs)

        return self._once("baseline", fit)

    @property
    def transition(self) -> forecast.Transition:
        def fit():
            return forecast.transition_fit(_train_sequences(self), encode.STATE_SIZE, fx.HISTORY)

        return self._once("transition", fit)

    @property
    def head(self) -> forecast.ThreatHead:
        return self._once(
            "head", lambda: forecast.threat_head_fit(self.states.where(F.col("split") == "train"))
        )

    @property
    def stored(self) -> dict[str, forecast.ThreatHead]:
        """Models of full size, saved as a coefficient table and read back."""

        def load():
            path = scratch_path(self.spark, "coefficients")
            made = {name: forecast.ThreatHead(*model) for name, model in fx.stored_coefficients().items()}
            storage.save_coefficients(forecast.coefficient_table(self.spark, made), path)
            return forecast.models_of(storage.load_coefficients(self.spark, path))

        return self._once("stored", load)

    @property
    def stored_models(self) -> tuple[forecast.Transition, forecast.ThreatHead]:
        transition = self.stored["transition"]
        return forecast.Transition(transition.rows, transition.bias, fx.HISTORY), self.stored["head"]

    @property
    def stored_trajectory(self) -> DataFrame:
        return self._once(
            "stored_trajectory", lambda: materialise(forecast.rollout(self.histories, *self.stored_models, fx.HORIZON), "stored_trajectory")
        )

    @property
    def stored_baseline(self) -> DataFrame:
        """The series with the stored baseline's predictions."""
        train = self.series.where(F.col("split") == "train")
        stats = cleaning.fitted_values(scaling.fit_standard_scaler(train, WINDOW_FEATURES), "std_scaler")
        scored = forecast.linear_predict(self.stored["baseline"], scaling.standard_scale(self.series, stats, WINDOW_FEATURES))
        return scored.select("split", "split_idx", "y_pred", "probabilities")

    @property
    def trajectory(self) -> DataFrame:
        return self._once(
            "trajectory",
            lambda: materialise(forecast.rollout(self.histories, self.transition, self.head, fx.HORIZON), "trajectory"),
        )


# --- small deterministic inputs derived from the tables -----------------------------


def simple_predictions(series: DataFrame) -> DataFrame:
    """Persistence as forecaster and a fixed class shift as baseline, for every step."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(fx.HORIZON)))
    made = lambda model, y: series.select(
        "split", F.col("split_idx").alias("origin_idx"), F.lit(model).alias("model"), steps.alias("step"), y.alias("y_pred")
    )
    persist = made("forecaster", F.col("target_index"))
    shifted = made("baseline", ((F.col("target_index") * 3 + 1) % N_CLASSES).cast("int"))
    return persist.unionByName(shifted)


def simple_pairs(series: DataFrame) -> DataFrame:
    return sequences.horizon_pairs(series, simple_predictions(series), fx.HISTORY, fx.HORIZON)


def simple_trajectory(series: DataFrame) -> DataFrame:
    """Five steps per window: its own class with falling confidence, the rest shared."""
    confidence = F.lit(0.9) - F.lit(0.08) * F.col("step")
    p = F.transform(
        F.sequence(F.lit(0), F.lit(N_CLASSES - 1)),
        lambda c: F.when(c == F.col("target_index"), confidence).otherwise((F.lit(1.0) - confidence) / F.lit(6.0)),
    )
    steps = series.select(
        "split", F.col("split_idx").alias("origin_idx"), "target_index", F.explode(F.sequence(F.lit(1), F.lit(fx.HORIZON))).alias("step")
    )
    return forecast.trajectory_rows(steps.withColumn("p", p).withColumn("state", F.array(F.lit(0.0))))


def event_logits(events: DataFrame) -> DataFrame:
    logits = F.array(*[((F.col("event_id") * (c + 1)) % 11) / F.lit(3.0) for c in range(N_CLASSES)])
    return events.select("event_id", logits.alias("logits"))


def simple_states(series: DataFrame) -> Column:
    return F.array(F.col("syn_ratio"), F.col("rst_ratio"), F.col("flow_count") / F.lit(100.0))


def simple_scored(series: DataFrame) -> DataFrame:
    seqs = sequences.sequences(series, simple_states(series), 1)
    logits = lambda z: F.array(*[z[0] * float(c) + z[1] * float(6 - c) + z[2] * float(c % 3) for c in range(N_CLASSES)])
    pred, actual = F.col("history")[0], F.col("target_z")
    return seqs.select(
        pred.alias("pred_z"),
        actual.alias("actual_z"),
        logits(pred).alias("pred_logits"),
        logits(actual).alias("actual_logits"),
        F.col("target_index").alias("y"),
    )


SIMPLE_FEATURES = ["syn_ratio", "rst_ratio", "flow_count"]
SIMPLE_WEIGHTS = {0: 0.2, 1: 1.0, 2: 1.5, 3: 2.0, 4: 0.5, 5: 3.0, 6: 5.0}


def simple_attribution(series: DataFrame) -> DataFrame:
    """Share of each window statistic in the sum of all, as an attribution table."""
    total = sum((F.col(f) for f in WINDOW_FEATURES[1:]), F.col(WINDOW_FEATURES[0]))
    parts = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.round(F.col(f) / total, 4).alias("importance")) for f in WINDOW_FEATURES
    ])
    return series.select("split", F.col("split_idx").alias("origin_idx"), F.inline(parts))


def fixed_models() -> tuple[forecast.Transition, forecast.ThreatHead]:
    """Moving average over the history, and logits that grow with the class index."""
    d = 3
    rows = [[1.0 / fx.HISTORY if i % d == j else 0.0 for i in range(fx.HISTORY * d)] for j in range(d)]
    head = [[float(c), float(6 - c), float(c % 3)] for c in range(N_CLASSES)]
    return forecast.Transition(rows, [0.0] * d, fx.HISTORY), forecast.ThreatHead(head, [0.0] * N_CLASSES)


def dirty_labels(flows: DataFrame) -> DataFrame:
    """Labels whose dashes became a replacement character, an en dash or an em dash."""
    mark = F.element_at(F.array(F.lit("\ufffd"), F.lit("\u2013"), F.lit("\u2014")), (F.col("flow_id") % 3 + 1).cast("int"))
    return flows.select("flow_id", F.concat(F.lit(" "), F.replace("label", F.lit("-"), mark)).alias("label"))


# --- output helpers ------------------------------------------------------------------


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and timestamps as text, so that engines can be compared.

    A hundredth of the last digit is added first: sums taken in another order then do not
    part at values that lie exactly between two roundings.
    """
    nudge = F.lit(0.0123456 * 10.0**-digits)
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "double":
            out.append(F.round(F.col(f"`{f.name}`") + nudge, digits).alias(f.name))
        elif kind == "timestamp":
            out.append(F.date_format(F.col(f"`{f.name}`"), TIME_FORMAT).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def spread_array(df: DataFrame, column: str, size: int, prefix: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(size)])


# --- queries -------------------------------------------------------------------------


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables.of(spark, sf_dir))
    return make


@query
def read_flow_csv(t: Tables) -> DataFrame:
    raw = fx.raw_flows(t.spark, t.sf_dir).drop("event_id", "source_file")
    path = scratch_path(t.spark, "capture")
    raw.toDF(*[f" {c}" if c != "Flow ID" else c for c in raw.columns]).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("emptyValue", "").csv(path)
    return rounded(captures.read_flow_csv(t.spark, path).drop("source_file"))


@query
def read_flow_dir(t: Tables) -> DataFrame:
    return rounded(captures.read_flow_dir(t.spark, t.mixed_folder))


@query
def normalize_headers(t: Tables) -> DataFrame:
    names = ["Flow ID", "Source IP", "Destination IP", "Source Port", "Timestamp", "Label", "source_file"]
    return t.captures.select(*names)


@query
def read_raw_untyped(t: Tables) -> DataFrame:
    raw = captures.read_raw_untyped(t.spark, t.capture_folder)
    return raw.select("event_id", F.col(" Flow Bytes/s").alias("rate_text"), F.col(" Timestamp").alias("time_text"))


@query
def packets_to_flows(t: Tables) -> DataFrame:
    flows = packets.packets_to_flows(fx.packets(t.spark, t.sf_dir), fx.PACKET_TIMEOUT, fx.PACKET_CELL)
    return rounded(flows.withColumn("flow_iat_std", F.round("flow_iat_std", 2)))


@query
def empty_flows(t: Tables) -> DataFrame:
    both = captures.empty_flows(t.spark).unionByName(t.flows.select(*FLOW_SCHEMA.names))
    return both.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("fwd_bytes").alias("fwd_bytes"))


@query
def write_windows(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "windows_by_split")
    storage.write_windows(t.series, path)
    return rounded(storage.read_split(t.spark, path).select("split", *WINDOW_KEY, *WINDOW_FEATURES, "target_category"))


@query
def write_graphs(t: Tables) -> DataFrame:
    """All rows of a written graph as read back: nodes, and edges with their ends."""
    path = scratch_path(t.spark, "graphs")
    storage.write_graphs(*[materialise(t.with_split(x, spread), "split_graph") for x, spread in zip(t.graph, (["ip"], ["src_ip", "dst_ip"]))], path)
    nodes, edges = storage.read_graphs(t.spark, path)
    row = lambda part, a, b, features: [
        F.lit(part).alias("part"), F.col("split").cast("string").alias("split"), *WINDOW_KEY, a.alias("host"), b.alias("peer"),
        *[(F.col(features[i]) if i < len(features) else F.lit(None).cast("double")).alias(f"f{i}") for i in range(len(NODE_FEATURES))],
    ]
    every = nodes.select(*row("nodes", F.col("ip"), F.lit(None).cast("string"), NODE_FEATURES))
    return rounded(every.unionByName(edges.select(*row("edges", F.col("src_ip"), F.col("dst_ip"), EDGE_FEATURES))))


def _evaluation_text(found: DataFrame) -> DataFrame:
    """An evaluation with each model's classes as text: name and ten-thousandths of its scores, support."""

    def part(x: Column) -> Column:
        scores = [F.round(x[c] * 10_000).cast("bigint").cast("string") for c in ("precision", "recall", "f1")]
        return F.concat_ws(":", x["class_name"], *scores, x["support"].cast("string"))

    texts = {c: F.concat_ws(",", F.transform(c, part)) for c in ("forecaster_classes", "baseline_classes")}
    return found.withColumns(texts)


def _evaluation(t: Tables) -> DataFrame:
    return _evaluation_text(metrics.evaluate_horizons(simple_pairs(t.series), W))


@query
def write_json_report(t: Tables) -> DataFrame:
    report = rounded(_evaluation(t))
    path = scratch_path(t.spark, "report")
    storage.write_json_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query
def save_load_fitted(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "fitted")
    storage.save_fitted(t.medians.unionByName(t.scalers), path)
    return rounded(storage.load_fitted(t.spark, path))


@query
def valid_rows(t: Tables) -> DataFrame:
    raw = fx.raw_flows(t.spark, t.sf_dir)
    return captures.valid_rows(raw).select("event_id", F.col("Flow ID").alias("flow_id"), F.col("Timestamp").alias("ts_txt"))


@query
def null_tokens(t: Tables) -> DataFrame:
    raw = fx.raw_flows(t.spark, t.sf_dir)
    return raw.select("event_id", values.to_number(F.col("Flow Bytes/s")).alias("flow_bytes_s"))


@query
def flow_projection(t: Tables) -> DataFrame:
    return rounded(captures.flow_projection(fx.raw_flows(t.spark, t.sf_dir)))


@query
def impute_median(t: Tables) -> DataFrame:
    filled = cleaning.impute_median(t.flows, t.medians)
    return rounded(filled.select("flow_id", "flow_bytes_s", "flow_pkts_s", "flow_duration"))


@query
def drop_null_timestamp(t: Tables) -> DataFrame:
    flows = captures.flow_projection(fx.raw_flows(t.spark, t.sf_dir))
    return rounded(cleaning.drop_null_timestamp(flows).select("source_file", "src_ip", "dst_ip", "timestamp", "fwd_bytes"))


@query
def parse_timestamp(t: Tables) -> DataFrame:
    raw = fx.raw_flows(t.spark, t.sf_dir)
    return rounded(raw.select("event_id", values.parse_timestamp(F.col("Timestamp")).alias("ts")))


@query
def fix_12h_clock(t: Tables) -> DataFrame:
    raw = fx.raw_flows(t.spark, t.sf_dir)
    return rounded(raw.select("event_id", values.fix_12h_clock(values.parse_timestamp(F.col("Timestamp"))).alias("ts")))


@query
def sanitize_label(t: Tables) -> DataFrame:
    return dirty_labels(t.flows).select(
        "flow_id",
        labels.sanitize_label(F.col("label")).alias("clean"),
        labels.profile_label(F.when(F.col("flow_id") % 7 == 0, F.lit("")).otherwise(F.col("label"))).alias("profile_clean"),
    )


@query
def label_category(t: Tables) -> DataFrame:
    odd = F.when(F.col("flow_id") % 31 == 0, F.lit("Unlisted")).otherwise(F.col("label"))
    return t.flows.select("flow_id", labels.label_category(odd).alias("category"))


@query
def category_index(t: Tables) -> DataFrame:
    category = labels.label_category(F.col("label"))
    return t.flows.select(
        "flow_id",
        labels.category_index(category).alias("class_index"),
        labels.category_name(labels.category_index(category)).alias("class_name"),
    )


@query
def window_index(t: Tables) -> DataFrame:
    return t.indexed.select("flow_id", "source_file", "window_idx")


@query
def window_bounds(t: Tables) -> DataFrame:
    return rounded(windows.window_bounds(t.indexed, W))


@query
def shannon_entropy(t: Tables) -> DataFrame:
    return rounded(graphs.shannon_entropy(t.flows, ["source_file"], "dst_port"))


@query
def softmax_threat(t: Tables) -> DataFrame:
    p = event_logits(fx.events(t.spark, t.sf_dir)).withColumn("p", threat.softmax(F.col("logits")))
    out = p.select("event_id", "p", threat.threat_score(F.col("p")).alias("threat"))
    return rounded(spread_array(out, "p", N_CLASSES, "p"))


@query
def top_class(t: Tables) -> DataFrame:
    p = event_logits(fx.events(t.spark, t.sf_dir)).withColumn("p", threat.softmax(F.col("logits")))
    by_class = threat.class_map(F.col("p"))
    return rounded(
        p.select(
            "event_id",
            threat.top_index(F.col("p")).alias("class_index"),
            threat.top_name(F.col("p")).alias("class_name"),
            F.array_max("p").alias("confidence"),
            F.try_element_at(by_class, F.lit("BENIGN")).alias("p_benign"),
            F.try_element_at(by_class, F.lit("INFILTRATION")).alias("p_infiltration"),
        )
    )


@query
def risk_tier(t: Tables) -> DataFrame:
    score = (F.col("event_id") % 101) / F.lit(100.0)
    return fx.events(t.spark, t.sf_dir).select(
        "event_id", threat.risk_tier(score).alias("tier"), threat.risk_tier(score, " RISK").alias("horizon_tier")
    )


@query
def lead_time(t: Tables) -> DataFrame:
    step = (F.col("event_id") % 5 + 1).cast("int")
    return fx.events(t.spark, t.sf_dir).select(
        "event_id",
        threat.horizon_label(step).alias("horizon_label"),
        threat.lead_seconds(step, W).alias("lead_time_seconds"),
        threat.lead_minutes(step, W).alias("lead_time_minutes"),
    )


@query
def fit_medians(t: Tables) -> DataFrame:
    return rounded(t.medians)


@query
def window_stats(t: Tables) -> DataFrame:
    return rounded(windows.build_flow_windows(windows.window_index(t.flows, W), W).select(*WINDOW_KEY, *WINDOW_FEATURES))


@query
def window_target(t: Tables) -> DataFrame:
    return windows.window_target(t.indexed)


@query
def window_label_counts(t: Tables) -> DataFrame:
    return windows.window_label_counts(t.indexed)


@query
def edge_features(t: Tables) -> DataFrame:
    return rounded(graphs.edge_features(graphs.pair_totals(t.indexed)))


@query
def port_entropy(t: Tables) -> DataFrame:
    return rounded(graphs.port_entropy(t.pairs))


@query
def node_features(t: Tables) -> DataFrame:
    return rounded(graphs.node_features(t.pairs))


@query
def rst_by_source(t: Tables) -> DataFrame:
    return rounded(graphs.rst_by_source(t.pairs))


@query
def fit_robust_scaler(t: Tables) -> DataFrame:
    return rounded(t.scalers)


@query
def apply_robust_scaler(t: Tables) -> DataFrame:
    nodes = scaling.apply_robust_scaler(t.nodes, cleaning.fitted_values(t.scalers, "node_scaler"), NODE_FEATURES)
    return rounded(nodes)


@query
def standard_scale(t: Tables) -> DataFrame:
    train = t.series.where(F.col("split") == "train")
    stats = cleaning.fitted_values(scaling.fit_standard_scaler(train, WINDOW_FEATURES), "std_scaler")
    return rounded(scaling.standard_scale(t.series, stats, WINDOW_FEATURES).select("split", "split_idx", *WINDOW_FEATURES))


@query
def file_profile(t: Tables) -> DataFrame:
    report = profile.file_profile(t.mixed_captures, t.headers)
    # Sizes depend on how the files were written; only that they are there is compared.
    return report.select(
        "source_file",
        (F.col("file_size_bytes") > 0).alias("has_size"),
        "raw_columns_count",
        F.concat_ws(",", "duplicate_columns").alias("duplicates"),
        "total_raw_rows",
        "valid_rows",
        "empty_padding_rows",
    )


@query
def inf_nan_audit(t: Tables) -> DataFrame:
    return profile.inf_nan_audit(fx.raw_flows(t.spark, t.sf_dir))


@query
def time_range_audit(t: Tables) -> DataFrame:
    return rounded(profile.time_range_audit(fx.raw_flows(t.spark, t.sf_dir)))


@query
def label_distribution(t: Tables) -> DataFrame:
    return profile.label_distribution(fx.raw_flows(t.spark, t.sf_dir))


@query
def topology_profile(t: Tables) -> DataFrame:
    return rounded(profile.topology_profile(t.flows))


@query
def topology_global(t: Tables) -> DataFrame:
    return rounded(profile.topology_profile(t.flows, []))


@query
def dataset_summary(t: Tables) -> DataFrame:
    return profile.dataset_summary(t.mixed_captures, t.headers)


@query
def split_class_counts(t: Tables) -> DataFrame:
    return sequences.split_class_counts(t.series)


@query
def class_weights(t: Tables) -> DataFrame:
    return rounded(metrics.class_weights(t.series.where(F.col("split") == "train")))


@query
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(simple_pairs(t.series))


@query
def class_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.class_metrics(metrics.confusion_matrix(simple_pairs(t.series))))


@query
def macro_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.macro_metrics(metrics.class_metrics(metrics.confusion_matrix(simple_pairs(t.series)))))


@query
def false_positive_rate(t: Tables) -> DataFrame:
    return rounded(metrics.false_positive_rate(metrics.confusion_matrix(simple_pairs(t.series))))


@query
def horizon_risk(t: Tables) -> DataFrame:
    return risk.horizon_risk(simple_trajectory(t.series))


@query
def dual_loss(t: Tables) -> DataFrame:
    return rounded(metrics.dual_loss(simple_scored(t.series), SIMPLE_WEIGHTS))


@query
def chrono_split(t: Tables) -> DataFrame:
    return sequences.chrono_split(t.windows).select(*WINDOW_KEY, "split")


@query
def train_flow_slice(t: Tables) -> DataFrame:
    return cleaning.train_flow_slice(t.flows, ["flow_id"]).select("flow_id", "source_file")


@query
def reindex_split(t: Tables) -> DataFrame:
    return sequences.reindex_split(sequences.chrono_split(t.windows)).select("split", "split_idx", *WINDOW_KEY)


def _flat_sequences(seqs: DataFrame) -> DataFrame:
    rows = seqs.select("split", "origin_idx", "target_index", F.posexplode("history").alias("lag", "z"), "target_z")
    return rounded(spread_array(spread_array(rows, "z", 3, "z"), "target_z", 3, "next_z"))


@query
def sequences_(t: Tables) -> DataFrame:
    return _flat_sequences(sequences.sequences(t.series, simple_states(t.series), fx.HISTORY))


@query
def sequences_within_file(t: Tables) -> DataFrame:
    return _flat_sequences(sequences.sequences(t.series, simple_states(t.series), fx.HISTORY, within_file=True))


@query
def next_step_pairs(t: Tables) -> DataFrame:
    return rounded(sequences.next_step_pairs(t.series, WINDOW_FEATURES))


@query
def horizon_pairs(t: Tables) -> DataFrame:
    return simple_pairs(t.series)


@query
def normalized_rank(t: Tables) -> DataFrame:
    edges = t.edges
    sizes = group_sizes(edges, WINDOW_KEY)
    sized = join_lookup(edges, sizes.table, WINDOW_KEY, ["src_ip", "dst_ip"])
    for name, _ in sampling.PRIORITY_WEIGHTS:
        sized = sampling.normalized_rank(sized, name, f"rank_{name}", sizes=sizes)
    return rounded(sized.select(*graphs.EDGE_KEY, *[f"rank_{n}" for n, _ in sampling.PRIORITY_WEIGHTS]))


@query
def slide_state(t: Tables) -> DataFrame:
    seqs = sequences.sequences(t.series, simple_states(t.series), fx.HISTORY)
    moved = seqs.withColumn("history", sequences.slide_state(F.col("history"), F.col("target_z"), fx.HISTORY))
    return _flat_sequences(moved)


@query
def priority_edge_sample(t: Tables) -> DataFrame:
    return rounded(sampling.priority_edge_sample(t.edges, fx.MAX_EDGES).select(*graphs.EDGE_KEY, "flow_count", "total_bytes"))


@query
def top_features(t: Tables) -> DataFrame:
    return attribution.top_features(simple_attribution(t.series)).select("split", "origin_idx", "rank", "feature", "importance")


@query
def window_subgraph(t: Tables) -> DataFrame:
    return graphs.window_subgraph(t.nodes, t.edges)


@query
def node_index(t: Tables) -> DataFrame:
    indexed = graphs.node_index(t.nodes)
    return graphs.index_edges(t.edges, indexed, t.nodes).select(*graphs.EDGE_KEY, "src_idx", "dst_idx")


@query
def attack_knowledge(t: Tables) -> DataFrame:
    odd = simple_trajectory(t.series).withColumn(
        "predicted_class",
        F.when(F.col("step") == 5, F.lit("Unheard of")).when(F.col("step") == 4, F.lower("predicted_class")).otherwise(F.col("predicted_class")),
    )
    return risk.attack_knowledge(odd).select("split", "origin_idx", "step", "model_prediction.*", "interpretation.*")


@query
def forecast_vs_actual(t: Tables) -> DataFrame:
    return rounded(risk.forecast_vs_actual(simple_trajectory(t.series), t.series, W))


@query
def model_comparison(t: Tables) -> DataFrame:
    return rounded(metrics.model_comparison(metrics.model_metrics(metrics.confusion_matrix(simple_pairs(t.series)))))


@query
def profile_report(t: Tables) -> DataFrame:
    """All audits of the captures from one scan; the label map as text."""
    report = profile.profile_report(t.mixed_captures, t.headers)
    report = report.drop("file_size_bytes", "file_size_mb").withColumn("duplicate_columns", F.concat_ws(",", "duplicate_columns"))
    text = F.concat_ws(",", F.transform(F.map_entries("label_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return rounded(report.withColumn("label_distribution", text))


@query
def host_union(t: Tables) -> DataFrame:
    return profile.host_union(t.flows)


@query
def pair_distinct(t: Tables) -> DataFrame:
    return profile.pair_distinct(t.flows)


@query
def concat_slices(t: Tables) -> DataFrame:
    """Slices of all captures stacked: rows and bytes of the training flows by capture."""
    train = cleaning.train_flow_slice(t.flows, ["flow_id"])
    return train.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("fwd_bytes").alias("fwd_bytes"))


@query
def window_graph_nodes(t: Tables) -> DataFrame:
    return rounded(t.graph[0])


@query
def window_graph(t: Tables) -> DataFrame:
    return rounded(t.graph[1].select(*graphs.EDGE_KEY, "src_idx", "dst_idx", *EDGE_FEATURES))


@query
def window_graph_sampled(t: Tables) -> DataFrame:
    """The edges of the graph where windows keep their best scored edges only."""
    stats = {k: cleaning.fitted_values(t.scalers, k) for k in ("node_scaler", "edge_scaler")}
    _, edges = graphs.window_graph(t.pairs, stats["node_scaler"], stats["edge_scaler"], fx.MAX_EDGES, raw_nodes=t.nodes)
    return rounded(edges.select(*graphs.EDGE_KEY, "src_idx", "dst_idx", *EDGE_FEATURES))


@query
def self_loops(t: Tables) -> DataFrame:
    return rounded(graphs.self_loops(t.edges, t.nodes))


@query
def empty_window_node(t: Tables) -> DataFrame:
    """Windows of a minute, many of them without a flow, on a calendar without gaps."""
    pairs = materialise(graphs.pair_totals(windows.window_index(t.flows, 60)), "minutes")
    spine = graphs.dense_calendar(pairs)
    filled = graphs.with_empty_windows(graphs.node_features(pairs), spine)
    return filled.select(*WINDOW_KEY, "ip", "in_degree", "out_degree", "peer_count")


@query
def message_pass(t: Tables) -> DataFrame:
    return rounded(encode.message_pass(*t.graph))


@query
def graph_readout(t: Tables) -> DataFrame:
    """Readout of the unscaled node features themselves."""
    plain = t.nodes.select(*WINDOW_KEY, "ip", *[F.col(f).alias(f"h_{i}") for i, f in enumerate(NODE_FEATURES)])
    return rounded(spread_array(encode.graph_readout(plain), "z", encode.STATE_SIZE, "z"))


@query
def encode_windows(t: Tables) -> DataFrame:
    return rounded(spread_array(encode.encode_windows(*t.graph), "z", encode.STATE_SIZE, "z"))


@query
def window_overview(t: Tables) -> DataFrame:
    return rounded(graphs.window_overview(t.nodes, t.edges, t.windows))


@query
def evaluate_horizons(t: Tables) -> DataFrame:
    return rounded(_evaluation(t))


def zeroed(df: DataFrame, column: str, digits: int) -> DataFrame:
    """A certificate's cells rounded, without a minus sign on zero."""
    cell = F.round(column, digits)
    return df.withColumn(column, F.when(cell == 0, 0.0).otherwise(cell))


@query
def baseline_fit(t: Tables) -> DataFrame:
    """The certificate of the fitted baseline: its penalised gradient, zero for every class and feature."""
    pairs = sequences.next_step_pairs(t.series, WINDOW_FEATURES).where(F.col("split") == "train")
    names = F.array(*[F.lit(f) for f in ("intercept", *WINDOW_FEATURES)])
    found = zeroed(forecast.baseline_certificate(t.baseline, pairs), "gradient", 5)
    return found.select("class_index", names[F.col("position") + 1].alias("feature"), "gradient", "rows")


@query
def baseline_coefficients(t: Tables) -> DataFrame:
    """Fitted coefficients, one row per class and feature."""
    model = t.baseline.stages[-1]
    rows = [
        (c, f, float(model.coefficientMatrix[c, i]), float(model.interceptVector[c]))
        for c in range(model.numClasses)
        for i, f in enumerate(WINDOW_FEATURES)
    ]
    return t.spark.createDataFrame(rows, "class_index int, feature string, coefficient double, intercept double")


@query
def baseline_predict(t: Tables) -> DataFrame:
    """Every window by a stored baseline of full size."""
    return rounded(t.stored_baseline.select("split", "split_idx", "y_pred", F.array_max("probabilities").alias("confidence")))


@query
def baseline_predict_fitted(t: Tables) -> DataFrame:
    out = forecast.baseline_predict(t.baseline, t.series)
    return out.select("split", "split_idx", "y_pred", F.array_max("probabilities").alias("confidence"))


@query
def baseline_project(t: Tables) -> DataFrame:
    out = forecast.baseline_project(t.stored_baseline, fx.HORIZON)
    return out.select("split", F.col("split_idx").alias("origin_idx"), "step", "y_pred")


@query
def baseline_project_fitted(t: Tables) -> DataFrame:
    out = forecast.baseline_project(forecast.baseline_predict(t.baseline, t.series), fx.HORIZON)
    return out.select("split", F.col("split_idx").alias("origin_idx"), "step", "y_pred")


def _train_sequences(t: Tables) -> DataFrame:
    return sequences.sequences(t.states, F.col("z"), fx.HISTORY).where(F.col("split") == "train")


@query
def transition_fit(t: Tables) -> DataFrame:
    """The certificate of the fitted transition: what is left of its normal equations, zero in every cell."""
    return zeroed(forecast.transition_certificate(t.transition, _train_sequences(t)), "residual", 5)


@query
def transition_coefficients(t: Tables) -> DataFrame:
    rows = [(j, i, float(w), t.transition.bias[j]) for j, row in enumerate(t.transition.rows) for i, w in enumerate(row)]
    return t.spark.createDataFrame(rows, "state_dim int, lag_dim int, coefficient double, intercept double")


@query
def transition_fit_line(t: Tables) -> DataFrame:
    """The same fit for one value and one lag, a ridge line over the bytes of training windows."""
    seqs = sequences.sequences(t.series, F.array("total_bytes"), 1).where(F.col("split") == "train")
    line = forecast.transition_fit(seqs, 1, 1)
    return t.spark.createDataFrame([(round(line.rows[0][0], 9), round(line.bias[0], 3))], "slope double, intercept double")


@query
def threat_head_fit(t: Tables) -> DataFrame:
    """The certificate of the fitted head: its penalised gradient, zero for every class and state value."""
    found = forecast.head_certificate(t.head, t.states.where(F.col("split") == "train"))
    return zeroed(found, "gradient", 5).select("class_index", F.col("position").alias("state_dim"), "gradient", "rows")


@query
def threat_head_coefficients(t: Tables) -> DataFrame:
    rows = [(c, j, float(w), t.head.bias[c]) for c, row in enumerate(t.head.rows) for j, w in enumerate(row)]
    return t.spark.createDataFrame(rows, "class_index int, state_dim int, coefficient double, intercept double")


def _flat_trajectory(trajectory: DataFrame) -> DataFrame:
    return trajectory.select(
        "split", "origin_idx", "step", "horizon_label", "class_index", "predicted_class", "confidence", "threat_score", "risk_tier"
    )


@query
def rollout(t: Tables) -> DataFrame:
    """Stored models of full size on the encoded windows."""
    return rounded(_flat_trajectory(t.stored_trajectory))


@query
def rollout_fitted(t: Tables) -> DataFrame:
    return _flat_trajectory(forecast.rollout(t.histories, t.transition, t.head, fx.HORIZON))


@query
def rollout_fixed(t: Tables) -> DataFrame:
    """Rollout with fixed coefficients, so that every number can be checked."""
    transition, head = fixed_models()
    past = sequences.histories(t.series, simple_states(t.series), fx.HISTORY)
    return rounded(_flat_trajectory(forecast.rollout(past, transition, head, fx.HORIZON)))


def _model_pairs(t: Tables, trajectory: DataFrame, baseline: DataFrame) -> DataFrame:
    """Forecasts of both models on the test split beside what came."""
    test = F.col("split") == "test"
    base = forecast.baseline_project(baseline.where(test), fx.HORIZON)
    made = forecast.as_predictions(trajectory.where(test)).unionByName(
        base.select("split", F.col("split_idx").alias("origin_idx"), F.lit("baseline").alias("model"), "step", "y_pred")
    )
    return sequences.horizon_pairs(t.series.where(test), made, fx.HISTORY, fx.HORIZON)


@query
def evaluate_models(t: Tables) -> DataFrame:
    """Both stored models on the test split: the full evaluation."""
    return rounded(_evaluation_text(metrics.evaluate_horizons(_model_pairs(t, t.stored_trajectory, t.stored_baseline), W)))


@query
def evaluate_models_fitted(t: Tables) -> DataFrame:
    """Both fitted models on the test split: the full evaluation."""
    return metrics.evaluate_horizons(_model_pairs(t, t.trajectory, forecast.baseline_predict(t.baseline, t.series)), W)


@query
def temporal_attribution(t: Tables) -> DataFrame:
    return rounded(attribution.temporal_attribution(t.histories, *t.stored_models))


@query
def temporal_attribution_fitted(t: Tables) -> DataFrame:
    return attribution.temporal_attribution(t.histories, t.transition, t.head)


@query
def temporal_attribution_fixed(t: Tables) -> DataFrame:
    """Shares of past windows under fixed coefficients, so that every number can be checked."""
    past = sequences.histories(t.series, simple_states(t.series), fx.HISTORY)
    return rounded(attribution.temporal_attribution(past, *fixed_models()))


@query
def feature_attribution_fixed(t: Tables) -> DataFrame:
    past = sequences.histories(t.series, simple_states(t.series), fx.HISTORY)
    return rounded(attribution.feature_attribution(past, *fixed_models(), SIMPLE_FEATURES))


@query
def feature_attribution(t: Tables) -> DataFrame:
    return rounded(attribution.feature_attribution(t.histories, *t.stored_models))


@query
def feature_attribution_fitted(t: Tables) -> DataFrame:
    return attribution.feature_attribution(t.histories, t.transition, t.head)


def _report(t: Tables, trajectory: DataFrame, transition: forecast.Transition, head: forecast.ThreatHead) -> DataFrame:
    overview = graphs.window_overview(t.nodes, t.edges, t.windows).join(
        t.series.select(*WINDOW_KEY, "split", "split_idx"), WINDOW_KEY
    )
    top = attribution.top_features(attribution.feature_attribution(t.histories, transition, head))
    lags = attribution.temporal_attribution(t.histories, transition, head)
    return forecast.forecast_report(
        trajectory, t.series, overview, attribution.shares(top, lags), window_seconds=W, history=fx.HISTORY, horizon=fx.HORIZON
    )


@query
def forecast_report(t: Tables) -> DataFrame:
    """The report of every origin under the stored models, lists as text with ten-thousandths."""
    share = lambda x: F.round(x * 10_000).cast("bigint").cast("string")
    told = lambda c, part: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", *part(x)))).alias(c)
    report = _report(t, t.stored_trajectory, *t.stored_models)
    lists = {
        "trajectory": lambda x: [x["step"].cast("string"), x["lead_time"], x["predicted_class"], share(x["confidence"]), share(x["threat_score"]), x["actual_class"], x["outcome"]],
        "top_features": lambda x: [x["rank"].cast("string"), x["feature"], share(x["importance"])],
        "past_windows": lambda x: [x["lag_label"], share(x["importance"])],
    }
    plain = [c for c in report.columns if c not in (*lists, "interpretation")]
    return rounded(report.select(*plain, "interpretation.*", *[told(c, part) for c, part in lists.items()]))


@query
def forecast_report_fitted(t: Tables) -> DataFrame:
    """The report of every origin that has a full history and a full horizon."""
    return storage.as_json(_report(t, t.trajectory, t.transition, t.head), ["split", "origin_idx"])


@query
def stream_window_stats(t: Tables) -> DataFrame:
    schema = fx.events(t.spark, t.sf_dir).schema
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/[e]vents.parquet")
    flows = source.selectExpr(*fx.select_list(fx.flow_fields(), "STRING"))
    stats = streaming.run_available(streaming.stream_window_stats(flows, W), "stream_windows")
    return rounded(stats)


@query
def stream_packets_to_flows(t: Tables) -> DataFrame:
    schema = fx.events(t.spark, t.sf_dir).schema
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/[e]vents.parquet")
    found = source.selectExpr(*fx.select_list(fx.packet_fields(), "STRING"))
    sessions = streaming.stream_packets_to_flows(found, fx.PACKET_TIMEOUT, cell_seconds=fx.PACKET_CELL)
    flows = streaming.run_available(sessions, "stream_packets")
    return rounded(flows.withColumn("flow_iat_std", F.round("flow_iat_std", 2)))


QUERIES["sequences"] = QUERIES.pop("sequences_")
