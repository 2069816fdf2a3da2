"""Host graph of every window at once: edges, nodes, indexes, loops, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.functions.labels import label_category, severity_rank
from flowtide.operators.sampling import priority_edge_sample
from flowtide.operators.scaling import apply_robust_scaler
from flowtide.plans.lookup import hot_keys, join_by_key, join_lookup
from flowtide.plans.materialise import materialise
from flowtide.plans.ranking import numbered
from flowtide.schema import EDGE_FEATURES, NODE_FEATURES, WINDOW_KEY

EDGE_KEY = [*WINDOW_KEY, "src_ip", "dst_ip"]
# A host with more edge rows than this in one window is salted when edges are joined.
# Longest array of empty windows.
CALENDAR_BLOCK = 10_000
HOT_DEGREE = 1_000_000


def _zero_if_null(total: Column) -> Column:
    return F.coalesce(total, F.lit(0.0))


def entropy_of_shares(p: Column) -> Column:
    """Shannon entropy in bits as an aggregate over shares.

    Rounded to ten decimals: the sum's order is free, and equal distributions must tie.
    """
    return F.round(-F.sum(p * F.log2(p + F.lit(1e-12))), 10)


def shannon_entropy(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Entropy of a column's values per group, one vote per row.

    Values are counted first, so later steps see each value of a group once.
    """
    counts = materialise(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")), "value_counts")
    totals = materialise(counts.groupBy(*group).agg(F.sum("n").alias("total")), "group_totals")
    shares = join_lookup(counts, totals, group, [value]).withColumn("p", F.col("n") / F.col("total"))
    return shares.groupBy(*group).agg(entropy_of_shares(F.col("p")).alias("entropy"))


def port_totals(indexed: DataFrame) -> DataFrame:
    """Flows summed per (window, source, destination, destination port).

    The only shuffle that sees flows; map-side combine shrinks it and no later step goes
    back to the flows.
    """
    return indexed.groupBy(*EDGE_KEY, "dst_port").agg(
        F.min("origin_us").alias("origin_us"),
        F.count(F.lit(1)).alias("flow_count"),
        (_zero_if_null(F.sum("fwd_bytes")) + _zero_if_null(F.sum("bwd_bytes"))).alias("total_bytes"),
        (_zero_if_null(F.sum("fwd_pkts")) + _zero_if_null(F.sum("bwd_pkts"))).alias("total_pkts"),
        _zero_if_null(F.sum("flow_duration")).alias("duration_sum"),
        F.count("flow_duration").alias("duration_n"),
        _zero_if_null(F.sum("flow_iat_mean")).alias("iat_sum"),
        F.count("flow_iat_mean").alias("iat_n"),
        _zero_if_null(F.sum("syn_count")).alias("syn_count"),
        _zero_if_null(F.sum("rst_count")).alias("rst_count"),
        F.min(severity_rank(label_category(F.col("label")))).alias("severity"),
    )


def pair_totals(indexed: DataFrame) -> DataFrame:
    """Per (window, source, destination): mergeable totals plus destination-port entropy.

    The entropy needs each port's share of the edge total.  Both the running total and
    the sum are keyed by the edge, so they share one exchange; an edge holds at most one
    row per port, however many flows it has.
    """
    share = F.col("flow_count") / F.sum("flow_count").over(Window.partitionBy(*EDGE_KEY))
    ports = port_totals(indexed).withColumn("p", share)
    sums = ["flow_count", "total_bytes", "total_pkts", "duration_sum", "duration_n", "iat_sum", "iat_n", "syn_count", "rst_count"]
    return ports.groupBy(*EDGE_KEY).agg(
        F.min("origin_us").alias("origin_us"),
        *[F.sum(c).alias(c) for c in sums],
        F.min("severity").alias("severity"),
        entropy_of_shares(F.col("p")).alias("dst_port_entropy"),
    )


def edge_features(pairs: DataFrame) -> DataFrame:
    """The seven edge features of every directed pair."""
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0)
    return pairs.select(
        *EDGE_KEY,
        F.col("flow_count").cast("double").alias("flow_count"),
        "total_bytes",
        "total_pkts",
        mean("duration_sum", "duration_n").alias("mean_duration"),
        mean("iat_sum", "iat_n").alias("mean_iat"),
        "syn_count",
        "dst_port_entropy",
    )


def port_entropy(pairs: DataFrame) -> DataFrame:
    return pairs.select(*EDGE_KEY, "dst_port_entropy")


def rst_by_source(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*WINDOW_KEY, "src_ip").agg(F.sum("rst_count").alias("rst_sum"))


def node_features(pairs: DataFrame) -> DataFrame:
    """The nine node features of every host in every window.

    Each edge yields one row for either end.  Grouping by (host, neighbour) first makes
    the neighbour distinct, so the peer count is a plain count and a host that talks to
    everyone is spread over its neighbours before its partial sums meet.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    b, p, syn, rst = F.col("total_bytes"), F.col("total_pkts"), F.col("syn_count"), F.col("rst_count")

    def end(ip: str, peer: str, out: bool) -> Column:
        pick = lambda value, on: (value if on else zero)
        return F.struct(
            F.col(ip).alias("ip"),
            F.col(peer).alias("peer"),
            pick(one, not out).alias("in_degree"),
            pick(one, out).alias("out_degree"),
            pick(b, not out).alias("in_bytes"),
            pick(b, out).alias("out_bytes"),
            pick(p, not out).alias("in_pkts"),
            pick(p, out).alias("out_pkts"),
            pick(syn, out).alias("syn"),
            pick(rst, out).alias("rst"),
        )

    ends = pairs.select(*WINDOW_KEY, F.inline(F.array(end("src_ip", "dst_ip", True), end("dst_ip", "src_ip", False))))
    sums = ["in_degree", "out_degree", "in_bytes", "out_bytes", "in_pkts", "out_pkts", "syn", "rst"]
    per_peer = ends.groupBy(*WINDOW_KEY, "ip", "peer").agg(*[F.sum(c).alias(c) for c in sums])
    per_host = per_peer.groupBy(*WINDOW_KEY, "ip").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).cast("double").alias("peer_count")
    )
    packets = F.col("out_pkts") + F.col("in_pkts") + F.lit(1e-6)
    return per_host.withColumn("syn_ratio", F.col("syn") / packets).withColumn(
        "rst_ratio", F.col("rst") / packets
    ).select(*WINDOW_KEY, "ip", *NODE_FEATURES)


def node_index(nodes: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Dense alphabetical index of each host inside its window."""
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    return numbered(nodes, WINDOW_KEY, [F.col("ip")], "node_idx", **extra)


def index_edges(edges: DataFrame, indexed_nodes: DataFrame, degrees: DataFrame, hot_degree: int = HOT_DEGREE) -> DataFrame:
    """Replace both ends of an edge by node indexes.

    ``degrees`` are unscaled node features; their degree columns name the hosts to salt.
    """
    ends = degrees.select(*WINDOW_KEY, "ip", "in_degree", "out_degree")
    src = indexed_nodes.select(*WINDOW_KEY, F.col("ip").alias("src_ip"), F.col("node_idx").alias("src_idx"))
    dst = indexed_nodes.select(*WINDOW_KEY, F.col("ip").alias("dst_ip"), F.col("node_idx").alias("dst_idx"))
    out = join_by_key(
        edges, src, [*WINDOW_KEY, "src_ip"], ["dst_ip"], hot_keys(ends.withColumnRenamed("ip", "src_ip"), [*WINDOW_KEY, "src_ip"], hot_degree, "out_degree")
    )
    return join_by_key(
        out, dst, [*WINDOW_KEY, "dst_ip"], ["src_ip"], hot_keys(ends.withColumnRenamed("ip", "dst_ip"), [*WINDOW_KEY, "dst_ip"], hot_degree, "in_degree")
    )


def self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add one all-zero edge from each host to itself; existing self edges stay."""
    loops = nodes.select(
        *WINDOW_KEY,
        F.col("ip").alias("src_ip"),
        F.col("ip").alias("dst_ip"),
        *[F.lit(0.0).alias(f) for f in EDGE_FEATURES],
    )
    return edges.select(*EDGE_KEY, *EDGE_FEATURES).unionByName(loops)


def with_empty_windows(nodes: DataFrame, spine: DataFrame) -> DataFrame:
    """Every window of ``spine`` has a node: an empty one gets an all-zero ``dummy``."""
    present = nodes.select(*WINDOW_KEY).distinct()
    empty = spine.select(*WINDOW_KEY).distinct().join(present, WINDOW_KEY, "left_anti")
    dummies = empty.select(*WINDOW_KEY, F.lit("dummy").alias("ip"), *[F.lit(0.0).alias(f) for f in NODE_FEATURES])
    return nodes.select(*WINDOW_KEY, "ip", *NODE_FEATURES).unionByName(dummies)


def dense_calendar(windows: DataFrame, block: int = CALENDAR_BLOCK) -> DataFrame:
    """All window indexes of each capture from 0 to its last, also the empty ones.

    Each present window adds the gap between its predecessor and itself.  A gap is cut into blocks of blocks, blocks and
    members, so a stray timestamp decades before the rest makes no array above ``block`` (gaps below its cube).
    """
    present = windows.select("source_file", "window_idx").distinct()
    before = F.lag("window_idx", 1, -1).over(Window.partitionBy("source_file").orderBy("window_idx"))
    gaps = present.select("source_file", (before + 1).alias("lo"), (F.col("window_idx") - 1).alias("hi")).where("lo <= hi")
    rows = gaps
    for size in (block * block, block, 1):
        part = F.explode(F.sequence(F.floor(F.col("lo") / size).cast("bigint"), F.floor(F.col("hi") / size).cast("bigint")))
        rows = rows.withColumn("part", part).select(
            "source_file",
            F.greatest(F.col("lo"), F.col("part") * size).alias("lo"),
            F.least(F.col("hi"), F.col("part") * size + (size - 1)).alias("hi"),
        )
    return present.unionByName(rows.select("source_file", F.col("lo").alias("window_idx")))


def window_graph(
    pairs: DataFrame,
    node_stats: dict | None = None,
    edge_stats: dict | None = None,
    max_edges: int | None = None,
    add_self_loops: bool = False,
    raw_nodes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all windows: features, scaling, indexes.

    ``pairs`` should be a materialised ``pair_totals`` table; it is read several times.  All edges
    stay unless ``max_edges`` asks for the best scored ones of each window; nodes are computed
    before that and never dropped, scaling follows it.  ``raw_nodes`` takes a table of
    ``node_features`` that is written already.
    """
    raw_nodes = raw_nodes or materialise(node_features(pairs), "nodes")
    edges = edge_features(pairs)
    if max_edges is not None:
        edges = priority_edge_sample(edges, max_edges)
    if edge_stats:
        edges = apply_robust_scaler(edges, edge_stats, EDGE_FEATURES)
    if add_self_loops:
        edges = self_loops(edges, raw_nodes)
    indexed = node_index(raw_nodes)
    edges = index_edges(edges, indexed, raw_nodes)
    nodes = apply_robust_scaler(indexed, node_stats, NODE_FEATURES) if node_stats else indexed
    return nodes, edges


def window_overview(nodes: DataFrame, edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Active hosts and directed connections of each window beside its label and start."""
    hosts = nodes.groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).alias("active_hosts"))
    links = edges.groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).alias("active_edges"))
    return (
        windows.select(*WINDOW_KEY, "start_time", "target_category")
        .join(hosts, WINDOW_KEY, "left")
        .join(links, WINDOW_KEY, "left")
        .fillna(0, ["active_hosts", "active_edges"])
    )


def window_subgraph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 25, max_edges: int = 40) -> DataFrame:
    """Small view of each window: of its first edges by name, those between first hosts.

    A plain top-k per window: Spark keeps only ``k`` rows per window and task ahead of
    the shuffle (window group limit), so large windows are cut where they are read.
    """
    by_name = Window.partitionBy(*WINDOW_KEY).orderBy("ip")
    by_pair = Window.partitionBy(*WINDOW_KEY).orderBy("src_ip", "dst_ip")
    first_hosts = (
        nodes.select(*WINDOW_KEY, "ip").withColumn("r", F.row_number().over(by_name)).where(F.col("r") <= max_nodes)
    )
    first_edges = (
        edges.select(*EDGE_KEY).withColumn("r", F.row_number().over(by_pair)).where(F.col("r") <= max_edges).drop("r")
    )
    sources = first_hosts.select(*WINDOW_KEY, F.col("ip").alias("src_ip"))
    targets = first_hosts.select(*WINDOW_KEY, F.col("ip").alias("dst_ip"))
    return first_edges.join(sources, [*WINDOW_KEY, "src_ip"], "left_semi").join(
        targets, [*WINDOW_KEY, "dst_ip"], "left_semi"
    ).select(*EDGE_KEY)
