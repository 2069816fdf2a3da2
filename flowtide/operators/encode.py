"""Neighbourhood aggregation over window graphs and the fixed-size window state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.operators.graphs import HOT_DEGREE
from flowtide.plans.lookup import HotKeys, hot_keys, join_by_key
from flowtide.plans.materialise import materialise
from flowtide.schema import EDGE_FEATURES, NODE_FEATURES, WINDOW_KEY

STATE_SIZE = 2 * len(NODE_FEATURES)


@dataclass
class Layer:
    """Weights of one layer; the default is the identity form.

    ``edge``: rows per output dimension over the edge features; without it the edge
    vector is padded with zeros.  ``node``: rows per output dimension over the summed
    node vector.  ``eps`` weighs a host's own vector.
    """

    edge: list[list[float]] | None = None
    node: list[list[float]] | None = None
    bias: list[float] = field(default_factory=list)
    eps: float = 0.0


def _linear(columns: list[Column], rows: list[list[float]], bias: list[float] | None = None) -> list[Column]:
    out = []
    for i, row in enumerate(rows):
        total = F.lit(float(bias[i]) if bias else 0.0)
        for weight, column in zip(row, columns, strict=True):
            if weight:
                total = total + F.lit(float(weight)) * column
        out.append(total)
    return out


def _relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def hot_sources(edges: DataFrame, limit: int = HOT_DEGREE) -> HotKeys:
    """Sources with more than ``limit`` edges in a window."""
    counts = edges.groupBy(*WINDOW_KEY, "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return hot_keys(counts, [*WINDOW_KEY, "src_ip"], limit)


def message_pass(
    nodes: DataFrame,
    edges: DataFrame,
    layers: list[Layer] | None = None,
    hot: HotKeys | None = None,
    hot_degree: int = HOT_DEGREE,
) -> DataFrame:
    """Rows ``window key, ip, h_0 ...``: each host's vector after all layers.

    A layer joins edges with their source host, sums rectified messages by destination
    (with map-side combine) and adds the host's own vector.  Vectors are plain columns, so
    a layer stays in generated code; sources with very many edges are salted.
    """
    layers = layers or [Layer(), Layer()]
    hot = hot_sources(edges, hot_degree) if hot is None else hot
    state = nodes.select(*WINDOW_KEY, "ip", *[F.col(f).alias(f"h_{i}") for i, f in enumerate(NODE_FEATURES)])
    width = len(NODE_FEATURES)
    for depth, layer in enumerate(layers):
        features = [F.col(f) for f in EDGE_FEATURES]
        if layer.edge:
            projected = [_relu(c) for c in _linear(features, layer.edge)]
        else:
            projected = features + [F.lit(0.0)] * max(0, width - len(features))
        links = edges.select(*WINDOW_KEY, "src_ip", "dst_ip", *[projected[i].alias(f"e_{i}") for i in range(width)])
        sources = state.withColumnRenamed("ip", "src_ip")
        joined = join_by_key(links, sources, [*WINDOW_KEY, "src_ip"], ["dst_ip"], hot)
        sums = joined.groupBy(*WINDOW_KEY, F.col("dst_ip").alias("ip")).agg(
            *[F.sum(_relu(F.col(f"h_{i}") + F.col(f"e_{i}"))).alias(f"m_{i}") for i in range(width)]
        )
        both = state.join(sums, [*WINDOW_KEY, "ip"], "left")
        own = [
            F.col(f"h_{i}") * F.lit(1.0 + layer.eps) + F.coalesce(F.col(f"m_{i}"), F.lit(0.0)) for i in range(width)
        ]
        out = _linear(own, layer.node, layer.bias) if layer.node else own
        width = len(out)
        state = both.select(*WINDOW_KEY, "ip", *[_relu(c).alias(f"h_{i}") for i, c in enumerate(out)])
        if depth + 1 < len(layers):
            # The next layer reads it twice: as sources and as own vectors.
            state = materialise(state, "layer")
    return state


def graph_readout(vectors: DataFrame) -> DataFrame:
    """Mean over hosts, then maximum over hosts, as one array per window."""
    dims = [c for c in vectors.columns if c.startswith("h_")]
    pooled = vectors.groupBy(*WINDOW_KEY).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in dims], *[F.max(c).alias(f"max_{c}") for c in dims]
    )
    state = F.array(*[F.col(f"mean_{c}") for c in dims], *[F.col(f"max_{c}") for c in dims])
    return pooled.select(*WINDOW_KEY, state.alias("z"))


def encode_windows(
    nodes: DataFrame, edges: DataFrame, layers: list[Layer] | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """State ``z`` of every window in one batch."""
    return graph_readout(message_pass(nodes, edges, layers, hot))
