"""Priority sampling of edges in windows that have too many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise
from flowtide.plans.ranking import HOT_ROWS, GroupSizes, group_sizes, numbered, numbered_by_range, numbered_by_window, split_hot
from flowtide.schema import WINDOW_KEY

MAX_EDGES = 10_000
# Steps of the score's histogram; scores lie between 0 and 1.
SCORE_STEPS = 65_536

# Weight of each normalised rank in the priority score.
PRIORITY_WEIGHTS = [
    ("total_bytes", 0.35),
    ("flow_count", 0.25),
    ("syn_count", 0.20),
    ("dst_port_entropy", 0.20),
]
TIES = ["src_ip", "dst_ip"]


def normalized_rank(
    df: DataFrame, value: str, out: str, sizes: GroupSizes | None = None, hot_rows: int = HOT_ROWS, group=WINDOW_KEY
) -> DataFrame:
    """Rank in the group scaled to [0, 1]; ties are ordered by the pair of addresses.

    ``df`` carries the group size in ``n``.
    """
    order = [F.col(value), *[F.col(t) for t in TIES]]
    ranked = numbered(df, group, order, "_rank", sizes=sizes, hot_rows=hot_rows)
    return ranked.withColumn(out, _scaled_rank()).drop("_rank")


def _scaled_rank() -> Column:
    return F.col("_rank") / (F.col("n") - 1 + F.lit(1e-6))


def priority_score() -> Column:
    terms = [F.lit(weight) * F.col(f"rank_{name}") for name, weight in PRIORITY_WEIGHTS]
    return terms[0] + terms[1] + terms[2] + terms[3]


def priority_edge_sample(edges: DataFrame, max_edges: int = MAX_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Windows over the limit keep their ``max_edges`` best scored edges, others all.

    Only windows over the limit are ranked; the rest pass without a shuffle.  Windows too big for one task are split
    off once and ranked over the whole cluster.  The best are selected by a threshold: a histogram of scores tells the
    step of the last edge kept, edges above it are kept as they are and only those of that step are put in order.
    """
    sizes = group_sizes(edges, WINDOW_KEY)
    if sizes.largest <= max_edges:
        return edges
    over = materialise(sizes.table.where(F.col("n") > max_edges), "over_limit")
    columns = edges.columns
    within = join_lookup(edges, over, WINDOW_KEY, TIES, "left_anti")
    cold, hot = split_hot(join_lookup(edges, over, WINDOW_KEY, TIES), WINDOW_KEY, sizes, hot_rows)
    kept = _best(_scored(cold, numbered_by_window), max_edges, by_threshold=False).select(*columns)
    if hot is not None:
        scored = materialise(_scored(hot, numbered_by_range), "scored_edges")
        kept = kept.unionByName(_best(scored, max_edges, by_threshold=True).select(*columns))
    return within.select(*columns).unionByName(kept)


def _scored(edges: DataFrame, number: Callable) -> DataFrame:
    for name, _ in PRIORITY_WEIGHTS:
        placed = number(edges, WINDOW_KEY, [F.col(name), *[F.col(t) for t in TIES]], "_rank")
        edges = placed.withColumn(f"rank_{name}", _scaled_rank()).drop("_rank")
    return edges.withColumn("_score", priority_score())


def _best(scored: DataFrame, max_edges: int, by_threshold: bool) -> DataFrame:
    """The ``max_edges`` best of each window, all of which have more."""
    order = Window.partitionBy(*WINDOW_KEY).orderBy(F.desc("_score"), *TIES)
    if not by_threshold:
        return scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max_edges)
    steps = scored.withColumn("_step", F.floor(F.col("_score") * SCORE_STEPS).cast("int"))
    # At most SCORE_STEPS + 1 rows a window.
    counts = steps.groupBy(*WINDOW_KEY, "_step").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy(*WINDOW_KEY).orderBy(F.desc("_step"))) - F.col("n")
    cuts = materialise(
        counts.withColumn("_left", F.lit(max_edges) - above)
        .where((F.col("_left") > 0) & (F.col("_left") <= F.col("n")))
        .select(*WINDOW_KEY, F.col("_step").alias("_cut"), "_left"),
        "score_cuts",
    )
    marked = join_lookup(steps, cuts, WINDOW_KEY, TIES)
    # Both limits bound what a task sorts of a window: the constant one is applied before the shuffle.
    at_cut = marked.where(F.col("_step") == F.col("_cut")).withColumn("_place", F.row_number().over(order))
    at_cut = at_cut.where(F.col("_place") <= max_edges).where(F.col("_place") <= F.col("_left"))
    return marked.where(F.col("_step") > F.col("_cut")).unionByName(at_cut.drop("_place"))
