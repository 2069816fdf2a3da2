"""Imputation with fitted medians and the rows that survive it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowtide.plans.lookup import join_lookup
from flowtide.plans.quantiles import exact_quantiles
from flowtide.plans.ranking import numbered, written_sizes
from flowtide.schema import NUMERIC_FIELDS

TRAIN_SHARE = 0.70
MINUTE_US = 60_000_000


def drop_null_timestamp(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("timestamp").isNotNull())


def train_flow_slice(flows: DataFrame, tie_keys: list[str], share: float = TRAIN_SHARE) -> DataFrame:
    """The first ``floor(share * n)`` flows of each capture in (timestamp, tie key) order.

    Flows are counted per minute first.  Minutes wholly before the cut are taken as they
    are, and only flows of the one minute that contains the cut are ranked, so no capture
    is sorted as a whole.  Flows without a timestamp come first, as in a sorted table.
    """
    minute = F.coalesce(F.floor(F.unix_micros("timestamp") / MINUTE_US), F.lit(-(2**62))).cast("bigint")
    tagged = flows.withColumn("_minute", minute)
    per_minute = tagged.groupBy("source_file", "_minute").agg(F.count(F.lit(1)).alias("n"))
    # Per capture one row a minute: bounded by its length in time, not by its flows.
    of_file = Window.partitionBy("source_file")
    keep = F.floor(F.lit(share).cast("double") * F.sum("n").over(of_file)).cast("bigint")
    cuts = (
        per_minute.withColumn("keep", keep)
        .withColumn("before", F.sum("n").over(of_file.orderBy("_minute")) - F.col("n"))
        .where((F.col("before") < F.col("keep")) & (F.col("keep") <= F.col("before") + F.col("n")))
        .select("source_file", F.col("_minute").alias("_cut"), (F.col("keep") - F.col("before")).alias("_left"), "n")
    )
    sizes = written_sizes(cuts)
    marked = join_lookup(tagged, sizes.table.drop("n"), ["source_file"], tie_keys)
    early = marked.where(F.col("_minute") < F.col("_cut"))
    at_cut = marked.where(F.col("_minute") == F.col("_cut"))
    order = [F.col("timestamp"), *[F.col(k) for k in tie_keys]]
    ranked = numbered(at_cut, ["source_file"], order, "_rank", sizes=sizes).where(F.col("_rank") < F.col("_left"))
    return early.select(*flows.columns).unionByName(ranked.select(*flows.columns))


def fit_medians(train: DataFrame, columns: list[str] = NUMERIC_FIELDS) -> DataFrame:
    """Exact medians as ``kind, feature, center, scale``; a column with no value gets 0."""
    names = train.sparkSession.createDataFrame([(c,) for c in columns if c in train.columns], "feature string")
    medians = exact_quantiles(train, [c for c in columns if c in train.columns], [0.5])
    # One row per column on both sides.
    return names.join(F.broadcast(medians), "feature", "left").select(
        F.lit("flow_median").alias("kind"),
        "feature",
        F.coalesce("value", F.lit(0.0)).alias("center"),
        F.lit(1.0).alias("scale"),
    )


def fitted_values(stats: DataFrame, kind: str) -> dict[str, tuple[float, float]]:
    """Fitted numbers of one kind: one row per feature, as small as a model's coefficients."""
    return {r.feature: (r.center, r.scale) for r in stats.where(F.col("kind") == kind).collect()}


def impute_median(flows: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Fill nulls of the columns that have a fitted median, then drop untimed flows."""
    medians = {} if stats is None else fitted_values(stats, "flow_median")
    filled = flows.fillna({c: m for c, (m, _) in medians.items() if c in flows.columns}) if medians else flows
    return drop_null_timestamp(filled)
