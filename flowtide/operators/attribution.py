"""Which past windows and which features drive a forecast: occlusion shares.

The forecaster is linear up to the class logits, so zeroing a lag or a feature changes the
summed attack logits by exactly that part's weighted value; no second scoring is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.functions.threat import array_sum, let
from flowtide.operators.forecast import ThreatHead, Transition, dot, number_array
from flowtide.schema import BENIGN_INDEX, NODE_FEATURES

TINY = 1e-12


def attack_weights(transition: Transition, head: ThreatHead) -> list[float]:
    """Weight of every history value in the sum of all attack logits one step ahead."""
    per_state = [
        sum(row[j] for c, row in enumerate(head.rows) if c != BENIGN_INDEX) for j in range(len(transition.rows))
    ]
    lags = len(transition.rows[0])
    return [sum(per_state[j] * transition.rows[j][i] for j in range(len(per_state))) for i in range(lags)]


def _shares(parts: Column) -> Column:
    share = lambda size: let(
        array_sum(size) + F.lit(TINY), lambda total: F.transform(size, lambda x: F.round(x / total, 4))
    )
    return let(F.transform(parts, F.abs), share)


def lag_label(position: Column, history: int) -> Column:
    back = F.lit(history - 1) - position
    return F.when(back > 0, F.concat(F.lit("t-"), back.cast("string"))).otherwise("t (Current)")


def temporal_attribution(histories: DataFrame, transition: Transition, head: ThreatHead) -> DataFrame:
    """Share of each past window, oldest first, one row per origin and lag."""
    d = len(transition.rows)
    weights = attack_weights(transition, head)
    per_lag = number_array([weights[i * d : (i + 1) * d] for i in range(transition.history)])
    parts = F.zip_with(F.col("history"), per_lag, lambda z, w: dot(z, w))
    return histories.select("split", "origin_idx", F.posexplode(_shares(parts)).alias("lag", "importance")).select(
        "split", "origin_idx", "lag", lag_label(F.col("lag"), transition.history).alias("lag_label"), "importance"
    )


def feature_attribution(
    histories: DataFrame, transition: Transition, head: ThreatHead, features: list[str] = NODE_FEATURES
) -> DataFrame:
    """Share of each input feature, one row per origin and feature.

    A feature occupies its mean and its maximum in every state of the history.
    """
    d = len(transition.rows)
    weights = attack_weights(transition, head)
    masked = [
        [w if (i % d) % len(features) == f else 0.0 for i, w in enumerate(weights)] for f in range(len(features))
    ]
    flat = F.flatten("history")
    parts = let(flat, lambda v: F.transform(number_array(masked), lambda row: dot(row, v)))
    names = F.array(*[F.lit(f) for f in features])
    return histories.select("split", "origin_idx", F.posexplode(_shares(parts)).alias("pos", "importance")).select(
        "split", "origin_idx", F.element_at(names, F.col("pos") + 1).alias("feature"), "importance"
    )


def top_features(attribution: DataFrame, k: int = 5) -> DataFrame:
    """Highest ``k`` features of each origin; equal shares in name order."""
    by_share = Window.partitionBy("split", "origin_idx").orderBy(F.desc("importance"), "feature")
    return attribution.withColumn("rank", F.row_number().over(by_share)).where(F.col("rank") <= k)


def shares(top: DataFrame, lags: DataFrame) -> DataFrame:
    """One row per origin: its highest features and the share of each past window, as arrays of bounded length."""
    key = ["split", "origin_idx"]
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    features = top.groupBy(*key).agg(in_order("rank", "feature", "importance").alias("top_features"))
    return features.join(lags.groupBy(*key).agg(in_order("lag", "lag_label", "importance").alias("past_windows")), key)
