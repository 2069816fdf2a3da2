"""Robust and standard scaling with statistics fitted on training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowtide.plans.quantiles import exact_quantiles


def fit_robust_scaler(train: DataFrame, features: Sequence[str], kind: str) -> DataFrame:
    """Median and interquartile range per feature; a zero range scales by 1."""
    q = exact_quantiles(train, features, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    spread = at(0.75) - at(0.25)
    return q.groupBy("feature").agg(at(0.5).alias("center"), spread.alias("iqr")).select(
        F.lit(kind).alias("kind"),
        "feature",
        "center",
        F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr")).alias("scale"),
    )


def fit_standard_scaler(train: DataFrame, features: Sequence[str], kind: str = "std_scaler") -> DataFrame:
    """Mean and population deviation per feature; a zero deviation scales by 1."""
    # stddev_pop merges (count, mean, M2) per task: no cancellation, one small row each.
    one = train.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"c_{f}") for f in features],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in features],
    )
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"c_{f}").alias("center"), F.col(f"s_{f}").alias("scale"))
        for f in features
    ])
    return one.select(F.inline(rows)).where(F.col("center").isNotNull()).select(
        F.lit(kind).alias("kind"), "feature", "center", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")).alias("scale")
    )


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]] | None, features: Sequence[str]) -> DataFrame:
    """(x - center) / scale as a projection with the fitted numbers as constants.

    Without statistics, or for a feature that has none, values stay as they are.
    """
    stats = stats or {}
    return df.withColumns({
        f: (F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1]) for f in features if f in stats
    })


apply_robust_scaler = apply_scaler
standard_scale = apply_scaler
