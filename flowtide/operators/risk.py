"""Threat over the forecast horizon and what is known about the predicted class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.labels import category_name
from flowtide.functions.threat import risk_tier
from flowtide.functions.values import strip
from flowtide.schema import KNOWLEDGE, KNOWLEDGE_FIELDS

ORIGIN = ["split", "origin_idx"]


def horizon_risk(trajectory: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Per origin: highest and mean threat, tier, infiltration risk over all steps.

    ``origins`` adds zero rows for origins that have no steps.
    """
    infiltration = F.coalesce(F.try_element_at("class_probabilities", F.lit("INFILTRATION")), F.lit(0.0))
    per_origin = trajectory.groupBy(*ORIGIN).agg(
        F.max("threat_score").alias("top"),
        F.avg("threat_score").alias("mean"),
        F.max(infiltration).alias("top_infiltration"),
        (F.lit(1.0) - F.product(F.lit(1.0) - infiltration)).alias("horizon_infiltration"),
        F.lit("1 - prod(1 - p_k) [Temporally-dependent approximation]").alias("infiltration_risk_formula"),
    )
    if origins is not None:
        per_origin = origins.select(*ORIGIN).join(per_origin, ORIGIN, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return per_origin.select(
        *ORIGIN,
        F.round(zero("top"), 4).alias("max_threat_score"),
        F.round(zero("mean"), 4).alias("mean_threat_score"),
        F.when(F.col("top").isNull(), risk_tier(F.lit(0.0)))
        .otherwise(risk_tier(F.col("top"), " RISK"))
        .alias("overall_risk_level"),
        F.round(zero("top_infiltration"), 4).alias("max_step_infiltration_prob"),
        F.round(zero("horizon_infiltration"), 4).alias("infiltration_risk_horizon"),
        F.coalesce("infiltration_risk_formula", F.lit("N/A")).alias("infiltration_risk_formula"),
    )


def knowledge_of(category: Column) -> Column:
    """Knowledge row of a class as a struct; an unknown class gets the benign row."""
    row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(KNOWLEDGE_FIELDS, values, strict=True)])
    table = F.create_map(*[x for name, values in KNOWLEDGE.items() for x in (F.lit(name), row(values))])
    found = F.try_element_at(table, F.upper(strip(category)))
    return F.coalesce(found, row(KNOWLEDGE["BENIGN"]))


def attack_knowledge(predictions: DataFrame) -> DataFrame:
    """Add ``model_prediction`` and ``interpretation`` structs to predicted classes.

    Columns used: ``predicted_class, confidence, threat_score``.
    """
    prediction = F.struct(
        F.col("predicted_class").alias("predicted_category"),
        F.round("confidence", 4).alias("confidence"),
        F.round("threat_score", 4).alias("threat_score"),
    )
    return predictions.withColumn("model_prediction", prediction).withColumn(
        "interpretation", knowledge_of(F.col("predicted_class"))
    )


def forecast_vs_actual(
    trajectory: DataFrame, series: DataFrame, window_seconds: int, mismatch: str = "MISMATCH"
) -> DataFrame:
    """Each forecast step beside the class that came, with lead label and outcome."""
    truth = series.select(
        "split", F.col("split_idx").alias("target_idx"), category_name(F.col("target_index")).alias("actual_class")
    )
    steps = trajectory.withColumn("target_idx", F.col("origin_idx") + F.col("step"))
    return steps.join(truth, ["split", "target_idx"]).select(
        *ORIGIN,
        "step",
        F.concat(F.lit("t+"), F.col("step").cast("string")).alias("horizon_label"),
        F.concat(F.lit("+"), (F.col("step") * window_seconds).cast("string"), F.lit("s")).alias("lead_time"),
        "predicted_class",
        "confidence",
        "threat_score",
        "actual_class",
        F.when(F.col("predicted_class") == F.col("actual_class"), "MATCH").otherwise(mismatch).alias("outcome"),
    )
