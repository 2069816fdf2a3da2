"""Class distributions: softmax, top class, threat score, tiers, lead time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtide.functions.labels import category_name
from flowtide.schema import BENIGN_INDEX, CLASS_NAMES

HIGH_THREAT = 0.70
MEDIUM_THREAT = 0.30


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda an outer expression is evaluated again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """Probabilities from logits, shifted by the maximum so that exp cannot overflow."""
    exps = lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    shares = lambda e: let(array_sum(e), lambda total: F.transform(e, lambda v: v / total))
    return let(logits, lambda x: let(exps(x), shares))


def threat_score(probabilities: Column) -> Column:
    return F.lit(1.0) - F.element_at(probabilities, BENIGN_INDEX + 1)


def top_index(probabilities: Column) -> Column:
    """First position of the maximum, counted from 0."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def top_name(probabilities: Column) -> Column:
    return category_name(top_index(probabilities))


def class_map(probabilities: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in CLASS_NAMES]), probabilities)


def risk_tier(threat: Column, suffix: str = "") -> Column:
    """Three tiers with inclusive lower bounds; ``suffix`` is added to each name."""
    return (
        F.when(threat >= HIGH_THREAT, F.lit("CRITICAL / HIGH" + suffix))
        .when(threat >= MEDIUM_THREAT, F.lit("ELEVATED / MEDIUM" + suffix))
        .otherwise(F.lit("NOMINAL / LOW" + suffix))
    )


def horizon_label(step: Column) -> Column:
    return F.concat(F.lit("t+"), step.cast("string"))


def lead_seconds(step: Column, window_seconds: int) -> Column:
    return (step * window_seconds).cast("bigint")


def lead_minutes(step: Column, window_seconds: int) -> Column:
    return F.round(step * window_seconds / F.lit(60.0), 2)
