"""Forecast quality: confusion counts and everything derived from them.

Only ``confusion_matrix`` and ``dual_loss`` read prediction rows.  The rest works on the
confusion counts, at most classes x classes rows per model and horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.labels import category_name, literal_map
from flowtide.functions.threat import array_sum, horizon_label, lead_minutes, lead_seconds
from flowtide.plans.materialise import materialise
from flowtide.schema import BENIGN_INDEX, N_CLASSES

GROUP = ["model", "horizon"]
BENIGN_WEIGHT = 0.20
MAX_WEIGHT = 5.0


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*GROUP, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1, support for all seven classes, keyed by class index."""
    zero = F.lit(0).cast("bigint")
    cell = lambda cls, support, pred, hit: F.struct(
        cls.cast("int").alias("class_index"), support.alias("support"), pred.alias("predicted"), hit.alias("hits")
    )
    n = F.col("n")
    cells = F.array(
        cell(F.col("y_true"), n, zero, F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero)),
        cell(F.col("y_pred"), zero, n, zero),
        *[cell(F.lit(i), zero, zero, zero) for i in range(N_CLASSES)],
    )
    sums = (
        confusion.select(*GROUP, F.inline(cells))
        .groupBy(*GROUP, "class_index")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return sums.select(
        *GROUP,
        "class_index",
        category_name(F.col("class_index")).alias("class_name"),
        _safe(F.col("hits"), F.col("predicted")).alias("precision"),
        _safe(F.col("hits"), F.col("support")).alias("recall"),
        _safe(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
    )


def macro_metrics(classes: DataFrame) -> DataFrame:
    """Means over the classes that occur in truth or prediction; F1 also by support."""
    present = classes.where((F.col("support") > 0) | (F.col("predicted") > 0))
    return present.groupBy(*GROUP).agg(
        F.avg("f1").alias("macro_f1"),
        _safe(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def false_positive_rate(confusion: DataFrame) -> DataFrame:
    """Benign windows predicted as any attack, as a share of benign windows."""
    benign = F.col("y_true") == BENIGN_INDEX
    false_alarm = F.sum(F.when(benign & (F.col("y_pred") != BENIGN_INDEX), F.col("n")).otherwise(0))
    return confusion.groupBy(*GROUP).agg(
        _safe(false_alarm, F.sum(F.when(benign, F.col("n")).otherwise(0))).alias("false_positive_rate")
    )


def model_metrics(confusion: DataFrame) -> DataFrame:
    return macro_metrics(class_metrics(confusion)).join(false_positive_rate(confusion), GROUP)


def model_comparison(metrics: DataFrame, forecaster: str = "forecaster", baseline: str = "baseline") -> DataFrame:
    """Both models side by side per horizon; the F1 difference has four decimals."""
    names = ["macro_f1", "weighted_f1", "macro_precision", "macro_recall", "false_positive_rate"]
    pick = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    return metrics.groupBy("horizon").agg(
        *[pick(forecaster, c).alias(f"forecaster_{c}") for c in names],
        *[pick(baseline, c).alias(f"baseline_{c}") for c in names],
    ).withColumn("f1_improvement", F.round(F.col("forecaster_macro_f1") - F.col("baseline_macro_f1"), 4))


def class_blocks(classes: DataFrame, forecaster: str = "forecaster", baseline: str = "baseline") -> DataFrame:
    """Per horizon one array per model: precision, recall, F1 and support of every class, by class index."""
    block = F.struct("class_index", "class_name", "precision", "recall", "f1", "support")
    # Seven classes per model and horizon.
    pick = lambda model: F.array_sort(F.collect_list(F.when(F.col("model") == model, block)))
    return classes.groupBy("horizon").agg(
        pick(forecaster).alias("forecaster_classes"), pick(baseline).alias("baseline_classes")
    )


def evaluate_horizons(
    pairs: DataFrame, window_seconds: int, forecaster: str = "forecaster", baseline: str = "baseline"
) -> DataFrame:
    """Per horizon: lead time, metrics of forecaster and baseline, difference, and each model's classes."""
    # Written, as several aggregates below read it: at most classes x classes rows per model and horizon.
    confusion = materialise(confusion_matrix(pairs), "confusion")
    compared = model_comparison(model_metrics(confusion), forecaster, baseline)
    compared = compared.join(class_blocks(class_metrics(confusion), forecaster, baseline), "horizon")
    step = F.col("horizon")
    return compared.select(
        "horizon",
        horizon_label(step).alias("horizon_label"),
        lead_seconds(step, window_seconds).alias("lead_time_seconds"),
        lead_minutes(step, window_seconds).alias("lead_time_minutes"),
        *[c for c in compared.columns if c != "horizon"],
    )


def _class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.agg(*[F.count(F.when(F.col(target) == i, 1)).alias(f"n_{i}") for i in range(N_CLASSES)])


def class_weights(train: DataFrame, target: str = "target_index") -> DataFrame:
    """Per class: loss weight n / (7 max(count, 1)), benign pinned, clipped; and the
    balanced variant n / (classes present * count), null where a class does not occur."""
    counts = F.array(*[F.col(f"n_{i}") for i in range(N_CLASSES)])
    one = _class_counts(train, target).withColumn("counts", counts)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    present = F.size(F.filter("counts", lambda x: x > 0))
    rows = one.withColumn("total", total).withColumn("present", present).select(
        F.posexplode("counts").alias("class_index", "n"), "total", "present"
    )
    raw = F.col("total") / (F.lit(float(N_CLASSES)) * F.greatest(F.col("n"), F.lit(1)))
    pinned = F.when(F.col("class_index") == BENIGN_INDEX, F.lit(BENIGN_WEIGHT)).otherwise(raw)
    return rows.select(
        "class_index",
        category_name(F.col("class_index")).alias("class_name"),
        "n",
        F.least(F.greatest(pinned, F.lit(BENIGN_WEIGHT)), F.lit(MAX_WEIGHT)).alias("weight"),
        F.when(F.col("n") > 0, F.col("total") / (F.col("present") * F.col("n"))).alias("balanced_weight"),
    )


def weight_of(target: Column, weights: dict[int, float]) -> Column:
    return F.try_element_at(literal_map(weights), target.cast("int"))


def _log_loss(logits: Column, target: Column) -> Column:
    top = F.array_max(logits)
    spread = array_sum(F.transform(logits, lambda x: F.exp(x - top)))
    return F.log(spread) + top - F.element_at(logits, target.cast("int") + 1)


def dual_loss(scored: DataFrame, weights: dict[int, float] | None = None, lam: float = 1.0) -> DataFrame:
    """State error plus weighted class error of a scored table, as one row.

    Columns: ``pred_z, actual_z, pred_logits, actual_logits`` arrays and ``y``.
    """
    w = weight_of(F.col("y"), weights) if weights else F.lit(1.0)
    error = array_sum(F.zip_with("pred_z", "actual_z", lambda p, a: (p - a) * (p - a)))
    sums = scored.agg(
        F.sum(error).alias("sq"),
        F.sum(F.size("pred_z")).alias("cells"),
        F.sum(w * _log_loss(F.col("actual_logits"), F.col("y"))).alias("ce_a"),
        F.sum(w * _log_loss(F.col("pred_logits"), F.col("y"))).alias("ce_p"),
        F.sum(w).alias("w"),
    )
    mse = F.col("sq") / F.col("cells")
    ce = F.lit(0.5) * (F.col("ce_a") / F.col("w") + F.col("ce_p") / F.col("w"))
    return sums.select((mse + F.lit(lam) * ce).alias("total_loss"), mse.alias("mse_loss"), ce.alias("ce_loss"))
