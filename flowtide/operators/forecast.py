"""Fitting and batch scoring of the two forecasters with MLlib.

Fits are distributed MLlib jobs; only fitted coefficients come to the driver.  Scoring is
a projection over array columns that holds the coefficients as constants.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide.functions.labels import category_name
from flowtide.functions.threat import array_sum, class_map, horizon_label, let, risk_tier, softmax, threat_score, top_index
from flowtide.operators.cleaning import fitted_values
from flowtide.operators.metrics import class_weights, weight_of
from flowtide.operators.risk import attack_knowledge, forecast_vs_actual, horizon_risk
from flowtide.operators.scaling import fit_standard_scaler
from flowtide.operators.sequences import HISTORY, HORIZON
from flowtide.plans.materialise import materialise
from flowtide.schema import N_CLASSES, WINDOW_FEATURES

ABSENT_CLASS_LOGIT = -1000.0
RIDGE = 1e-3
HEAD_PENALTY = 1e-3
# Relative change of the loss at which a fit stops.
TOLERANCE = 1e-10


def number_array(values) -> Column:
    """Nested Python numbers as one constant array column."""
    text = lambda v: "array(" + ",".join(map(text, v)) + ")" if isinstance(v, list) else f"{float(v)!r}D"
    return F.expr(text(values))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def affine(rows: list[list[float]], bias: list[float], vector: Column) -> Column:
    """rows . vector + bias as an array column."""
    products = let(vector, lambda v: F.transform(number_array(rows), lambda row: dot(row, v)))
    return F.zip_with(products, number_array(bias), lambda p, b: p + b)


# --- statistics baseline ------------------------------------------------------------


def baseline_fit(pairs: DataFrame, features: list[str] = WINDOW_FEATURES, max_iter: int = 1000) -> PipelineModel:
    """Balanced multinomial logistic regression: window statistics at t -> class at t+1.

    The pipeline standardises with the population deviation itself.  The penalty equals an
    inverse strength of 1 on weights that sum to the row count.
    """
    pairs = materialise(pairs.select(*features, "next_index"), "baseline_train")
    scale = fitted_values(fit_standard_scaler(pairs, features), "std_scaler")
    weights = {r.class_index: r.balanced_weight for r in class_weights(pairs, "next_index").collect() if r.n}
    scaled = ", ".join(f"({f} - ({scale[f][0]!r}D)) / {scale[f][1]!r}D AS std_{f}" for f in features)
    regression = LogisticRegression(
        family="multinomial",
        featuresCol="std_features",
        labelCol="next_index",
        weightCol="row_weight",
        maxIter=max_iter,
        regParam=1.0 / pairs.count(),
        standardization=False,
        tol=TOLERANCE,
    )
    pipeline = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"std_{f}" for f in features], outputCol="std_features"),
        regression,
    ])
    weighted = pairs.withColumn("row_weight", weight_of(F.col("next_index"), weights))
    return pipeline.fit(weighted)


def baseline_predict(model: PipelineModel, series: DataFrame) -> DataFrame:
    """Add ``y_pred`` and ``probabilities`` to window rows."""
    scored = model.transform(series)
    return scored.select(
        *series.columns,
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability").alias("probabilities"),
    )


def baseline_project(predicted: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The one prediction made at t stands for every step t+1 .. t+horizon."""
    return predicted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def baseline_head(model: PipelineModel) -> ThreatHead:
    """Coefficients of a fitted baseline, for standardised statistics."""
    regression = model.stages[-1]
    return ThreatHead(regression.coefficientMatrix.toArray().tolist(), regression.interceptVector.toArray().tolist())


def linear_predict(head: ThreatHead, series: DataFrame, features: list[str] = WINDOW_FEATURES) -> DataFrame:
    """Add ``y_pred`` and ``probabilities`` from coefficients and standardised statistics, as a projection."""
    p = softmax(affine(head.rows, head.bias, F.array(*[F.col(f).cast("double") for f in features])))
    scored = series.withColumn("probabilities", p)
    return scored.withColumn("y_pred", top_index(F.col("probabilities")))


# --- certificates of the fits -------------------------------------------------------


def logistic_gradient(rows: DataFrame, x: Column, y: Column, weight: Column, head: ThreatHead) -> DataFrame:
    """``class_index, position, gradient, rows``: gradient of the weighted mean log loss; position -1 is the intercept.

    Sums with map-side combine, one row per class and position come out.  At the optimum of a penalised
    fit each cell is minus the penalty's gradient, and zero for the intercept.
    """
    classes = len(head.rows)
    p = softmax(affine(head.rows, head.bias, F.col("x")))
    error = F.transform(p, lambda v, c: (v - F.when(F.col("y") == c, 1.0).otherwise(0.0)) * F.col("w"))
    cells = rows.select(x.alias("x"), y.alias("y"), weight.cast("double").alias("w")).withColumn("error", error).select(
        "error", "w", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"))).alias("pos", "value")
    )
    sums = cells.groupBy("pos").agg(
        F.array(*[F.sum(F.col("error")[c] * F.col("value")) for c in range(classes)]).alias("sums"),
        F.sum("w").alias("total"),
        F.count(F.lit(1)).alias("rows"),
    )
    return sums.select((F.col("pos") - 1).alias("position"), "total", "rows", F.posexplode("sums").alias("class_index", "sum")).select(
        "class_index", "position", (F.col("sum") / F.col("total")).alias("gradient"), "rows"
    )


def _with_penalty(gradient: DataFrame, penalty: list[list[float]]) -> DataFrame:
    """Adds a penalty's gradient, per class and position without the intercept."""
    own = number_array([[0.0, *row] for row in penalty])
    return gradient.withColumn("gradient", F.col("gradient") + own[F.col("class_index")][F.col("position") + 1])


def baseline_certificate(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """The penalised gradient of a fitted baseline on its training pairs: zero in every cell at the optimum."""
    head, n = baseline_head(model), pairs.count()
    weights = {r.class_index: r.balanced_weight for r in class_weights(pairs, "next_index").collect() if r.n}
    # The stages before the regression standardise.
    scaled = PipelineModel(model.stages[:-1]).transform(pairs)
    found = logistic_gradient(scaled, vector_to_array("std_features"), F.col("next_index"), weight_of(F.col("next_index"), weights), head)
    return _with_penalty(found, [[w / max(1, n) for w in row] for row in head.rows])


def head_certificate(head: ThreatHead, states: DataFrame, reg: float = HEAD_PENALTY) -> DataFrame:
    """The penalised gradient of a fitted threat head, per deviation of each state value: zero at the optimum.

    The penalty is on weights of values with deviation one.  Classes above the highest label have no weights of their own.
    """
    train = materialise(states.select("z", "target_index"), "head_certificate")
    weights = {r.class_index: r.weight for r in class_weights(train).collect()}
    d = len(head.rows[0])
    w = weight_of(F.col("target_index"), weights)
    deviation = [math.sqrt(v or 0.0) for v in _weighted_variances(train.withColumn("w", w), d)]
    found = logistic_gradient(train, F.col("z"), F.col("target_index"), w, head)
    penalty = [[reg * b * s * s for b, s in zip(row, deviation)] for row in head.rows]
    scale = number_array([1.0, *[s if s > 0 else 1.0 for s in deviation]])
    return _with_penalty(found, penalty).withColumn("gradient", F.col("gradient") / scale[F.col("position") + 1])


def _weighted_variances(rows: DataFrame, d: int) -> list[float]:
    """Unbiased variances of ``z`` under weights ``w``, centred first."""
    total = F.sum("w")
    means = rows.agg(*[(F.sum(F.col("z")[i] * F.col("w")) / total).alias(f"m{i}") for i in range(d)]).first()
    spread = [F.sum(F.pow(F.col("z")[i] - F.lit(means[i]), 2) * F.col("w")) / (total - F.sum(F.col("w") * F.col("w")) / total) for i in range(d)]
    return list(rows.agg(*spread).first())


def transition_certificate(model: Transition, seqs: DataFrame, reg: float = RIDGE) -> DataFrame:
    """``state_dim, lag_dim, residual, rows``: what is left of the ridge's normal equations, in deviations; zero if solved.

    Cell (i, j) is the mean product of lag i, centred and scaled, with the scaled error of state j, less the penalty; lag -1 is the
    mean error, which the intercept takes to zero.  A value that never varies counts as zero.
    """
    flat = materialise(seqs.select(F.flatten("history").alias("x"), F.col("target_z").alias("y")), "transition_certificate")
    lags, d = len(model.rows[0]), len(model.rows)
    cells = flat.select(F.posexplode(F.concat("x", "y")).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    stats = {r.pos: (r.mean, r.sd if r.sd and r.sd > 1e-12 * max(1.0, abs(r.mean)) else None) for r in cells.collect()}
    shift = number_array([stats[i][0] for i in range(lags)])
    unit = number_array([0.0 if stats[i][1] is None else 1.0 / stats[i][1] for i in range(lags)])
    size = number_array([0.0 if stats[lags + j][1] is None else 1.0 / stats[lags + j][1] for j in range(d)])
    predicted = affine(model.rows, model.bias, F.col("x"))
    error = F.zip_with(F.zip_with("y", predicted, lambda a, b: a - b), size, lambda e, s: e * s)
    centred = F.zip_with(F.zip_with("x", shift, lambda a, m: a - m), unit, lambda a, u: a * u)
    rows = flat.select(error.alias("error"), F.posexplode(F.concat(F.array(F.lit(1.0)), centred)).alias("pos", "v"))
    sums = rows.groupBy("pos").agg(
        F.array(*[F.avg(F.col("error")[j] * F.col("v")) for j in range(d)]).alias("means"), F.avg(F.col("v") * F.col("v")).alias("square"), F.count(F.lit(1)).alias("rows")
    )
    own = number_array([
        [0.0, *[0.0 if stats[i][1] is None or stats[lags + j][1] is None else b * stats[i][1] / stats[lags + j][1] for i, b in enumerate(row)]] for j, row in enumerate(model.rows)
    ])
    return sums.select((F.col("pos") - 1).alias("lag_dim"), "square", "rows", F.posexplode("means").alias("state_dim", "product")).select(
        "state_dim", "lag_dim",
        (F.col("product") - F.lit(reg) * F.col("square") * own[F.col("state_dim")][F.col("lag_dim") + 1]).alias("residual"), "rows",
    )


# --- stored coefficients ------------------------------------------------------------

BIAS = -1


def coefficient_table(spark: SparkSession, models: dict[str, Transition | ThreatHead]) -> DataFrame:
    """Linear models as rows ``model, row, position, value``; the bias of a row has position -1.

    As large as the models, which the driver holds anyway.
    """
    rows = [
        (name, j, i, float(x))
        for name, m in models.items()
        for j, row in enumerate(m.rows)
        for i, x in [(BIAS, m.bias[j]), *enumerate(row)]
    ]
    return spark.createDataFrame(rows, "model string, row int, position int, value double")


def models_of(table: DataFrame) -> dict[str, ThreatHead]:
    """The models of a ``coefficient_table``; a model with a gap in its rows or positions fails."""
    found: dict[str, dict[int, dict[int, float]]] = {}
    for r in table.collect():
        found.setdefault(r.model, {}).setdefault(r.row, {})[r.position] = r.value
    out = {}
    for name, rows in found.items():
        width = max(len(row) for row in rows.values()) - 1
        if any(set(row) != set(range(BIAS, width)) for row in rows.values()) or set(rows) != set(range(len(rows))):
            raise ValueError(f"coefficients of {name} are incomplete")
        out[name] = ThreatHead([[rows[j][i] for i in range(width)] for j in range(len(rows))], [rows[j][BIAS] for j in range(len(rows))])
    return out


# --- state forecaster ---------------------------------------------------------------


@dataclass
class Transition:
    """Next state = rows . (flattened history, oldest first) + bias."""

    rows: list[list[float]]
    bias: list[float]
    history: int = HISTORY


@dataclass
class ThreatHead:
    """Class logits = rows . state + bias."""

    rows: list[list[float]]
    bias: list[float]


def transition_fit(seqs: DataFrame, state_size: int, history: int = HISTORY, reg: float = RIDGE) -> Transition:
    """Ridge regression of the next state on the flattened lags, all dimensions at once.

    A first distributed pass takes mean and deviation of every lag and target, a second sums the
    Gram matrix of the rows centred and scaled by them, so that values far from zero lose no digits.
    Its size depends on the state only.  The normal equations are then solved on the driver.
    The penalty is relative to each lag's variance, so it does not depend on units.
    """
    row = F.concat(F.flatten("history"), F.col("target_z"))
    vectors = materialise(seqs.select(array_to_vector(row).alias("row")), "transition_train")
    scaler = StandardScaler(inputCol="row", outputCol="scaled", withMean=True, withStd=True).fit(vectors)
    mean, deviation = scaler.mean.toArray(), scaler.std.toArray()
    # Rounding leaves a constant column a deviation of a few last digits.
    varies = deviation > 1e-12 * np.maximum(1.0, np.abs(mean))
    deviation = np.where(varies, deviation, 1.0)
    scaled = MLUtils.convertVectorColumnsFromML(scaler.transform(vectors).select("scaled"), "scaled")
    gram = RowMatrix(scaled).computeGramianMatrix().toArray() / max(1, vectors.count())
    gram[~varies, :] = gram[:, ~varies] = 0.0
    lags = history * state_size
    xx, xy = gram[:lags, :lags], gram[:lags, lags:]
    variance = np.diag(xx)
    # A lag that never varies has no say; a 1 on its diagonal keeps the system solvable.
    penalty = np.where(variance > 0, reg * variance, 1.0)
    rows = np.linalg.solve(xx + np.diag(penalty), xy).T * deviation[lags:, None] / deviation[None, :lags]
    bias = mean[lags:] - rows @ mean[:lags]
    return Transition(rows.tolist(), bias.tolist(), history)


def threat_head_fit(states: DataFrame, max_iter: int = 1000, reg: float = HEAD_PENALTY) -> ThreatHead:
    """Class distribution from a state, weighted by the clipped class weights.

    Columns used: ``z`` and ``target_index``.
    """
    train = materialise(states.select(array_to_vector("z").alias("features"), "target_index"), "head_train")
    weights = {r.class_index: r.weight for r in class_weights(train).collect()}
    model = LogisticRegression(
        family="multinomial", labelCol="target_index", weightCol="w", maxIter=max_iter, regParam=reg, tol=TOLERANCE
    ).fit(train.withColumn("w", weight_of(F.col("target_index"), weights)))
    rows = model.coefficientMatrix.toArray().tolist()
    bias = model.interceptVector.toArray().tolist()
    missing = N_CLASSES - len(rows)
    return ThreatHead(rows + [[0.0] * len(rows[0])] * missing, bias + [ABSENT_CLASS_LOGIT] * missing)


def rollout(
    histories: DataFrame, transition: Transition, head: ThreatHead, horizon: int = HORIZON
) -> DataFrame:
    """Recursive forecast of ``horizon`` steps for every origin, as one row per step.

    Each step predicts from the last ``history`` states, predicted ones included, and
    appends its result.  A narrow projection: no shuffle, no join.
    """
    n = transition.history
    step = lambda seq, _k: F.concat(
        seq, F.array(affine(transition.rows, transition.bias, F.flatten(F.slice(seq, -n, n))))
    )
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("history"), step)
    states = histories.select("split", "origin_idx", F.posexplode(F.slice(path, -horizon, horizon)).alias("pos", "state"))
    return classify_steps(states.withColumn("step", F.col("pos") + 1).drop("pos"), head)


def classify_steps(states: DataFrame, head: ThreatHead) -> DataFrame:
    """Trajectory rows from predicted states: ``split, origin_idx, step, state``."""
    scored = states.withColumn("p", softmax(affine(head.rows, head.bias, F.col("state"))))
    return trajectory_rows(scored)


def trajectory_rows(scored: DataFrame) -> DataFrame:
    """Top class, confidence, threat, tier and class map from probabilities ``p``."""
    p = F.col("p")
    return (
        scored.withColumn("class_index", top_index(p))
        .withColumn("threat_score", threat_score(p))
        .select(
            "split",
            "origin_idx",
            "step",
            horizon_label(F.col("step")).alias("horizon_label"),
            "state",
            "class_index",
            category_name(F.col("class_index")).alias("predicted_class"),
            F.array_max("p").alias("confidence"),
            "threat_score",
            risk_tier(F.col("threat_score")).alias("risk_tier"),
            class_map(p).alias("class_probabilities"),
        )
    )


def as_predictions(trajectory: DataFrame, model: str = "forecaster") -> DataFrame:
    return trajectory.select("split", "origin_idx", F.lit(model).alias("model"), "step", F.col("class_index").alias("y_pred"))


def forecast_report(
    trajectory: DataFrame,
    series: DataFrame,
    overview: DataFrame,
    attribution: DataFrame,
    split: str | None = None,
    origin_idx: int | None = None,
    window_seconds: int = 30,
    history: int = HISTORY,
    horizon: int = HORIZON,
) -> DataFrame:
    """One report row per origin: state, trajectory, risk, knowledge, attribution.

    Origins are those of ``trajectory`` whose whole horizon is known; ``split`` keeps those of one split,
    ``origin_idx`` one origin of it (without a full history or future: ``origin_idx = history``).
    ``overview`` carries split and split_idx; ``attribution`` holds one row per origin.
    """
    here = F.lit(True) if split is None else F.col("split") == split
    if origin_idx is not None:
        n = series.where(here).count()
        here &= F.col("origin_idx") == (origin_idx if origin_idx >= history and origin_idx + horizon < n else history)
    steps = trajectory.where(here)
    compared = forecast_vs_actual(steps, series, window_seconds)
    first = attack_knowledge(steps.where(F.col("step") == 1)).select("split", "origin_idx", "interpretation")
    # At most ``horizon`` steps of an origin are gathered.
    path = compared.groupBy("split", "origin_idx").agg(
        F.array_sort(F.collect_list(F.struct("step", "lead_time", "predicted_class", "confidence", "threat_score", "actual_class", "outcome"))).alias("trajectory")
    ).where(F.size("trajectory") == horizon)
    state = overview.withColumn("origin_idx", F.col("split_idx")).where(here)
    key = ["split", "origin_idx"]
    return (
        state.select(*key, "start_time", "active_hosts", "active_edges", "target_category")
        .join(path, key)
        .join(horizon_risk(steps), key)
        .join(first, key)
        .join(attribution.where(here), key)
    )
