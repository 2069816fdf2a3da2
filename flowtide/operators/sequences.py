"""Chronological splits and the sequences cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.plans.blocks import BLOCK_ROWS, keep_home, overlapping_blocks
from flowtide.plans.lookup import join_lookup
from flowtide.plans.ranking import HOT_ROWS, group_sizes, numbered

TRAIN_SHARE = 0.70
VAL_SHARE = 0.15
HISTORY = 10
HORIZON = 5


def chrono_split(
    windows: DataFrame,
    train_share: float = TRAIN_SHARE,
    val_share: float = VAL_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``split``: per capture the first windows train, the next val, the rest test.

    ``windows`` should be materialised.  Cut points are floors of double products.
    """
    sizes = group_sizes(windows, ["source_file"])
    placed = numbered(windows, ["source_file"], [F.col("window_idx")], "_place", sizes=sizes, hot_rows=hot_rows)
    sized = join_lookup(placed, sizes.table, ["source_file"], ["window_idx"])
    n_train = F.floor(F.lit(train_share).cast("double") * F.col("n"))
    n_val = F.floor(F.lit(val_share).cast("double") * F.col("n"))
    split = (
        F.when(F.col("_place") < n_train, "train").when(F.col("_place") < n_train + n_val, "val").otherwise("test")
    )
    return sized.withColumn("split", split).drop("_place", "n")


def reindex_split(windows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``split_idx``: dense position in the split, captures in name order."""
    order = [F.col("source_file"), F.col("window_idx")]
    return numbered(windows, ["split"], order, "split_idx", hot_rows=hot_rows)


def sequences(
    series: DataFrame,
    state: Column,
    history: int = HISTORY,
    within_file: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every ``history`` consecutive windows of a split with the window that follows.

    Rows: ``split, origin_idx`` (index of the last history window), ``history`` (oldest
    first), ``target_z`` and ``target_index`` of the next window.  Sequences cross capture
    borders as a split is one series; ``within_file`` keeps only those that do not.
    """
    rows, frame = overlapping_blocks(series.withColumn("z", state), ["split"], "split_idx", history - 1, 1, block_rows)
    past = frame.rowsBetween(-(history - 1), 0)
    built = keep_home(
        rows.withColumn("history", F.collect_list("z").over(past))
        .withColumn("target_z", F.lead("z").over(frame))
        .withColumn("target_index", F.lead("target_index").over(frame))
        .withColumn("first_file", F.first("source_file").over(past))
        .withColumn("next_file", F.lead("source_file").over(frame))
    ).where((F.size("history") == history) & F.col("target_z").isNotNull())
    if within_file:
        built = built.where(F.col("first_file") == F.col("next_file"))
    return built.select("split", F.col("split_idx").alias("origin_idx"), "history", "target_z", "target_index")


def histories(series: DataFrame, state: Column, history: int = HISTORY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The last ``history`` states of every window that has that many before it."""
    rows, frame = overlapping_blocks(series.withColumn("z", state), ["split"], "split_idx", history - 1, 0, block_rows)
    built = keep_home(rows.withColumn("history", F.collect_list("z").over(frame.rowsBetween(-(history - 1), 0))))
    return built.where(F.size("history") == history).select("split", F.col("split_idx").alias("origin_idx"), "history")


def next_step_pairs(series: DataFrame, features: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Statistics at t beside the class at t+1."""
    rows, frame = overlapping_blocks(series, ["split"], "split_idx", 0, 1, block_rows)
    out = keep_home(rows.withColumn("next_index", F.lead("target_index").over(frame)))
    return out.where(F.col("next_index").isNotNull()).select("split", "split_idx", *features, "next_index")


def horizon_pairs(
    series: DataFrame,
    predictions: DataFrame,
    history: int = HISTORY,
    horizon: int = HORIZON,
) -> DataFrame:
    """Predictions made at t for t+k beside the class seen there.

    ``predictions``: ``split, origin_idx, model, step, y_pred``.  Origins run from the first
    full history and one fewer than would be possible is used: n - history - horizon.
    """
    last = series.groupBy("split").agg(F.max("split_idx").alias("last_idx"))
    truth = series.select("split", F.col("split_idx").alias("target_idx"), F.col("target_index").alias("y_true"))
    made = (
        predictions.join(F.broadcast(last), "split")  # one row per split, three in all
        .where((F.col("origin_idx") >= history - 1) & (F.col("origin_idx") + horizon < F.col("last_idx")))
        .withColumn("target_idx", F.col("origin_idx") + F.col("step"))
    )
    return made.join(truth, ["split", "target_idx"]).select(
        "split", "model", F.col("step").alias("horizon"), "origin_idx", "y_true", "y_pred"
    )


def slide_state(history: Column, state: Column, length: int = HISTORY) -> Column:
    """Drop the oldest state and append the new one."""
    return F.concat(F.slice(history, 2, length - 1), F.array(state))


def split_class_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split", "target_category").agg(F.count(F.lit(1)).alias("n"))
