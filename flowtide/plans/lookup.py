"""Joins of a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.plans.materialise import materialise_with, stored_bytes

# Compressed on disk; a few times as much in memory.
BROADCAST_BYTES = 16 * 1024 * 1024
SALTS = 32


@dataclass
class HotKeys:
    """Keys with very many rows, written, and how many there are."""

    table: DataFrame
    count: int


def hot_keys(counts: DataFrame, keys: Sequence[str], limit: int, n: str = "n") -> HotKeys:
    """Keys of ``counts`` whose ``n`` is above ``limit``: at most all rows / limit of them."""
    table, facts = materialise_with(
        counts.where(F.col(n) > limit).select(*keys), "hot_keys", rows=F.count(F.lit(1))
    )
    return HotKeys(table, facts["rows"])


def salt_of(spread: Sequence[str], salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def join_lookup(
    big: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join a materialised lookup ``table`` (one row per key) onto ``big``.

    The table is broadcast when its stored size allows it, so ``big`` is not shuffled.
    Otherwise each lookup row is repeated once per salt and ``big`` takes a salt from
    its ``spread`` columns, which cuts a key that owns a third of ``big`` into ``salts``
    parts.  ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    keys = list(keys)
    if stored_bytes(table) <= max_bytes:
        return big.join(F.broadcast(table), keys, how)
    salted = big.withColumn("_salt", salt_of(spread, salts))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_by_key(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    hot: HotKeys,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of two large tables where ``right`` has one row per key.

    Keys in ``hot`` are salted on the left and repeated on the right, the rest joins as
    it is.
    """
    keys = list(keys)
    if not hot.count:
        return left.join(right, keys, how)
    flags = hot.table.select(*keys, F.lit(True).alias("_hot"))
    is_hot = F.coalesce("_hot", F.lit(False))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = (
        join_lookup(left, flags, keys, spread, "left")
        .withColumn("_salt", F.when(is_hot, salt_of(spread, salts)).otherwise(0))
        .drop("_hot")
    )
    repeated = join_lookup(right, flags, keys, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
