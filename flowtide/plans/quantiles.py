"""Exact quantiles of many columns over tables of any size.

Spark's exact ``percentile`` keeps every distinct value of a column in one task.  Here one aggregation brackets all wanted
ranks of all columns by mergeable sketches of a fixed size, a second one counts exactly what lies below and inside
each bracket, and only the values inside, a few thousandths of a column, are looked at one by one.  Rows are never
multiplied by the number of columns; the input is written once, as a table of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.plans.materialise import materialise

# A sketch tells a rank to this part of all rows; brackets reach twice as far to both sides.
ACCURACY = 1_000
# Brackets up to this many rows are resolved value by value at once.
SMALL_BUCKET = 200_000


@dataclass
class _Bracket:
    """Ranks ``first`` and ``last`` of a column lie between values ``lo`` and ``hi``, both included."""

    column: int
    prob: float
    first: int
    last: int
    share: float
    lo: float
    hi: float
    below: int
    inside: int
    done: bool = False

    @property
    def single(self) -> bool:
        return self.lo == self.hi

    def value(self) -> Column:
        return F.col(f"c{self.column}")

    def within(self) -> Column:
        return self.value().between(self.lo, self.hi)


def _reach(rank_lo: float, rank_hi: float, n: int) -> tuple[float, float]:
    """Shares of n values a sketch is asked for, so that the wanted ranks lie between its answers."""
    margin = 2.0 / ACCURACY
    return max(0.0, rank_lo / n - margin), min(1.0, (rank_hi + 1) / n + margin)


def _whole(table: DataFrame, columns: int, probabilities: Sequence[float]) -> list[_Bracket]:
    """A bracket per column and probability that spans the column; columns without a value have none."""
    names = [F.col(f"c{i}") for i in range(columns)]
    facts = table.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(names)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(names)],
    ).first()
    out = []
    for i in range(columns):
        n = facts[f"n{i}"]
        for p in probabilities if n else ():
            place = (n - 1) * float(p)
            first = int(place)
            out.append(_Bracket(i, float(p), first, min(first + 1, n - 1), place - first, facts[f"lo{i}"], facts[f"hi{i}"], 0, n))
    return out


def _narrowed(table: DataFrame, brackets: list[_Bracket]) -> None:
    """Narrow each bracket by a sketch of the values inside; where its counts miss a rank, that side stays as it was."""
    ends = []
    for b in brackets:
        reach = _reach(b.first - b.below, b.last - b.below, b.inside)
        ends.append(F.percentile_approx(F.when(b.within(), b.value()), [*reach], ACCURACY))
    asked = table.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    cells = []
    for i, (b, (lo, hi)) in enumerate(zip(brackets, asked)):
        v = b.value()
        cells += [F.count(F.when(v < lo, 1)).alias(f"b{i}"), F.count(F.when(v.between(lo, hi), 1)).alias(f"i{i}"), F.count(F.when((v >= b.lo) & (v < lo), 1)).alias(f"l{i}")]
    counts = table.agg(*cells).first()
    for i, (b, (lo, hi)) in enumerate(zip(brackets, asked)):
        below, inside = counts[f"b{i}"], counts[f"i{i}"]
        before = b.inside
        if b.first >= below:
            b.lo, b.inside, b.below = lo, b.inside - counts[f"l{i}"], below
        if b.last < below + inside:
            b.hi, b.inside = hi, below + inside - b.below
        # A value that holds most of a bracket can't be narrowed further; equal values are counted, not listed.
        b.done = 2 * b.inside > before


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """Rows ``feature, prob, value``: linearly interpolated quantiles, nulls left out.

    A column without any value yields no row.  Brackets above ``small_bucket`` rows are narrowed again, which divides
    them by some hundreds each time.  Columns times probabilities numbers come to the driver.
    """
    columns = list(columns)
    table = materialise(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "quantile_input")
    brackets = _whole(table, len(columns), probabilities)
    while wide := [b for b in brackets if not b.single and not b.done and b.inside > small_bucket]:
        _narrowed(table, wide)
    found = {id(b): (b.lo, b.lo) for b in brackets if b.single}
    still = [b for b in brackets if not b.single]
    found |= {id(still[i]): ends for i, ends in _resolved(table, still).items()} if still else {}
    rows = [(columns[b.column], b.prob, v0 + (v1 - v0) * b.share) for b in brackets for v0, v1 in [found[id(b)]]]
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, value double")


def _resolved(table: DataFrame, brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """The values at both ranks of each bracket, by its number, from the values inside with their counts."""
    spans: dict[tuple, list[int]] = {}
    for i, b in enumerate(brackets):
        spans.setdefault((b.column, b.lo, b.hi, b.below), []).append(i)
    groups = list(spans.values())
    cells = F.array(*[F.struct(F.lit(g).alias("span"), F.when(brackets[of[0]].within(), brackets[of[0]].value()).alias("value")) for g, of in enumerate(groups)])
    counts = table.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("span", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("span").orderBy("value")))
    ranks = F.array(*[F.array(*[F.lit(r - b.below) for i in of for b in [brackets[i]] for r in (b.first, b.last)]) for of in groups])
    # A value stands at the ranks from those before it up to its own count: at most a few of the wanted ones.
    wanted = placed.withColumn("wanted", F.element_at(ranks, F.col("span") + 1)).select(
        "span", "value", F.posexplode(F.transform("wanted", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("at", "here")
    )
    found = {(r.span, r.at): r.value for r in wanted.where("here").select("span", "at", "value").collect()}
    return {i: (found[g, 2 * k], found[g, 2 * k + 1]) for g, of in enumerate(groups) for k, i in enumerate(of)}
