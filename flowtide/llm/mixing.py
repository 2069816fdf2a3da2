"""Mixing sources to target weights, by DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.llm.common import WORD, unused
from flowtide.plans.materialise import materialise

#: Rows of one source that are ordered in one task, on average.
SLICE_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column, seed: str) -> Column:
    """Hash-random key of a row: the same for equal ids in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sources: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table with one row per source (``source``, ``source_size``).

    Sources in code-point order, null last, weigh ``weights`` in turn.  Together they are to
    give ``total_share`` of all sizes, each in proportion to its weight but at most
    ``max_epochs`` times its size; what a source cannot give is shared by the others.  That is
    ``min(max_epochs * size, level * weight)`` with one level for all: sources are taken in the
    order in which a rising level fills them, and the level is the first that fits (those after it are lower).
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("most", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("wanted") - F.col("full")) / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(everything))
        .withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")))
        .select("source", "source_size", "target")
    )


def taken(
    rows: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    total_share: float = 1.5,
    max_epochs: float = 2,
    seed: str = "mix",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """How many units the mix takes of each row of a written table ``doc_id, source, size, ...``.

    Each row gets a hash-random key (md5 of seed and id).  A source's key range is cut into equal
    slices of about ``slice_rows`` rows, which a range sort of uniform keys would give; slice totals and
    their prefix sums are one small table, running sums inside a slice are one sorted task
    each, so a source of any size is spread.  A source's budget is its target in whole units:
    whole epochs take every row in full, the rest takes rows in key order up to the exact unit,
    cutting the last.  Adds ``source_size, target, epochs, part`` (units of the broken epoch) and
    ``taken``.

    Ties (repeated ids) are ordered by size, then by the columns left, and equal rows stand for each
    other, so reruns agree.  A size of 0 takes 0.  Columns of ``rows`` keep their values.
    """
    ties = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    key = order_key(F.col("doc_id"), seed)
    sums = rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    sources = targets(sums.select("source", "source_size"), weights, total_share, max_epochs).join(
        sums.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    budget = F.floor("target").cast("bigint")
    # One row per source.
    plan = materialise(
        sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("_slices", F.ceil(F.col("_n") / slice_rows).cast("bigint"))
        .drop("_n"),
        "mix_sources",
    )
    # The first 12 hex digits, as a share of their range.
    share = F.conv(F.substring("_key", 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    planned = plan.withColumnRenamed("source", "_s")
    keyed = (
        rows.withColumn("_key", key)
        .join(planned, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_slice", F.floor(share * F.col("_slices")).cast("bigint"))
    )
    slices = keyed.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        F.col("source").alias("_s"), F.col("_slice").alias("_k"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        keyed.withColumn("_in_slice", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")))
    )
    left = F.col("_rest") - F.col("_start") - F.col("_in_slice")
    return (
        placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select(*rows.columns, "source_size", "target", "epochs", "part", "taken")
    )


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The slim table the mix is planned on: ids, sources, word counts and a hash of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, epochs, part, taken``.

    A null text has size 0 and takes 0; a null source is a source of its own, last in order; an
    empty table gives no rows; other columns are ignored.
    """
    return taken(materialise(sized(docs, id_col, text_col, source_col), "mix_sizes"), **parameters).drop("text_hash")


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, white space before it included."""
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, ends), F.lit(1), count.cast("int")), "")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str | None = None,
    **parameters,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per epoch, and first words where one is cut.

    A document comes once for each whole epoch of its source.  In the broken epoch it comes whole if
    its key lies before the source's cut, not at all behind it, and at the cut (one document
    per source) with its first words.  Only the cuts, one row per source, are joined to the texts.
    Repeated rows at the cut share its words evenly.  A document without words comes once for
    each whole epoch, and in the broken one if its key lies before the cut.  ``chars_col``, if
    given, is set to the length of a text that was cut.

    A null text has no words; a null source is a source of its own; a text of any length is cut inside its row; an empty table
    gives no rows; other columns are passed on under any name.
    """
    seed = parameters.get("seed", "mix")
    # Planned from ids, sources and word counts alone, as in ``mix``.
    slim = materialise(taken(materialise(sized(docs, id_col, text_col, source_col), "mix_sizes"), **parameters), "mix_taken")
    place = lambda i, size, text: F.struct(
        order_key(i, seed).alias("key"), i.alias("id"), size.alias("size"), text.alias("hash")
    )
    here = place(F.col("doc_id"), F.col("size"), F.col("text_hash"))
    last = slim.groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(F.col("part") > 0, here)).alias("_cut"))
    cuts = materialise(last.withColumnRenamed("source", "_s"), "mix_cuts")
    tied = (
        slim.join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (here == F.col("_cut")))
        .groupBy(F.col("_s").alias("_t"))
        .agg((F.floor(F.sum("part") / F.count(F.lit(1)))).cast("int").alias("_words"))
    )
    cuts = materialise(cuts.join(tied, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"), "mix_cuts")
    # The documents may have columns of any name.
    of_source, epochs, cut, some, new_text = unused(docs, "_source", "_epochs", "_cut", "_words", "_text")
    cuts = cuts.select(F.col("_s").alias(of_source), F.col("_epochs").alias(epochs), F.col("_cut").alias(cut), F.col("_words").alias(some))
    text = F.col(f"`{text_col}`")
    own = place(F.col(f"`{id_col}`").cast("bigint"), word_count(text), F.xxhash64(text))
    whole = F.array_repeat(text, F.col(epochs).cast("int"))
    broken = (
        F.when(F.col(cut).isNull() | (own > F.col(cut)), F.array().cast("array<string>"))
        .when(own < F.col(cut), F.array(text))
        .otherwise(F.filter(F.array(first_words(text, F.col(some))), lambda x: F.length(x) > 0))
    )
    mixed = (
        docs.join(cuts, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(of_source)))
        .withColumn(new_text, F.explode(F.concat(whole, broken)))
    )
    new = {text_col: F.col(new_text)}
    if chars_col:
        new[chars_col] = F.when(F.length(new_text) < F.length(text), F.length(new_text)).otherwise(F.col(f"`{chars_col}`"))
    types = dict(docs.dtypes)
    return mixed.select(*[(new[c].cast(types[c]) if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])
