"""Quality rules and robust outliers of text statistics, by DataFrame functions only."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.llm.common import SPACES, words_of
from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Share of rows a covariance estimate rests on, and rounds of improving that choice.
CORE, STEPS = 0.75, 3
#: An estimate counts as its number of rows, the wider one it is drawn towards as this many: about what a
#: covariance of four statistics takes.
PRIOR_ROWS = 30
#: Standard deviations that the estimate of all texts is drawn towards, for tables of a few rows.
PRIOR_DEVIATIONS = (0.25, 0.7, 1.5, 1.5)
#: Largest squared distance that is kept: one in ten thousand normal vectors of four numbers lies beyond.
CUTOFF = 23.51
#: Standard deviations, given the statistics before, count as at least this much: a guard against singular shapes.
FLOORS = (0.05, 0.2, 0.3, 0.3)
DIMENSIONS = len(FLOORS)


def text_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of the whole text.

    Words in repeated windows: the 64-bit hashes of a text's five-word windows are compared within
    the row; only where two are equal are they sorted with their places, and the words each
    repeated window adds to the ones before it are summed.
    """
    has_word = r"[^\x20\x09-\x0D]"
    rows = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    rows = rows.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(has_word)),
    })
    windows = F.when(
        F.size("_words") > WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.struct(F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("_windows", windows).withColumn(
        "_repeats", F.size(F.array_distinct(F.transform("_windows", lambda w: w["h"]))) < F.size("_windows")
    )
    ordered = F.when(F.col("_repeats"), F.sort_array("_windows")).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("_sorted", ordered)
    same = lambda i, j: F.coalesce(F.get("_sorted", j)["h"] == F.get("_sorted", i)["h"], F.lit(False))
    repeated = F.sort_array(F.transform(
        F.filter(F.transform("_sorted", lambda w, i: F.struct(w["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("r"))), lambda w: w["r"]),
        lambda w: w["i"],
    ))
    rows = rows.withColumn("_repeated", F.when(F.col("_repeats"), repeated).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(
        "_repeated",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).cast("bigint").alias("n"), (i + WINDOW).cast("int").alias("end")),
        lambda acc: acc["n"],
    )
    length = F.length("_text")
    return rows.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.translate("_text", SPACES, "")).cast("bigint"),
        "n_symbols": (length - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": covered,
    }).drop("_text", "_words", "_lines", "_windows", "_repeats", "_sorted", "_repeated")


def _vector() -> list[Column]:
    """Statistics on scales where ordinary texts are roughly normal."""
    share = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


X = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _chi_square(x: float, dimensions: int) -> float:
    """Distribution function, for an even number of dimensions."""
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(dimensions // 2))


def _consistency(core: float, dimensions: int) -> float:
    """What the covariance of the innermost ``core`` of normal rows must be multiplied by."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, dimensions) < core else (low, middle)
    return core / _chi_square(low, dimensions + 2)


def _cholesky(shape: DataFrame) -> DataFrame:
    """Add ``l<i><j>``: the lower factor of the covariances ``c<i><j>``, column by column."""
    for j in range(DIMENSIONS):
        pivot = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        # A variance is its pivot or more, so this bounds both; two statistics that go together count as one.
        shape = shape.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(FLOORS[j] ** 2))))
        below = {
            f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")
            for i in range(j + 1, DIMENSIONS)
        }
        shape = shape.withColumns(below) if below else shape
    return shape


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the written row of their group; one group may own a third of all rows, so they are not dealt by it."""
    return join_lookup(rows, groups, ["grp"], X)


def _distances(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance to the group's centre ``m<i>`` under its factor."""
    out = _with_group(rows, shapes)
    for i in range(DIMENSIONS):
        solved = (F.col(X[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}")
        out = out.withColumn(f"z{i}", solved)
    return out.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(DIMENSIONS)), F.lit(0.0)))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations of each group, as a centre and a diagonal factor."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(X)])
    middle = materialise(middle, "medians")
    off = _with_group(rows, middle).groupBy("grp").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMENSIONS)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, x in enumerate(X)],
    )
    factor = {f"l{i}{j}": F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])) if i == j else F.lit(0.0) for i, j in PAIRS}
    return materialise(off.withColumns(factor).select("grp", *[f"m{i}" for i in range(DIMENSIONS)], *factor), "shapes")


def fitted(rows: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group ``grp`` of a table with ``x0..x3``: ``n, m<i>, c<i><j>``.

    Starts from medians and median deviations; each step takes the ``core`` of rows nearest to the centre
    under the current shape and re-estimates mean and covariance from those, which never raises the
    determinant.  Which rows those are is read off a histogram of distances on a logarithmic
    scale: groups of any size cost aggregates with map-side combine and nothing is sorted.
    """
    shapes = _start(rows)
    factor = _consistency(core, DIMENSIONS)
    step = F.floor(F.log2(F.col("d2") + 1e-6) * 16).cast("int")
    of_group = Window.partitionBy("grp")
    for _ in range(steps):
        near = _distances(rows, shapes).select("grp", *X, step.alias("step"))
        counts = near.groupBy("grp", "step").agg(F.count(F.lit(1)).alias("n"))
        # One row per group and step of the histogram.
        limits = (
            counts.withColumn("upto", F.sum("n").over(of_group.orderBy("step")))
            .withColumn("all", F.sum("n").over(of_group))
            .where(F.col("upto") >= core * F.col("all"))
            .groupBy("grp")
            .agg(F.min("step").alias("limit"), F.first("all").alias("n"))
        )
        limits = materialise(limits, "limits")
        chosen = _with_group(near, limits).where("step <= limit")
        moments = chosen.groupBy("grp").agg(
            F.first("n").alias("n"),
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in PAIRS]
        )
        scaled = {f"c{i}{j}": F.col(f"c{i}{j}") * factor for i, j in PAIRS}
        moments = materialise(moments.withColumns(scaled), "moments")
        shapes = _factored(moments)
    return moments


def _factored(moments: DataFrame) -> DataFrame:
    """``grp``, centre and factor, as a written table."""
    return materialise(_cholesky(moments).select("grp", *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i, j in PAIRS]), "shapes")


MOMENTS = [*[f"m{i}" for i in range(DIMENSIONS)], *[f"c{i}{j}" for i, j in PAIRS]]
LEVELS = ("of_all", "of_lang", "grp")


def _levels(rows: DataFrame) -> DataFrame:
    """Add the names of all texts, of the language and of the language and source: ``of_all, of_lang, grp``."""
    named = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    return rows.withColumns({"of_all": F.lit("{}"), "of_lang": named("lang"), "grp": named("lang", "source")})


def _drawn(moments: DataFrame, groups: DataFrame, prior_rows: int) -> DataFrame:
    """Moments of each group of ``groups`` (``of_all, of_lang, grp``), those of few rows drawn towards wider ones.

    All texts are drawn towards fixed deviations, each language towards all texts, each language and source towards its
    language: the moments of a mixture of both, weighted by the rows and ``prior_rows``.
    """
    out = groups
    for k, level in enumerate(LEVELS):
        own = moments.select(F.col("grp").alias(f"_{k}"), F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in MOMENTS])
        # One row per group on either side.
        out = materialise(out.join(own, F.col(level) == F.col(f"_{k}")), "drawn")
        wider = {c: F.col(c) for c in MOMENTS}
        if not k:
            fixed = {f"c{i}{j}": F.lit(PRIOR_DEVIATIONS[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
            wider = {f"m{i}": F.col(f"_m{i}") for i in range(DIMENSIONS)} | fixed
        share = F.col("_n") / (F.col("_n") + prior_rows)
        drawn = {c: share * F.col(f"_{c}") + (1 - share) * wider[c] for c in MOMENTS}
        for i, j in PAIRS:
            apart = (F.col(f"_m{i}") - wider[f"m{i}"]) * (F.col(f"_m{j}") - wider[f"m{j}"])
            drawn[f"c{i}{j}"] = drawn[f"c{i}{j}"] + share * (1 - share) * apart
        out = out.withColumns(drawn).select(*LEVELS, *MOMENTS)
    return out


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
    prior_rows: int = PRIOR_ROWS,
) -> DataFrame:
    """Per document: the statistics, ``base_failed``, ``distance2`` (null where the base rule decides) and ``kept``.

    The base rule fails texts under ten words and those with over a fifth of their words in repeated
    five-word windows.  Of the others, each language and source gives a robust mean and covariance of
    the transformed statistics, drawn towards those of its language the more the fewer texts it has, and these towards
    all texts' (``_drawn``); texts farther than ``cutoff`` from it are rejected, in groups of any size.

    A null or empty text has no words and fails; null languages and sources are groups of their own;
    repeated rows come each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    counted = text_statistics(rows, F.col("text")).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumns(dict(zip(X, _vector())))
    counted = materialise(counted, "statistics")
    grouped = _levels(counted)
    judged = grouped.where("not base_failed")
    groups = materialise(judged.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n")).select(*LEVELS), "groups")
    moments = fitted(judged.select(*X, F.explode(F.array(*LEVELS)).alias("grp")))
    shapes = _factored(_drawn(moments, groups, prior_rows))
    far = _distances(judged, shapes).withColumn("distance2", F.col("d2"))
    rest = grouped.where("base_failed").withColumn("distance2", F.lit(None).cast("double"))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "grp"]
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance2") > cutoff, F.lit(False))
    return far.select(*out).unionByName(rest.select(*out)).withColumn("kept", kept)
