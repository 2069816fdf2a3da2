"""URL filters: rules for hosts and paths, and a character model that judges what no rule fits.

Urls that a rule allows and urls that a rule blocks train one variable-order Markov model of characters each.
A character's probability after a context is interpolated over all orders (Witten-Bell: a context's share for
the next shorter one is its number of different successors), so an unseen context falls back by itself.  A url's
score is the difference of both models' log-likelihoods over its length.  The cut is calibrated on the
urls with a rule, each scored by models that have not seen its half of the hosts.

Counts are exact and cover all different urls.  Log ratios are whole micronats, so sums don't depend on
their order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.plans.lookup import hot_keys, join_by_key, join_lookup
from flowtide.plans.materialise import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
START, END = "\x02", "\x03"
ALL_HOSTS = 2
#: The base of all contexts: every code point and the end are as likely.
SYMBOLS = 1_114_113
MICRO = 1_000_000
#: Scores are calibrated in steps of a hundredth of a nat per character.
STEP = 10_000
HOT_URL = 100_000
#: Tails and contexts seen more often than this are split between tasks.
HOT_TAIL = 1_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains where the path starts as the rule's does."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


RULES = (
    Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Text of the longest rule that fits, null if none does."""
    fitting = [F.when(r.fits(host, path), F.lit(r.text)) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(F.lit(None).cast("string"), *fitting)


def _verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character and for the end: the character with the ``order`` characters before it."""
    pad = F.array(*[F.lit(START)] * order)
    padded = F.concat(pad, F.regexp_extract_all("url", F.lit("(?s)."), F.lit(0)), F.array(F.lit(END)))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.size("symbols") - order), lambda i: F.array_join(F.slice("symbols", i, order + 1), "")))
    return urls.withColumn("symbols", padded).select("url_no", "model", "label", gram.alias("gram"))


def _log_ratios(grams: DataFrame, order: int) -> DataFrame:
    """``model, gram, ratio`` for every gram of the urls: log of allowed over blocked, in micronats.

    The model of all hosts judges urls without a rule; model 0 and 1 leave out the hosts of that half.
    """
    seen = materialise(
        grams.where(F.col("label").isNotNull()).groupBy("model", "label", "gram").agg(F.count(F.lit(1)).alias("n")), "url_grams"
    )
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    models = F.explode(F.filter(F.array(*[F.lit(m) for m in range(ALL_HOSTS + 1)]), lambda m: m != F.col("model")))
    lengths = F.explode(F.array(*[F.lit(k) for k in range(1, order + 2)])).alias("k")
    tail = F.substring("gram", -F.col("k"), F.col("k"))
    counts = materialise(
        seen.select(models.alias("model"), "label", "n", "gram").select("model", "label", "n", "gram", lengths)
        .groupBy("model", "k", tail.alias("tail")).agg(of("allow").alias("allow"), of("block").alias("block")),
        "url_counts",
    )
    context = F.substring("tail", F.lit(1), F.col("k") - 1).alias("context")
    different = lambda c: F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_next")
    contexts = materialise(
        counts.groupBy("model", "k", context).agg(
            F.sum("allow").alias("allow_all"), F.sum("block").alias("block_all"), different("allow"), different("block")
        ),
        "url_contexts",
    )
    often = lambda table, x: hot_keys(table.withColumn("n", F.col(f"allow{x}") + F.col(f"block{x}")), table.columns[:3], HOT_TAIL)
    wanted = grams.select("model", "gram").distinct().select("model", "gram", lengths).withColumn("tail", tail)
    parts = (
        join_by_key(
            join_by_key(wanted, counts, counts.columns[:3], ["gram"], often(counts, ""), "left").select("*", context),
            contexts, contexts.columns[:3], ["gram"], often(contexts, "_all"), "left",
        )
        .fillna(0, ["allow", "block", "allow_all", "block_all", "allow_next", "block_next"])
        .groupBy("model", "gram")
        .agg(F.array_sort(F.collect_list(F.struct("k", *[f"{c}{x}" for c in ("allow", "block") for x in ("", "_all", "_next")]))).alias("orders"))
    )

    def longer(p: Column, x: Column, c: str) -> Column:
        total = x[f"{c}_all"] + x[f"{c}_next"]
        return F.when(total > 0, (x[c] + x[f"{c}_next"] * p) / total).otherwise(p)

    base = F.lit(1.0 / SYMBOLS)
    both = F.aggregate(
        "orders",
        F.struct(base.alias("allow"), base.alias("block")),
        lambda p, x: F.struct(longer(p["allow"], x, "allow").alias("allow"), longer(p["block"], x, "block").alias("block")),
    )
    return materialise(
        parts.select("model", "gram", both.alias("p")).select(
            "model", "gram", F.round((F.ln("p.allow") - F.ln("p.block")) * MICRO).cast("bigint").alias("ratio")
        ),
        "url_ratios",
    )


def _cut(scored: DataFrame) -> int | None:
    """The step from which urls are allowed: the best sum of both classes' shares told right, nearest to zero if tied.

    Any step above the one before tells the same urls right, so a cut may lie between two steps.  Without urls of both classes there is none.  The histogram has a row per step, so a few thousand at most.
    """
    steps = scored.where(F.col("label").isNotNull()).groupBy("step").agg(
        F.count(F.when(F.col("label") == "allow", 1)).alias("allow"), F.count(F.when(F.col("label") == "block", 1)).alias("block")
    )
    every = Window.partitionBy(F.lit(0))
    so_far = every.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    best = (
        steps.withColumns({"allowed": F.sum("allow").over(every), "blocked": F.sum("block").over(every)})
        .withColumn("lower", F.lag("step").over(every.orderBy("step")))
        .withColumns({"lost": F.coalesce(F.sum("allow").over(so_far), F.lit(0)), "caught": F.coalesce(F.sum("block").over(so_far), F.lit(0))})
        .where((F.col("allowed") > 0) & (F.col("blocked") > 0))
        .withColumn("gain", wide("caught") * wide("allowed") - wide("lost") * wide("blocked"))
        .select(F.least("step", F.greatest(F.coalesce(F.col("lower") + 1, "step"), F.lit(0))).alias("step"), "gain")
        .orderBy(F.desc("gain"), F.abs("step"), "step")
        .first()
    )
    return None if best is None else best.step


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, order: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; ``score`` (micronats per character) where no rule fits.

    A null url is judged as an empty one (host and path empty, no rule); a very long url is a row per character, none of
    them longer than ``order`` + 1; equal urls share one judgement, repeated rows come each; an empty table gives no rows;
    columns other than the two named are ignored.  Where no url is allowed or none is blocked by a rule, nothing can be
    learned and the rest is allowed.  ``rules`` are constants of the plan: hundreds, not millions.
    """
    raw = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"))
    parsed = raw.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parsed.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    half = F.when(F.substring(F.md5("host"), 1, 1) < "8", 0).otherwise(1)
    urls = materialise(
        ruled.groupBy("url", "host", "rule").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"label": _verdict_of(F.col("rule"), rules), "url_no": F.monotonically_increasing_id()})
        .withColumn("model", F.when(F.col("rule").isNull(), ALL_HOSTS).otherwise(half))
        .select("url_no", "url", "label", "model", "n"),
        "urls",
    )
    grams = _grams(urls, order)
    ratios = _log_ratios(grams, order)
    mean = F.sum("ratio") / F.count(F.lit(1))
    scored = materialise(
        join_lookup(grams, ratios, ["model", "gram"], ["url_no"])
        .groupBy("url_no", "label")
        .agg(mean.alias("score"))
        .withColumn("step", F.floor(F.col("score") / STEP)),
        "url_scores",
    )
    cut = _cut(scored)
    allowed = F.lit(True) if cut is None else F.col("step") >= cut
    judged = materialise(
        urls.where(F.col("label").isNull()).join(scored.drop("label"), "url_no")
        .select("url", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score"),
        "url_verdicts",
    )
    out = ["page_id", "host", "path", "rule", "verdict", "score"]
    by_rule = ruled.where(F.col("rule").isNotNull()).withColumns({"verdict": _verdict_of(F.col("rule"), rules), "score": F.lit(None).cast("double")})
    hot = hot_keys(urls, ["url"], HOT_URL)
    by_model = join_by_key(ruled.where(F.col("rule").isNull()), judged, ["url"], ["page_id"], hot)
    return by_rule.select(*out).unionByName(by_model.select(*out))
