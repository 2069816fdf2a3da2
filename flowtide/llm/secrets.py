"""Secrets in texts, by DataFrame functions only: fixed patterns, and strings of high local entropy."""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import unused

# The patterns of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGNED_AT_LEAST = 6

#: Candidate strings of the entropy rule.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Character classes, first match decides: name, pattern of the whole candidate, window length, bits per
#: character that the best window must reach: what 99 in 100 random strings of one window reach in the alphabet
#: named (40,000 draws).  Words reach as much; ``ALLOW`` clears them.
CLASSES = (
    ("digits", r"[0-9+/_=-]+", 20, 2.5),  # 10
    ("hex", r"[0-9A-Fa-f]+=*", 20, 2.9),  # 16
    ("lower letters", r"[a-z+/_=-]+", 20, 3.2),  # 26
    ("upper letters", r"[A-Z+/_=-]+", 20, 3.2),  # 26
    ("letters", r"[A-Za-z+/_=-]+", 20, 3.58),  # 52
    ("lower", r"[a-z0-9+/_=-]+", 20, 3.34),  # 32 of 36
    ("upper", r"[A-Z0-9+/_=-]+", 20, 3.34),  # 32 of 36
    ("mixed", r"[A-Za-z0-9+/_=-]+", 20, 3.64),  # 62
)
_PIECE = r"(?:[A-Za-z]{1,24}[0-9]{0,4}|[0-9]{1,8})"
_CONSONANTS = r"(?:sch|ch|ck|ph|pf|th|ts|tz|ng|st|ss|ll|tt|nn|rr|ff|[b-df-hj-np-tv-xz]){0,3}+"
#: Candidates that look like keys and are none: placeholders, identifiers with dashes, paths and dates, words that can be
#: spoken (at most three consonant sounds between vowels), names in camel case.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]?(key|token|secret)|xxxx|0{8}|1234567|abcdef",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    rf"^{_PIECE}(?:[/_-]{{1,3}}{_PIECE})+[/_-]?=*$",
    rf"^(?=[A-Za-z][a-z]*=*$|[A-Z]+=*$)(?i:(?:{_CONSONANTS}[aeiouy]++h?+)++{_CONSONANTS})=*$",
    r"^[a-z]{0,14}(?:[A-Z]{1,4}[a-z]{2,14}|By|To|Of|In|Is|On|At|As|Or|Id|It)+[A-Z]{0,4}[0-9]{0,4}=*$",
)

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
SCALE = 1_000_000


#: Matches placed by one running sum; longer lists are cut into stretches of this many.
STRETCH = 256


def _placed(text: Column, pattern: str, matches: Column) -> Column:
    """Start and text of each match: lengths of the gaps between matches, summed up with the matches'.

    Arrays grow by copies, so sums run inside stretches, and once over the stretches.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.transform(F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g")), lambda p: F.struct(p["g"].cast("bigint").alias("g"), p["m"].alias("m")))
    empty = F.array().cast("array<struct<start:bigint,m:string>>")

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["g"]
        return F.struct(
            (start + F.length(p["m"])).cast("bigint").alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.cast("bigint").alias("start"), p["m"].alias("m")))).alias("out"),
        )

    summed = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / STRETCH).cast("int")),
        lambda k: F.aggregate(
            F.slice(steps, k * STRETCH + 1, F.lit(STRETCH)), F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), place
        ),
    )
    whole = "array<struct<at:bigint,out:array<struct<start:bigint,m:string>>>>"
    moved = F.aggregate(
        summed,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(whole).alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["at"]).cast("bigint").alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), s["out"].alias("out")))).alias("out"),
        ),
        lambda acc: F.flatten(F.transform(acc["out"], lambda s: F.transform(s["out"], lambda p: F.struct((s["at"] + p["start"]).alias("start"), p["m"].alias("m"))))),
    )
    return F.when(F.size(matches) > 0, moved).otherwise(empty)


def _spans(placed: Column, kind: int) -> Column:
    return F.transform(
        placed,
        lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), (p["start"] + F.length(p["m"])).cast("bigint").alias("end")),
    ).cast(_SPAN)


def peak_entropy(candidate: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits per character, of any ``window`` neighbouring characters.

    The sum of c * log2(c) over the counts c of a window is carried along: a character that enters
    or leaves changes one term.  Sums are whole millionths, so the order of steps leaves no trace.
    A string shorter than ``window`` has 0.
    """
    term = lambda c: c * log2(c) if c else 0.0
    change = F.array(*[F.lit(round(SCALE * term(k)) - round(SCALE * term(k - 1))) for k in range(1, window + 1)])

    def step(acc: Column, x: Column) -> Column:
        full = F.length(acc["win"]) == window
        rest = F.when(full, F.substring(acc["win"], 2, window)).otherwise(acc["win"])
        first = F.substring(acc["win"], 1, 1)
        leaving = F.when(full, F.element_at(change, F.length(acc["win"]) - F.length(F.replace(acc["win"], first, F.lit(""))))).otherwise(0)
        entering = F.element_at(change, F.length(rest) - F.length(F.replace(rest, x, F.lit(""))) + 1)
        total = acc["sum"] - leaving + entering
        fills = F.length(rest) == window - 1
        return F.struct(
            F.concat(rest, x).alias("win"),
            total.cast("bigint").alias("sum"),
            F.when(fills, F.least(acc["best"], total)).otherwise(acc["best"]).cast("bigint").alias("best"),
        )

    most = round(SCALE * term(window))
    start = F.struct(F.lit("").alias("win"), F.lit(0).cast("bigint").alias("sum"), F.lit(most).cast("bigint").alias("best"))
    return F.aggregate(
        F.split(candidate, ""), start, step, lambda acc: F.lit(log2(window)) - acc["best"] / F.lit(float(SCALE * window))
    )


def _suspicious(candidate: Column, classes, allow: Sequence[str]) -> Column:
    out = None
    for _, pattern, window, bits in classes:
        verdict = F.lit(False) if bits is None else peak_entropy(candidate, window) >= bits
        out = F.when(candidate.rlike(f"^(?:{pattern})$"), verdict) if out is None else out.when(candidate.rlike(f"^(?:{pattern})$"), verdict)
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(out.otherwise(False))


def scan(
    docs: DataFrame, text_col: str = "text", classes=CLASSES, allow: Sequence[str] = ALLOW, prefix: str = "_secret"
) -> DataFrame:
    """``docs`` with two columns more: ``<prefix>_base`` and ``<prefix>_spans``.

    Both are arrays of ``start, kind, end`` in code points, end exclusive, kind an index of ``KINDS``, sorted by
    start and kind.  Base spans come from the fixed patterns, leftmost and non-overlapping per
    kind.  The method adds candidate strings whose best window reaches the entropy of their
    character class, that no allow-list pattern suppresses and no base span touches.

    No row is shuffled: all is worked out within a row.  A null text has no spans.
    """
    m = lambda name: f"{prefix}_{name}"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.withColumns({
        m(k): F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE))
    })
    assigned = lambda p: F.length(F.regexp_extract(p["m"], ASSIGN, 2)) >= ASSIGNED_AT_LEAST
    base = F.concat(
        _spans(F.filter(_placed(text, ASSIGN, F.col(m("assign"))), assigned), 0),
        _spans(_placed(text, ACCESS, F.col(m("access"))), 1),
        _spans(_placed(text, HEX, F.col(m("hex"))), 2),
    )
    out = out.withColumns({
        m("base"): F.sort_array(base),
        # Most texts have no candidate worth placing.
        m("wanted"): F.exists(m("candidate"), lambda c: _suspicious(c, classes, allow)),
    })
    added = F.filter(
        _placed(text, CANDIDATE, F.col(m("candidate"))),
        lambda p: _suspicious(p["m"], classes, allow)
        & ~F.exists(m("base"), lambda b: (b["start"] < p["start"] + F.length(p["m"])) & (p["start"] < b["end"])),
    )
    spans = F.when(F.col(m("wanted")), F.sort_array(F.concat(F.col(m("base")), _spans(added, 3)))).otherwise(F.col(m("base")))
    return out.withColumn(m("spans"), spans).drop(*[m(k) for k in ("assign", "access", "hex", "candidate", "wanted")])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, mark: str = "[SECRET]", **rules) -> DataFrame:
    """The documents with each stretch of overlapping spans replaced by ``mark``; columns stay as they are.

    Texts without spans are untouched, null stays null, and ``chars_col``, if given, follows the new text.  Repeated rows
    come each; an empty table gives no rows; columns may have any name.
    """
    (prefix,) = unused(docs, "_secret")
    text, spans = F.col(f"`{text_col}`"), F.col(f"{prefix}_spans")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]) & ((acc["at"] == 0) | (s["start"] > acc["at"])), F.concat(acc["out"], gap, F.lit(mark)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    found = scan(docs, text_col, prefix=prefix, **rules)
    new = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
    columns = {text_col: new}
    if chars_col:
        columns[chars_col] = F.when(F.size(spans) > 0, F.length(new)).otherwise(F.col(f"`{chars_col}`"))
    types = dict(docs.dtypes)
    return found.select(*[(columns[c].cast(types[c]) if c in columns else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans``.

    A null or empty text has no spans (and the digest of the empty string); repeated rows come each;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = scan(rows, "text", **rules)
    base, spans = F.col("_secret_base"), F.col("_secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
