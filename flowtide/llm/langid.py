"""Language identification by compression: the dictionary that shortens a text most names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.llm.common import importable, unused
from flowtide.plans.lookup import join_lookup
from flowtide.plans.materialise import materialise

#: Bounds of what is learned: texts sampled per language, characters of each, bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 96, 4_000, 96 * 1024
#: Characters compressed at a time.  Each piece meets the dictionary afresh, so the end of a long text counts
#: as its start does.
PIECE_CHARS = 3_000
LEVEL = 6
#: A text whose second-best language needs less than this share more bytes is rejected.
LEAST_MARGIN = 0.003
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_OTHER_ASCII = re.compile(r"[^a-z]+")
_LETTER = regex.compile(r"\p{L}")


def plain(text: str | None) -> str:
    """Lower-cased letters and their marks with single spaces between runs of them; empty without a letter."""
    text = text or ""
    if not _LETTER.search(text):
        return ""
    lower = text.lower()
    return (_OTHER_ASCII if lower.isascii() else _OTHER).sub(" ", lower).strip()


@dataclass
class LanguageModel:
    """Raw-content dictionaries by language."""

    dictionaries: dict[str, bytes]
    level: int = LEVEL

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        found = []
        for lang, content in sorted(self.dictionaries.items()):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=self.level)
            made = zstandard.ZstdCompressor(
                dict_data=data, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            found.append((lang, made))
        return found


def classify(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """Language and margin: the share of bytes the second-best language needs more; ties go to the first name."""
    letters = plain(text)
    if not letters or not compressors:
        return UNKNOWN, 0.0
    pieces = [letters[i : i + PIECE_CHARS].encode("utf-8", "replace") for i in range(0, len(letters), PIECE_CHARS)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from a bounded sample of labelled texts outside the held-out fold.

    Of each language the ``SAMPLE_TEXTS`` different texts with letters and the smallest hashes are taken; copies take one
    place.  Copies meet and ranks are cut before the shuffle, so a language or a text may own any share of the
    rows.  The driver receives those texts only: at most ``SAMPLE_TEXTS * SAMPLE_CHARS`` characters per language.
    """
    rows = docs.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).where(F.col(f"`{lang_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`")))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text", F.lit(7)))
    ranked = (
        rows.select("lang", "hash")
        .distinct()
        # First within parts of a language, so that few rows of it meet in one task.
        .withColumn("part", F.pmod("hash", F.lit(32)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy("hash")))
        .where(F.col("rank") <= SAMPLE_TEXTS)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
        .where(F.col("rank") <= SAMPLE_TEXTS)
        .select("lang", "hash")
    )
    # Broadcast if its size allows.
    wanted = materialise(ranked, "language_sample")
    chosen = join_lookup(rows, wanted, ["lang", "hash"], ["text"]).select("lang", "hash", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    chosen = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "hash").collect():
        if letters := plain(row["text"]):
            texts.setdefault(row["lang"], []).append(letters)
    return LanguageModel({k: "\n".join(v).encode("utf-8", "replace")[:DICTIONARY_BYTES] for k, v in texts.items()})


def predicted(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", least_margin: float = LEAST_MARGIN, prefix: str = ""
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``, names led by ``prefix``.

    The score is the margin between the two best languages.  A text that is null or has no letter is ``und``
    with score 0 and rejected, as is one with a margin under ``least_margin``.
    """
    out = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = [classify(t, compressors) for t in batch.column(text_col).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[out[0]] = pa.array([lang for lang, _ in found], pa.string())
            columns[out[1]] = pa.array([score for _, score in found], pa.float64())
            columns[out[2]] = pa.array([lang == UNKNOWN or score < least_margin for lang, score in found], pa.bool_())
            yield pa.record_batch(columns)

    importable(docs.sparkSession)
    schema = docs.select("*", F.lit("").alias(out[0]), F.lit(0.0).alias(out[1]), F.lit(True).alias(out[2])).schema
    return docs.mapInArrow(run, schema)


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_margin: float = LEAST_MARGIN
) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score, rejected``.

    Learns from the labelled documents outside the held-out fold and predicts from texts alone.  A null id
    is not held out; without any label every text is ``und``; repeated rows come each; an empty table
    gives no rows; other columns are ignored.
    """
    model = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        held_out(F.col(f"`{id_col}`")).alias("held_out"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    return predicted(rows, model, "text", least_margin).drop("text")


def known_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_margin: float = LEAST_MARGIN
) -> DataFrame:
    """The documents whose language is told with a sufficient margin, all columns kept as they are.

    Null texts and texts without letters go; texts are compressed whole, whatever their length; repeated rows are judged
    each; an empty table gives no rows; columns may have any name.
    """
    model = learn(docs, id_col, text_col, lang_col)
    (prefix,) = unused(docs, "_lang_id_")
    judged = predicted(docs, model, text_col, least_margin, prefix=prefix)
    return judged.where(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
