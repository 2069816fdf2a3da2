"""Concatenate and cut: documents as token ids in windows of one fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowtide.llm.common import small_batches, text_rows
from flowtide.llm.tokens import encoder, portions
from flowtide.plans.materialise import codec, materialise

ENCODED = "part int, local_start long, doc_id long, n_tokens long, ids binary"


def encoded(docs: DataFrame, path: str, cut: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids with ``end_id`` after them, and where they start within their partition.

    ``ids`` are little-endian unsigned 32-bit numbers.  Written once: partition numbers and
    running totals are those of the task attempt whose file was committed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, tokenizer = TaskContext.get().partitionId(), 0, encoder(path, cut)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for some in portions(texts):
                found = [np.append(x, np.uint32(end_id)) for x in tokenizer.encode(texts[some].to_pylist())]
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                yield pa.record_batch({
                    "part": pa.array(np.full(len(found), part, dtype=np.int32)),
                    "local_start": pa.array(total + np.cumsum(sizes) - sizes),
                    "doc_id": ids[some],
                    "n_tokens": pa.array(sizes),
                    "ids": pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()),
                })
                total += int(sizes.sum())
        pa.default_memory_pool().release_unused()  # workers are reused by later stages

    return text_rows(docs, id_col, text_col).mapInArrow(run, ENCODED)


def packed(
    docs: DataFrame,
    path: str,
    cut: str,
    end_id: int,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids, one row per piece.

    Pass one encodes each document once, where it lies, and totals the ids of each partition;
    prefix sums over those totals (a row per partition) give global offsets.  Pass two
    cuts each document at the multiples of ``length`` it crosses: a document inside one window
    is one piece, and every window it reaches into gets a boundary record of its own.  No text
    and no id is shuffled; windows are filled by documents in the order of the input splits.

    Columns: ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``ids_crc32`` (of the piece as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence), ``ids`` (those numbers, binary).  Every sequence
    but the last is full, so only the last needs padding.

    A null or empty text is its end id alone; repeated rows are packed each; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    # Half of the bytes of ids are zero or nearly so, which the default codec hardly uses.
    with small_batches(docs.sparkSession), codec(docs.sparkSession, "zstd"):
        rows = materialise(encoded(docs, path, cut, end_id, id_col, text_col), "ids")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, written: its size is known when the join is planned, so ids stay where they are.
    bases = materialise(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    first = F.col("at")
    last = F.col("at") + F.col("n_tokens") - 1
    window = lambda x: F.floor(x / length).cast("bigint")

    def piece(sequence):
        start = F.greatest(sequence * length - first, F.lit(0))
        end = F.least((sequence + 1) * length - first, F.col("n_tokens"))
        data = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.struct(
            start.alias("start"),
            (end - start).alias("length"),
            F.crc32(data).alias("ids_crc32"),
            F.col("n_tokens").alias("doc_tokens"),
            sequence.alias("sequence_id"),
            (first + start - sequence * length).alias("offset"),
            data.alias("ids"),
        )

    return (
        rows.join(bases, "part")
        .withColumn("at", F.col("base") + F.col("local_start"))
        .select("doc_id", F.inline(F.transform(F.sequence(window(first), window(last)), piece)))
    )
