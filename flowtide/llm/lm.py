"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The join of count tables with exploded n-grams runs on packed columns.  Documents stand in blocks; a
block's distinct n-grams, sorted by hash, are cut at the borders of hash ranges, and each range
receives one row per block that has n-grams in it (never more rows than distinct n-grams): the hashes and the counts
within the block.  A range sums counts
over blocks and answers each block with the totals in the order it asked, so neither n-grams
nor single occurrences travel twice.  A very common n-gram is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowtide.llm.common import text_rows
from flowtide.plans.materialise import materialise

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 5_000_000
#: N-grams a hash range is sized for, counted once per block.
RANGE_GRAMS = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """One row per block: ``block, doc_ids, sizes, n_words, data`` (compressed texts, end to end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                text = text.as_py()
                if held and held + len(text) > block_chars:
                    yield _block_row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield _block_row(number, ids, texts)

    return docs.mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, n_words long, data binary")


def _block_row(number: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({
        "block": pa.array([number], pa.int64()),
        "doc_ids": pa.array([ids], pa.list_(pa.int64())),
        "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
        "n_words": pa.array([sum(len(t.split()) for t in texts)], pa.int64()),
        "data": pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(texts))], pa.binary()),
    })


class _Grams:
    """Hashes of every n-gram of a block, by order, and where documents start among the words."""

    def __init__(self, data: bytes, sizes: list[int], order: int) -> None:
        text = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, sum(sizes)))
        ends = np.cumsum(sizes).tolist()
        words = [text[a:b].lower().split() for a, b in zip([0, *ends], ends)]
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        code = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*words)}
        hashes = np.fromiter((code[w] for d in words for w in d), dtype=np.uint64, count=int(self.counts.sum()))
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.at = [np.arange(len(hashes))]
        self.hashes = [hashes]
        whole = hashes
        for n in range(1, order):
            longer = np.zeros_like(hashes)
            with np.errstate(over="ignore"):
                mixed = (whole[:-1] ^ (whole[:-1] >> np.uint64(31))) * _MULTIPLIER + hashes[1:] + np.uint64(n)
                longer[1:] = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER
            whole = longer
            at = np.flatnonzero(place >= n)
            self.at.append(at)
            self.hashes.append(whole[at])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all orders, the index of each occurrence among them, and counts."""
        return np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)


def _cuts(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Which ranges of equal width sorted hashes fall into, and where each one's hashes start, the end after the last."""
    spans = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    spans, starts = np.unique(spans, return_index=True)
    return spans.astype(np.int64), np.append(starts, len(hashes))


def _squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, equal bytes of all numbers together, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _released(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def scores(
    docs: DataFrame,
    order: int = 2,
    backoff: float = 0.4,
    least_count: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: ``doc_id, n_words, log_score`` (sum of natural logs) and ``mean_log_score``.

    Words are split at ASCII white space, A-Z lower-cased.  An n-gram counts as seen if the corpus has it
    ``least_count`` times (so a text's own single use does not vouch for it).  A word scores the count of the
    longest seen n-gram that ends with it over the count of that n-gram's context, times ``backoff``
    for each order skipped; a word alone scores its count over all words.  N-grams are compared by
    64-bit hashes.

    A null, empty or blank text has no words, score 0 and a null mean; repeated rows come each; an
    empty table gives no rows; other columns are ignored.
    """
    blocks = materialise(_blocks(text_rows(docs, id_col, text_col), block_chars), "blocks")
    # One number: all words of the corpus.
    words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    ranges = max(16, -(-words * order // RANGE_GRAMS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                hashes, _, counts = _Grams(row["data"], row["sizes"], order).distinct()
                spans, cuts = _cuts(hashes, ranges)
                counts = counts.astype("<u4")
                yield pa.record_batch({
                    "block": pa.array([row["block"]] * len(spans), pa.int64()),
                    "span": pa.array(spans),
                    "hashes": pa.array([_squeezed(hashes[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                })

    def answer(table: pa.Table) -> pa.Table:
        hashes = [_released(h.as_py()) for h in table.column("hashes")]
        counts = [np.frombuffer(c.as_buffer(), "<u4") for c in table.column("counts")]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts)) if len(place) else np.zeros(0)
        found = np.split(totals[place].astype("<u8"), np.cumsum([len(h) for h in hashes])[:-1])
        small = zstandard.ZstdCompressor(level=1)
        return pa.table({
            "block": table.column("block"),
            "span": table.column("span"),
            "totals": pa.array([small.compress(f.tobytes()) for f in found], pa.binary()),
        })

    answers = (
        blocks.select("block", "sizes", "data").mapInArrow(ask, "block long, span long, hashes binary, counts binary")
        .groupBy("span").applyInArrow(answer, "block long, span long, totals binary")
    )
    # A block's answers are as many bytes as its own n-grams; one row per hash range that it has some in.
    known = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("span", "totals"))).alias("answers"))
    steps = [log(backoff) * k for k in range(order)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _Grams(row["data"], row["sizes"], order)
                _, place, _ = grams.distinct()
                totals = np.concatenate(
                    [np.zeros(0, "<u8"), *[np.frombuffer(unpack.decompress(a["totals"]), "<u8") for a in row["answers"] or []]]
                )
                counts = np.split(totals[place].astype(np.float64), np.cumsum([len(h) for h in grams.hashes])[:-1])
                value = np.log(counts[0]) - log(max(words, 1)) + steps[order - 1]
                context = counts[0]
                for n in range(1, order):
                    at, seen = grams.at[n], counts[n] >= least_count
                    value[at[seen]] = np.log(counts[n][seen]) - np.log(context[at[seen] - 1]) + steps[order - 1 - n]
                    context = np.zeros(len(value))
                    context[at] = counts[n]
                sums = np.concatenate([[0.0], np.cumsum(value)])
                ends = np.cumsum(grams.counts)
                total = sums[ends] - sums[ends - grams.counts]
                n_words = grams.counts
                yield pa.record_batch({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "n_words": pa.array(n_words),
                    "log_score": pa.array(total),
                    "mean_log_score": pa.array(total / np.maximum(n_words, 1), mask=n_words == 0),
                })

    # A block of blank texts alone asks nothing.
    joined = blocks.join(known, "block", "left").select("doc_ids", "sizes", "data", "answers")
    return joined.mapInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")
