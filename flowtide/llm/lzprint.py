"""Lempel-Ziv phrase fingerprints: likeness of texts as a compressor would see it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowtide.llm.common import text_rows
from flowtide.plans.materialise import materialise

#: Slots of a signature; each gives 16 bits, so 4 hex digits.
SLOTS = 128
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_NEXT, _SYMBOL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1


def phrases(text: str, kept: Sequence[str] = ()) -> list[str]:
    """The dictionary of an incremental (1978) Lempel-Ziv parse: each phrase is an earlier one and a character more.

    Phrases come in the order of the text.  ``kept`` are phrases of an earlier parse of the same start; the parse goes on after them.
    """
    known = dict.fromkeys(kept)
    start, size = sum(map(len, kept)), len(text)
    end = start + 1
    while end <= size:
        phrase = text[start:end]
        if phrase in known:
            end += 1
        else:
            known[phrase] = None
            start, end = end, end + 1
    if start < size:
        known[text[start:]] = None
    return list(known)


class Parse(NamedTuple):
    """Phrases in the order of the text, and a hash of each."""

    phrases: list[str]
    hashes: np.ndarray


def parsed(text: str, before: Parse | None = None, shared: int = 0) -> Parse:
    """The parse of ``text``; ``before`` is that of a text with the same first ``shared`` characters.

    Whether a phrase ends depends on the characters up to its end alone, so what ends within the shared
    start is taken over with its hashes.
    """
    if before is None:
        found = phrases(text)
        return Parse(found, _hashes(found))
    count = int(np.searchsorted(np.fromiter(accumulate(map(len, before.phrases)), np.int64, len(before.phrases)), shared, "right"))
    found = phrases(text, before.phrases[:count])
    return Parse(found, np.concatenate([before.hashes[:count], _hashes(found[count:])]))


def _hashes(found: list[str]) -> np.ndarray:
    if not found:
        return np.zeros(0, dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    with np.errstate(over="ignore"):
        terms = _mixed((codes + np.uint64(1)) * _PRIME + _mixed(place.astype(np.uint64) + np.uint64(1)))
        return _mixed(np.add.reduceat(terms, ends - sizes))


def signature(text: str, slots: int = SLOTS) -> np.ndarray:
    """Minimum-hash signature of the phrase set, 16 bits a slot; all ones for an empty text."""
    return _signature(parsed(text).hashes, slots)


def _signature(hashes: np.ndarray, slots: int) -> np.ndarray:
    """One hash per phrase: its low part names the slot, the rest competes for the minimum there.

    An empty slot borrows from the next filled one, mixed with the distance, as short texts have
    few phrases.
    """
    if not len(hashes):
        return np.full(slots, 0xFFFF, dtype=np.uint16)
    slot = (hashes % np.uint64(slots)).astype(np.int64)
    least = np.full(slots, _ALL, dtype=np.uint64)
    np.minimum.at(least, slot, hashes)
    filled = np.flatnonzero(np.bincount(slot, minlength=slots))
    lender = filled[np.searchsorted(filled, np.arange(slots)) % len(filled)]
    gap = ((lender - np.arange(slots)) % slots).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (_mixed(least[lender] + gap * _PRIME) >> np.uint64(48)).astype(np.uint16)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots: estimates the Jaccard similarity of the phrase sets."""
    return float(np.mean(a == b))


def _bytes(sig: np.ndarray) -> bytes:
    return sig.astype(">u2").tobytes()


def written(sig: np.ndarray) -> str:
    return _bytes(sig).hex()


def read(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), dtype=">u2").astype(np.uint16)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per document ``doc_id, n_chars, fingerprint``.  A null text counts as empty; repeated rows come each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "fingerprint": pa.array([written(signature(t, slots)) for t in texts], pa.string()),
            })

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


# Digests and fingerprints travel as bytes and become hex digits at the end: half the size on disk.
OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _compared(doc_id: int | None, text: str, parse: Parse, own: np.ndarray, next_text: str, next_sig: np.ndarray, slots: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    changed = own if edited == text else _signature(parsed(edited, parse, len(text) - half).hashes, slots)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    return (doc_id, len(text), digest, _bytes(own), _bytes(changed), likeness(own, changed), likeness(own, next_sig))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Fingerprints of texts and of their edits, in which the next document's start replaces the last half.

    Documents are ordered by id (null first), rows of one id by text; after the last comes the
    first.  One range shuffle puts neighbours into one task.  Only a range's first and last
    document have a neighbour elsewhere: the task hands on their texts, two rows per range, and
    a second small job compares across the borders.

    A null text counts as empty: its fingerprint is all ones, and so is that of an edit that is empty;
    repeated rows come each; one document alone is its own next; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            borders: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                parse = parsed(text)
                sig = _signature(parse.hashes, slots)
                if held is None:
                    borders.append((part, "first", doc_id, text))
                else:
                    out.append(_compared(*held, text, sig, slots))
                held = (doc_id, text, parse, sig)
            yield from _with_borders(out, borders)
        if held:
            yield from _with_borders([], [(part, "last", held[0], held[1])])

    ordered = text_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = materialise(ordered.mapInArrow(run, f"{OUT}, part int, side string, border_id long, border_text string"), "lz")
    # Two rows per range: each range's last document meets the next range's first.
    ends = rows.where("side is not null").select("part", "side", "border_id", "border_text")
    firsts = ends.where("side = 'first'").select("part")
    after = Window.orderBy("part")
    following = materialise(
        firsts.select("part", F.coalesce(F.lead("part").over(after), F.min("part").over(Window.partitionBy())).alias("next_part")), "ranges"
    )
    met = (
        ends.where("side = 'last'")
        .join(following, "part")
        .join(
            ends.where("side = 'first'").select(F.col("part").alias("next_part"), F.col("border_text").alias("next_text")), "next_part"
        )
        .select("border_id", "border_text", "next_text")
    )

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                parse = parsed(r["border_text"])
                own, after = _signature(parse.hashes, slots), signature(r["next_text"], slots)
                found.append(_compared(r["border_id"], r["border_text"], parse, own, r["next_text"], after, slots))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)] if found else [pa.array([], t) for t in _TYPES], names=_NAMES)

    found = rows.where("side is null").select(*_NAMES).unionByName(met.mapInArrow(borders, OUT))
    return found.select(*[F.lower(F.hex(c)).alias(c) if c in _HEX else F.col(c) for c in _NAMES])


def _with_borders(out: list[tuple], borders: list[tuple]) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*[(*r, None, None, None, None) for r in out], *[(*([None] * len(_NAMES)), *b) for b in borders]))
    if columns:
        types = [*_TYPES, pa.int32(), pa.string(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[*_NAMES, "part", "side", "border_id", "border_text"])
