"""Phrases that stand together more often than their parts suggest, per language.

1. Texts become blocks of word numbers, written once; each block has the 64-bit hashes of its own words.  Words are
   counted on the way.  Hashes are those of language and word, and are checked to be unique.
2. A sieve of fixed size, hash buckets of word pairs, tells which pairs of frequent words may be frequent; a second one
   tells the same of triples of which both pairs pass.  Bucket counts are sent packed, by ranges of buckets.
3. Pairs and triples that the sieves let through are sent packed, with how often a task met them, by ranges of hashes.  Candidates
   are Apriori-safe: those of them whose sum reaches the least count.  No frequent phrase is left out.
4. Candidates of a range go, in portions of a fixed size, into double-array tries.  All that was sent to the range walks its trie at
   once, level by level; the states reached are counted.  So each phrase meets one trie, however many candidates there are, and
   the blocks are read a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.llm.common import small_batches, text_rows
from flowtide.llm.tokens import _Numbers, portions
from flowtide.llm.trie import DoubleArray
from flowtide.plans.lookup import hot_keys, join_lookup
from flowtide.plans.materialise import materialise, materialise_with

NO_LANGUAGE = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
#: Breaks become full stops, tabs spaces, capitals small; what is left between spaces are words and breaks.
_PLAIN = bytes.maketrans(BREAKS + b"\t" + _CAPITALS, b"." * len(BREAKS) + b" " + _CAPITALS.lower())
LONGEST = 3
BLOCK_WORDS = 1 << 19
#: Counts of words a task holds before it adds and sends them, and to a batch; blocks, or rows of phrases, to an Arrow batch.
WORDS_HELD, WORDS_SENT, BLOCK_ROWS = 300_000, 50_000, 16
#: Buckets of words and of pairs and triples, as bits; a sieve has a bucket for every two words of the corpus, within these bounds.
WORD_BITS, PAIR_BITS, MOST_PAIR_BITS = 24, 27, 28
PORTION = 1 << 18
#: Buckets to a range, as bits; buckets a task holds before it sends their counts.
RANGE_BITS, BUCKETS_HELD = 19, 1 << 20
#: Ranges of candidates, as bits, at least; candidates a task holds before it sends them; words of the corpus to a range, as bits.
CANDIDATE_BITS, CANDIDATES_HELD, RANGE_WORD_BITS = 6, 1 << 19, 22
#: A part of more phrases than this is split between tasks where phrases meet its count.
HOT_PART = 500
MICRO = 1_000_000
_BITMAP = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "symbols binary, codes binary, n_codes int, starts int, lang string, word string, n bigint"


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).replace(b".", b" . ").split()


class _Block:
    """Numbers of words in order; 0 is a break, and every text ends with one."""

    def __init__(self, salt: str) -> None:
        self.salt = salt
        self.number: dict[str, _Numbers] = {}
        self.offset: dict[str, int] = {}
        self.parts: list[tuple[str, np.ndarray]] = []
        self.n = 0

    def add(self, lang: str, text: bytes) -> None:
        tokens = _tokens(text)
        known = self.number.get(lang)
        if known is None:
            known = self.number[lang] = _Numbers({b".": 0})
        self.parts.append((lang, np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))))
        self.n += len(tokens) + 1

    def closed(self) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Hashes of the distinct words, the numbers of all words (place there plus one), and counts of words."""
        first, symbols, langs, words = {}, [], [], []
        for lang, known in self.number.items():
            first[lang] = len(words)
            del known[b"."]
            seed = f"{self.salt}{lang}\0".encode()
            symbols += [xxhash.xxh64_intdigest(seed + w, 42) for w in known]
            langs += [lang] * len(known)
            words += known
        codes = np.zeros(self.n, np.int64)
        at = 0
        for lang, part in self.parts:
            codes[at : at + len(part)] = np.where(part > 0, part + first[lang], 0)
            at += len(part) + 1
        counts = np.bincount(codes, minlength=len(words) + 1)[1:]
        table = pa.table({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string()), "n": counts})
        return np.array(symbols, np.uint64).view(np.int64), codes, table


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"symbols": pa.binary(), "codes": pa.binary(), "n_codes": pa.int32(), "starts": pa.int32(), "lang": pa.string(), "word": pa.string(), "n": pa.int64()}
    return pa.record_batch({k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()})


def _encode(salt: str, block_words: int, words_held: int):
    """Documents -> rows of blocks, and rows of word counts, told apart by ``word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        held: list[pa.Table] = []

        def words() -> Iterator[pa.RecordBatch]:
            counts = pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            held.clear()
            for part in counts.to_batches(max_chunksize=WORDS_SENT):
                yield _rows(lang=part["lang"], word=part["word"], n=part["n_sum"])

        def blocks(block: _Block) -> Iterator[pa.RecordBatch]:
            symbols, codes, counts = block.closed()
            held.append(counts)
            for first in range(0, len(codes), block_words):
                # The words after a block's last start belong to the next block; phrases look ahead into them.
                part = codes[first : first + block_words + LONGEST - 1]
                starts = min(block_words, len(codes) - first)
                met = np.bincount(part, minlength=len(symbols) + 1) > 0
                met[0] = False
                here, numbers = np.flatnonzero(met), np.cumsum(met, dtype=np.uint32)[part]
                yield _rows(symbols=[symbols[here - 1].tobytes()], codes=[squeeze(numbers.tobytes())], n_codes=[len(part)], starts=[starts])
            if sum(map(len, held)) > words_held:
                yield from words()

        block = _Block(salt)
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for some in portions(texts):
                for lang, text in zip(langs[some].to_pylist(), texts[some].cast(pa.binary()).to_pylist()):
                    block.add(lang, text)
                    if block.n >= block_words:
                        yield from blocks(block)
                        block = _Block(salt)
        yield from blocks(block)
        if held:
            yield from words()
        _released()

    return run


def _released() -> None:
    """Workers are reused by later stages: what Arrow holds for nothing goes back."""
    pa.default_memory_pool().release_unused()


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes, numbers and starts of each block."""
    release = zstandard.ZstdDecompressor().decompress
    for row in batch.to_pylist():
        yield np.frombuffer(row["symbols"], np.int64), np.frombuffer(release(row["codes"], max_output_size=4 * row["n_codes"] + 1), np.uint32).astype(np.int64), row["starts"]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (a.view(np.uint64) ^ (a.view(np.uint64) >> np.uint64(29))) * _MIX + b.view(np.uint64)
        return (mixed ^ (mixed >> np.uint64(32))) * _MIX


def _bucket(mixed: np.ndarray, bits: int) -> np.ndarray:
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, lowest bytes first, so that small ones leave long runs of zeros."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=4 * size + 1), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _fixed_bitmap(buckets: DataFrame, bits: int) -> np.ndarray:
    """The numbers in column ``bucket`` as 2 ** bits bits: the size doesn't depend on how many there are."""
    one = F.col("bucket").cast("bigint") + 1
    rows = buckets.groupBy(F.bitmap_bucket_number(one).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits")).collect()
    out = np.zeros(max(1 << bits, _BITMAP) >> 3, dtype=np.uint8)
    for r in rows:
        out[(r.part - 1) * (_BITMAP >> 3) : r.part * (_BITMAP >> 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def _frequent_places(symbols, codes, frequent, word_bits):
    """Places whose word and next word may both be frequent."""
    known = np.append(False, _has(frequent, symbols & ((1 << word_bits) - 1)))[codes]
    return np.flatnonzero(known[:-1] & known[1:])


def _pairs_at(symbols, codes, place):
    """Which of the distinct pairs each place has, and the words of those."""
    keys, which = np.unique(codes[place] * (len(symbols) + 1) + codes[place + 1], return_inverse=True)
    return which, symbols[keys // (len(symbols) + 1) - 1], symbols[keys % (len(symbols) + 1) - 1]


def _passing(symbols, codes, frequent, pairs, word_bits, pair_bits):
    """Places of pairs of words that may be frequent and that pass the sieve of pairs, with ``_pairs_at``."""
    place = _frequent_places(symbols, codes, frequent, word_bits)
    place = place[_has(pairs, _bucket(_mixed(symbols[codes[place] - 1], symbols[codes[place + 1] - 1]), pair_bits))]
    return place, *_pairs_at(symbols, codes, place)


def _triples(place, which, starts, distinct):
    """Numbers of the first and the second pair of each distinct triple of which both pairs pass, and its count."""
    first = np.flatnonzero((np.diff(place) == 1) & (place[:-1] < starts)) if len(place) else place
    keys, n = np.unique(which[first] * distinct + which[first + 1], return_counts=True)
    return keys // max(1, distinct), keys % max(1, distinct), n


def _pair_buckets(frequent, word_bits: int, pair_bits: int):
    def of(symbols, codes, starts):
        place = _frequent_places(symbols, codes, frequent.value, word_bits)
        which, a, b = _pairs_at(symbols, codes, place)
        n = np.bincount(which[place < starts], minlength=len(a))
        return _bucket(_mixed(a, b), pair_bits)[n > 0], n[n > 0]

    return of


def _triple_buckets(frequent, pairs, word_bits: int, pair_bits: int):
    def of(symbols, codes, starts):
        place, which, a, b = _passing(symbols, codes, frequent.value, pairs.value, word_bits, pair_bits)
        x, y, n = _triples(place, which, starts, len(a))
        return _bucket(_mixed(_mixed(a, b)[x], b[y]), pair_bits), n

    return of


def _met_buckets(buckets, least: int, bits: int):
    """Blocks -> how often each bucket is met, packed by ranges of buckets; counts above ``least`` need not be told apart."""
    width = min(bits, RANGE_BITS)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, at = np.unique(np.concatenate([b for b, _ in held]), return_inverse=True)
        n = np.minimum(np.bincount(at, np.concatenate([n for _, n in held]), len(bucket)), least)
        cuts = [0, *(np.flatnonzero(np.diff(bucket >> width)) + 1), len(bucket)]
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        return pa.record_batch({
            "range": pa.array([int(bucket[p.start]) >> width for p in parts], pa.int32()),
            "size": pa.array([p.stop - p.start for p in parts], pa.int32()),
            "gaps": pa.array([_packed(np.diff(bucket[p] & ((1 << width) - 1), prepend=0)) for p in parts], pa.binary()),
            "counts": pa.array([_packed(n[p]) for p in parts], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in _opened(batch):
                held.append(buckets(*block))
                size += len(held[-1][0])
                if size >= BUCKETS_HELD:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)
        _released()

    return run


def _reached(least: int, bits: int):
    """Packed counts of one range of buckets -> a bit for each that is met ``least`` times."""
    width = min(bits, RANGE_BITS)

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, dtype=np.int64)
        for row in table.to_pylist():
            total[np.cumsum(_unpacked(row["gaps"], row["size"]), dtype=np.int64)] += _unpacked(row["counts"], row["size"])
        return pa.table({"range": table["range"][:1], "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    return run


def _sieve(blocks: DataFrame, buckets, least: int, bits: int) -> np.ndarray:
    """A bitmap of the buckets met ``least`` times in all blocks: the size doesn't depend on how many there are."""
    packed = blocks.mapInArrow(_met_buckets(buckets, least, bits), "range int, size int, gaps binary, counts binary")
    out = np.zeros(max(1 << bits, 8) >> 3, dtype=np.uint8)
    for r in packed.groupBy("range").applyInArrow(_reached(least, bits), "range int, bits binary").collect():
        out[r.range * len(r.bits) : (r.range + 1) * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _propose(frequent, pairs, triples, word_bits: int, pair_bits: int, range_bits: int = CANDIDATE_BITS, most_held: int = CANDIDATES_HELD):
    """Pairs that pass the sieve, triples of which both pairs do and that pass theirs, with their number, packed by ranges."""

    def found(symbols, codes, starts) -> Iterator[tuple[np.ndarray, ...]]:
        place, which, a, b = _passing(symbols, codes, frequent.value, pairs.value, word_bits, pair_bits)
        n = np.bincount(which[place < starts], minlength=len(a))
        some = n > 0
        yield a[some], b[some], a[some], np.zeros(int(some.sum()), bool), n[some]
        x, y, n = _triples(place, which, starts, len(a))
        some = _has(triples.value, _bucket(_mixed(_mixed(a, b)[x], b[y]), pair_bits))
        x, y, n = x[some], y[some], n[some]
        yield a[x], b[x], b[y], np.ones(len(x), bool), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in _opened(batch):
                for some in found(*block):
                    held.append(some)
                    size += len(some[0])
                if size >= most_held:
                    yield _packed_phrases(_added(held), range_bits)
                    held, size = [], 0
        if size:
            yield _packed_phrases(_added(held), range_bits)
        _released()

    return run


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Phrases as three words, whether the third counts, and how often: each phrase once, in the order of its words."""
    first, second, third, long, n = map(np.concatenate, zip(*parts))
    third = np.where(long, third, 0)
    order = np.lexsort((long, third, second, first))
    words = [x[order] for x in (first, second, third, long)]
    new = np.append(True, np.any([x[1:] != x[:-1] for x in words], axis=0))[: len(order)]
    return *(x[new] for x in words), np.add.reduceat(n[order], np.flatnonzero(new)) if len(order) else n


def _packed_phrases(phrases: tuple[np.ndarray, ...], range_bits: int) -> pa.RecordBatch:
    """Phrases by ranges of the hash of their first two words: the words of a range once each, and their places there."""
    at = _bucket(_mixed(phrases[0], phrases[1]), range_bits)
    order = np.argsort(at, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(at[order])) + 1), len(order)]
    rows = []
    for part in (order[a:b] for a, b in zip(cuts, cuts[1:])):
        first, second, third, long, n = (x[part] for x in phrases)
        words, place = np.unique(np.concatenate([first, second, third[long]]), return_inverse=True)
        thirds = np.zeros(len(part), np.int64)
        thirds[long] = place[2 * len(part) :] + 1
        # First words ascend: their steps are small.
        rows.append((int(at[part[0]]), len(part), words.tobytes(), *map(_packed, (np.diff(place[: len(part)], prepend=0), place[len(part) : 2 * len(part)], thirds, n))))
    columns = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["range", "size", "words", "first", "second", "third", "n"])


def _sent(row: dict) -> tuple[np.ndarray, ...]:
    """Words of packed phrases, the places there of the first, the second and, plus one, the third word of each (0: none), and how often."""
    first, second, third, n = (_unpacked(row[c], row["size"]).astype(np.int64) for c in ("first", "second", "third", "n"))
    return np.frombuffer(row["words"], np.int64), np.cumsum(first), second, third, n


def _proposed(least: int, most_held: int = 1 << 21):
    """Packed phrases of one range -> those that occur ``least`` times, each once."""

    def phrases(row: dict) -> tuple[np.ndarray, ...]:
        words, first, second, third, n = _sent(row)
        return words[first], words[second], words[third - 1], third > 0, n

    def run(table: pa.Table) -> pa.Table:
        held, size, limit = [], 0, most_held
        for batch in table.to_batches(max_chunksize=64):
            for row in batch.to_pylist():
                held.append(phrases(row))
                size += row["size"]
                if size >= limit:
                    held = [_added(held)]
                    size = len(held[0][0])
                    limit = max(most_held, 2 * size)
        first, second, third, long, n = _added(held)
        keep = n >= least
        return pa.table({"s1": pa.array(first[keep]), "s2": pa.array(second[keep]), "s3": pa.array(third[keep], mask=~long[keep])})

    return run


def _counted(least: int, portion: int):
    """Packed phrases of one range -> its candidates that occur ``least`` times, counted by tries of at most ``portion`` candidates."""
    proposed = _proposed(least)

    def run(table: pa.Table) -> pa.Table:
        candidates = proposed(table)
        counts = [np.zeros(0, np.int64)]
        for start in range(0, candidates.num_rows, portion):
            some = candidates.slice(start, portion)
            trie, total, least_word, last_word = _trie(some), np.zeros(some.num_rows, np.int64), some["s1"][0].as_py(), some["s1"][-1].as_py()
            for batch in table.to_batches(max_chunksize=64):
                for row in batch.to_pylist():
                    words, first, second, third, n = _sent(row)
                    # Candidates and the phrases of a row ascend by their first words: what other portions hold is passed by.
                    here = slice(np.searchsorted(words[first], least_word), np.searchsorted(words[first], last_word, "right"))
                    codes = np.append(0, trie.codes(words))
                    texts = np.stack([codes[first[here] + 1], codes[second[here] + 1], codes[third[here]]], axis=1)
                    end = trie.reached(texts, 2 + (third[here] > 0))
                    ids = np.where(end >= 0, trie.accepts[end], -1)
                    total += np.bincount(ids[ids >= 0], n[here][ids >= 0], len(total)).astype(np.int64)
            counts.append(total)
        found = candidates.append_column("n", pa.array(np.concatenate(counts)))
        return found.filter(pa.array(found["n"].to_numpy() >= least))

    return run


def _symbol(salt: str) -> Column:
    return F.xxhash64(F.concat(F.lit(salt), "lang", F.lit("\0"), "word"))


def _encoded(docs: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, all words with their counts, under hashes that tell all of them apart, and the sum of the counts."""
    for salt in map(str, range(100)):
        with small_batches(docs.sparkSession):
            table = materialise(docs.select("text", "lang").mapInArrow(_encode(salt, block_words, WORDS_HELD), BLOCK), "phrase_blocks", compression="zstd")
        counted = table.where(F.col("word").isNotNull()).groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words, facts = materialise_with(counted.withColumn("symbol", _symbol(salt)), "phrase_words", n=F.sum("n"))
        if words.groupBy("symbol").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return table.where(F.col("word").isNull()).select("symbols", "codes", "n_codes", "starts"), words, facts["n"] or 0
    raise RuntimeError("no hash tells all words apart")


def _bits(number: int) -> int:
    """Bits of the least power of two that is at least ``number``."""
    return max(0, number - 1).bit_length()


def phrase_counts(
    docs: DataFrame,
    least: int = 10,
    lang_col: str = "lang",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    word_bits: int = WORD_BITS,
    pair_bits: int | None = None,
    portion: int = PORTION,
) -> tuple[DataFrame, DataFrame]:
    """All words (``lang, word, n, symbol``) and all phrases of two or three words that occur ``least`` times (``s1, s2, s3, n``).

    ``s3`` is null for pairs.  What is broadcast is bounded by ``word_bits`` and ``pair_bits`` (by default those of the corpus, at most
    ``MOST_PAIR_BITS``), a trie by ``portion``, whatever the corpus: a small sieve proposes more candidates, which takes no more passes.
    """
    spark = docs.sparkSession
    language = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE))
    blocks, words, total = _encoded(_texts(docs, language, text_col), block_words)
    if pair_bits is None:
        pair_bits = min(max(PAIR_BITS, _bits(total) - 1), MOST_PAIR_BITS)
    range_bits = max(CANDIDATE_BITS, _bits(total) - RANGE_WORD_BITS)
    context = spark.sparkContext
    kept = words.where(F.col("n") >= least)
    frequent = context.broadcast(_fixed_bitmap(kept.select(F.col("symbol").bitwiseAND(F.lit((1 << word_bits) - 1)).alias("bucket")), word_bits))
    with small_batches(spark, BLOCK_ROWS):
        pairs = context.broadcast(_sieve(blocks, _pair_buckets(frequent, word_bits, pair_bits), least, pair_bits))
        triples = context.broadcast(_sieve(blocks, _triple_buckets(frequent, pairs, word_bits, pair_bits), least, pair_bits))
        packed = blocks.mapInArrow(
            _propose(frequent, pairs, triples, word_bits, pair_bits, range_bits),
            "range int, size int, words binary, first binary, second binary, third binary, n binary",
        )
        counted = packed.groupBy("range").applyInArrow(_counted(least, portion), "s1 bigint, s2 bigint, s3 bigint, n bigint")
        phrases = materialise(counted, "phrases")
    frequent.unpersist(), pairs.unpersist(), triples.unpersist()
    return words, phrases


def _texts(docs: DataFrame, language: Column, text_col: str) -> DataFrame:
    no_id = docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text"), language.alias("lang"))
    return text_rows(no_id, lang="lang").drop("doc_id")


def _trie(candidates: pa.Table) -> DoubleArray:
    third = candidates["s3"]
    phrases = np.stack([candidates["s1"].to_numpy(), candidates["s2"].to_numpy(), third.fill_null(0).to_numpy()], axis=1)
    lengths = np.where(third.is_null().to_numpy(), 2, 3)
    return DoubleArray.of(phrases.astype(np.int64), lengths, np.arange(len(phrases)))


def collocations(
    docs: DataFrame, least: int = 10, most: int = 2000, inside_percent: int = 50, lang_col: str = "lang", text_col: str = "text", **sizes: int
) -> DataFrame:
    """Per language its ``most`` best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of two or three words that occurs ``a`` >= ``least`` times is cut in two where ``1,000,000 a a / (l r)``, rounded down, is
    lowest, at the first such place; ``l`` and ``r`` count both parts, ``n`` all words of the language.  It is left out where a
    longer one that contains it has at least ``inside_percent`` percent of its count.  Ranks go by score and ``a`` descending, then by
    the phrase's bytes.  Products are decimals of 37 digits.

    A null text is empty, a null language is ``und``; a very long text spans blocks; repeated rows count each; ties are broken as
    said; an empty table gives no rows; other columns are ignored.  ``sizes`` are those of ``phrase_counts``.
    """
    words, phrases = phrase_counts(docs, least, lang_col, text_col, **sizes)
    kept = materialise(words.where(F.col("n") >= least).select("symbol", "lang", "word", F.col("n").alias("count")), "frequent_words")
    of_word = lambda i, *more: kept.select(F.col("symbol").alias(f"s{i}"), *more)
    number = lambda i: F.col("count").alias(f"c{i}")
    pairs = materialise(phrases.where(F.col("s3").isNull()).select("s1", "s2", F.col("n").alias("a")), "frequent_pairs")
    triples = materialise(phrases.where(F.col("s3").isNotNull()).select("s1", "s2", "s3", F.col("n").alias("a")), "frequent_triples")
    around = triples.select(F.inline(F.array(F.struct("s1", "s2", "a"), F.struct(F.col("s2").alias("s1"), F.col("s3").alias("s2"), "a"))))
    none = F.lit(None).cast("bigint")
    beside = pairs.withColumn("longer", none).unionByName(around.select("s1", "s2", none.alias("a"), F.col("a").alias("longer")))
    alone = beside.groupBy("s1", "s2").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    alone = alone.where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside_percent, F.lit(True))).drop("longer")
    cut = lambda left, right: F.struct(F.col(left).alias("l"), F.col(right).alias("r"))
    twos = join_lookup(join_lookup(alone, of_word(1, "lang", number(1)), ["s1"], ["s2"]), of_word(2, number(2)), ["s2"], ["s1"])
    head = pairs.select("s1", "s2", F.col("a").alias("c12"))
    tail = pairs.select(F.col("s1").alias("s2"), F.col("s2").alias("s3"), F.col("a").alias("c23"))
    threes = _met(materialise(_met(triples, head, ["s1", "s2"]), "headed_triples"), tail, ["s2", "s3"])
    threes = join_lookup(join_lookup(threes, of_word(1, "lang", number(1)), ["s1"], ["s3"]), of_word(3, number(3)), ["s3"], ["s1"])
    both = twos.select("lang", "s1", "s2", F.lit(None).cast("bigint").alias("s3"), "a", F.array(cut("c1", "c2")).alias("cuts")).unionByName(
        threes.select("lang", "s1", "s2", "s3", "a", F.array(cut("c1", "c23"), cut("c12", "c3")).alias("cuts"))
    )
    # Equal scores keep the earlier cut: structs compare by score, then by place.
    least_cut = F.array_min(F.transform("cuts", lambda x, i: F.struct(_score(F.col("a"), x["l"], x["r"]).alias("score"), i.alias("k"), x["l"].alias("l"), x["r"].alias("r"))))
    scored = both.withColumn("cut", least_cut).select("lang", "s1", "s2", "s3", "a", "cut.l", "cut.r", "cut.score")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    top = materialise(scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= most).drop("place"), "top_phrases")
    named = top.join(of_word(1, F.col("word").alias("w1")), "s1").join(of_word(2, F.col("word").alias("w2")), "s2")
    named = named.join(of_word(3, F.col("word").alias("w3")), "s3", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    ranked = named.withColumn("rank", F.row_number().over(by_score.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= most)
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "language_words")
    return join_lookup(ranked, totals, ["lang"], ["phrase"]).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _met(phrases: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases with the count of a part; a part of very many phrases is spread over tasks."""
    hot = hot_keys(phrases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, HOT_PART)
    if not hot.count:
        return phrases.join(counts, keys)
    spread = ["a", "s1", "s2", "s3"]
    of_hot = materialise(join_lookup(counts, hot.table, keys, keys), "hot_counts")
    rest = join_lookup(phrases, hot.table, keys, spread, "left_anti")
    return join_lookup(phrases, of_hot, keys, spread).unionByName(rest.join(counts, keys))


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(MICRO), wide(left) * wide(right))
