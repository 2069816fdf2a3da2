"""Phrases and their counts against plain Python; tries against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from flowtide.llm import phrases
from flowtide.llm.trie import DoubleArray

SCHEMA = "doc_id long, text string, lang string, word string, n long, symbol long, s1 long, codes string"


def pieces(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain(rows, least, most):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            counts.update((lang or "und", *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in found.items():
        longer = [found[t] for t in found if len(t) > len(p) and t[0] == p[0] and p[1:] in (t[1:3], t[2:4])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[p[: k + 1]] * counts[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])]))
    return {
        (lang, i + 1, phrase.decode(), -a, x, y, total[lang], -score)
        for lang, listed in out.items() for i, (score, a, phrase, x, y) in enumerate(sorted(listed)[:most])
    }


def made(seed, n=120):
    draw = random.Random(seed)
    words = ["the", "The", "a", "é", "E\u0301", "New", "york", "city", "x\u00a0y", "50%", "of", "\U0001f600"]
    marks = [" ", " ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", " ; ", "?!"]
    text = lambda k: "".join(draw.choice(words) + draw.choice(marks) for _ in range(k))
    rows = [(draw.choice(["en", "de", None]), text(draw.randrange(60))) for _ in range(n)]
    return rows + [(None, None), ("en", ""), ("fr", " \t\n"), ("en", "New York city " * 400)] + rows[:7]


def collocations(spark, rows, **how):
    table = spark.createDataFrame([(i, t, g, "w", 1, 2, 3, "c") for i, (g, t) in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in phrases.collocations(table.repartition(3), **how).collect()}


@pytest.mark.parametrize("sizes", [{}, {"block_words": 50, "word_bits": 4, "pair_bits": 3, "portion": 20}])
def test_phrases_against_plain_counts(spark, sizes):
    """The second time the sieve lets everything through, candidates take many tries and texts many blocks."""
    rows = made(5)
    assert collocations(spark, rows, **sizes) == plain(rows, 10, 2000)


def test_ranks_are_cut_and_an_empty_table_is_empty(spark):
    rows = made(6)
    assert collocations(spark, rows, least=3, most=4) == plain(rows, 3, 4)
    assert collocations(spark, []) == set()


def test_tries_count_every_phrase():
    draw = np.random.default_rng(3)
    words = draw.integers(-(2**62), 2**62, 6000)
    numbers = draw.zipf(1.3, (30_000, 3)) % 6000
    lengths = draw.integers(2, 4, len(numbers))
    numbers[lengths == 2, 2] = 0
    numbers, kept = np.unique(numbers * 4 + (np.arange(3) == 2) * (lengths[:, None] == 3), axis=0, return_index=True)
    lengths, numbers = lengths[kept], numbers // 4
    trie = DoubleArray.of(words[numbers], lengths, np.arange(len(numbers)))
    text = draw.zipf(1.3, 50_000) % 6000 + 1
    text[draw.random(len(text)) < 0.1] = 0
    counts = trie.counts(np.append(0, trie.codes(words))[text], len(text), 3)
    listed = text.tolist()
    want = Counter(tuple(listed[i : i + k]) for k in (2, 3) for i in range(len(text) - k + 1) if 0 not in listed[i : i + k])
    got = {int(trie.accepts[s]): int(counts[s]) for s in np.flatnonzero(trie.accepts >= 0)}
    assert got == {i: want[tuple((numbers[i, : lengths[i]] + 1).tolist())] for i in range(len(numbers))}


def test_packed_counts_of_buckets(monkeypatch):
    """The sieve sends packed counts, a few bytes a bucket and block, and finds the buckets met often enough in all blocks."""
    draw, bits, least = np.random.default_rng(3), 21, 10
    monkeypatch.setattr(phrases, "_opened", lambda batch: batch)
    blocks = []
    for _ in range(4):
        bucket = draw.integers(0, 1 << bits, 60_000)
        blocks.append((np.append(bucket, [5, 5, (1 << bits) - 1]), np.append(draw.integers(1, 6, 60_000), [2, 1, 40])))
    rows = pa.concat_tables([pa.Table.from_batches([b]) for b in phrases._met_buckets(lambda *b: b, least, bits)([blocks])])
    want = sum(np.bincount(b, n, 1 << bits) for b, n in blocks) >= least
    got = np.zeros(1 << bits, bool)
    for r in sorted(set(rows["range"].to_pylist())):
        found = phrases._reached(least, bits)(rows.filter(pa.compute.equal(rows["range"], r)))
        part = np.unpackbits(np.frombuffer(found["bits"][0].as_py(), np.uint8), bitorder="little")
        got[r * len(part) : (r + 1) * len(part)] = part
    assert got[5] and (got == want).all() and want.sum() > 100
    assert rows.nbytes < 4 * sum(rows["size"].to_pylist())


def test_candidates_are_sent_packed():
    draw = np.random.default_rng(2)
    words = draw.integers(-(1 << 63), (1 << 63) - 1, 60)
    parts, plain = [], Counter()
    for _ in range(30):
        first, second, third = (draw.choice(words, 2_000) for _ in range(3))
        long, n = draw.random(2_000) < 0.5, draw.integers(1, 5, 2_000)
        parts.append((first, second, third, long, n))
        for a, b, c, is_long, k in zip(first.tolist(), second.tolist(), third.tolist(), long.tolist(), n.tolist()):
            plain[a, b, c if is_long else None] += k
    sent = [phrases._packed_phrases(phrases._added(parts[i : i + 10]), 2) for i in range(0, 30, 10)]
    rows, ranges = sum(b.column("size").to_pylist()[i] for b in sent for i in range(b.num_rows)), pa.Table.from_batches(sent)
    assert ranges.nbytes < 10 * rows  # as rows: 32 bytes each
    found = Counter()
    for r in set(ranges["range"].to_pylist()):
        got = phrases._proposed(least=12, most_held=5_000)(ranges.filter(pa.compute.equal(ranges["range"], r)))
        found.update(zip(*(got[c].to_pylist() for c in ("s1", "s2", "s3"))))
    assert found == Counter({p: 1 for p, n in plain.items() if n >= 12})


def test_tables_do_not_grow_with_candidates(spark, monkeypatch):
    """Many tries take no more passes: each table is written once, whatever the size of a trie."""
    rows, names, real = made(7), [], phrases.materialise
    monkeypatch.setattr(phrases, "materialise", lambda df, name, **more: names.append(name) or real(df, name, **more))
    assert collocations(spark, rows, portion=5) == plain(rows, 10, 2000)
    assert len(names) == len(set(names))


def test_candidates_of_a_range_are_counted_by_tries():
    """Whatever the size of a trie, also where all candidates of a trie begin with one word."""
    draw = np.random.default_rng(4)
    words = draw.integers(-(1 << 63), (1 << 63) - 1, 40)
    sent, plain = [], Counter()
    for _ in range(6):
        first, second, third = (words[draw.zipf(1.4, 3_000) % 40] for _ in range(3))
        long, n = draw.random(3_000) < 0.5, draw.integers(1, 5, 3_000)
        sent.append(phrases._packed_phrases(phrases._added([(first, second, third, long, n)]), 0))
        for a, b, c, is_long, k in zip(first.tolist(), second.tolist(), third.tolist(), long.tolist(), n.tolist()):
            plain[a, b, c if is_long else None] += k
    for portion in (7, 1 << 18):
        found = phrases._counted(12, portion)(pa.Table.from_batches(sent))
        got = list(zip(*(found[c].to_pylist() for c in ("s1", "s2", "s3", "n"))))
        assert len(got) > 500 and sorted(got, key=str) == sorted(((*p, n) for p, n in plain.items() if n >= 12), key=str)


@pytest.mark.parametrize("held", [0, 50, 10**6])
def test_words_are_counted_once_per_block_or_more(held):
    """Whatever a task holds before it sends its counts of words, also where nothing is left at its end."""
    rows = [(lang or "und", text or "") for lang, text in made(8)]
    batch = pa.record_batch({"text": pa.array([t for _, t in rows], pa.string()), "lang": pa.array([g for g, _ in rows], pa.string())})
    want, got, sent = Counter(), Counter(), 0
    for lang, text in rows:
        want.update((lang, w) for piece in pieces(text) for w in piece)
    for out in phrases._encode("0", 100, held)(iter([batch])):
        for row in out.to_pylist():
            if row["word"] is not None:
                got[row["lang"], row["word"]] += row["n"]
                sent += 1
    assert got == want and sent >= len(want)
    assert held < 10**6 or sent == len(want)
