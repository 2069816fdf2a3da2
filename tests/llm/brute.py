"""Plain Python versions of the corpus queries, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def encode(path, texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def shingles(text, n):
    words = WORD.findall(lowered(text or ""))
    if not words:
        return []
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def simhash(text, n=3):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_components(ids, texts, bits=2):
    fps = [simhash(t) for t in texts]
    distinct = sorted(set(fps))
    numbers = np.array(distinct, dtype=np.uint64)
    links = []
    for i, fp in enumerate(distinct):
        near = np.flatnonzero(np.bitwise_count(numbers ^ np.uint64(fp)) <= bits)
        links += [(fp, distinct[j]) for j in near if j != i]
    root = roots(distinct, links)
    least = {}
    for i, fp in zip(ids, fps):
        least[root[fp]] = min(least.get(root[fp], i), i)
    return {i: (f"{fp:016x}", least[root[fp]]) for i, fp in zip(ids, fps)}


def similar_components(ids, texts, n=5, similarity=0.8):
    sets = [frozenset(shingles(t, n)) for t in texts]
    holders = defaultdict(set)
    for i, s in zip(ids, sets):
        for x in s or [None]:
            holders[x].add(i)
    by_id = dict(zip(ids, sets))
    links, seen = [], set()
    for group in holders.values():
        for a, b in combinations(sorted(group), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                x, y = by_id[a], by_id[b]
                if x == y or len(x & y) >= similarity * len(x | y):
                    links.append((a, b))
    return roots(ids, links)


ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spans_digest(spans):
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(listed.encode()).hexdigest()


def peak_entropy(text, window=20):
    best = 0.0
    for i in range(len(text) - window + 1):
        counts = Counter(text[i : i + window]).values()
        best = max(best, -sum(c / window * np.log2(c / window) for c in counts))
    return best


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), len(covered), failed)


def backoff_scores(texts, order=2, backoff=0.4, least=2):
    docs = [lowered(t or "").split() for t in (re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts)]
    docs = [WORD.findall(lowered(t or "")) for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score = 0.0
        for i in range(len(d)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1 : i + 1])
                if n == 1 or counts[gram] >= least:
                    share = counts[gram] / (counts[gram[:-1]] if n > 1 else total)
                    score += np.log(share) + (order - n) * np.log(backoff)
                    break
        out.append((len(d), score))
    return out


def all_spans(text, classes, allow, candidate):
    """Base spans and those of the entropy rule, from the same patterns."""
    base = base_spans(text)
    found = list(base)
    for m in re.finditer(candidate, text):
        if any(re.search(a, m[0]) for a in allow):
            continue
        bits, window = next(((b, w) for _, p, w, b in classes if re.fullmatch(p, m[0])), (None, 0))
        if bits is None or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        # The rule sums whole millionths; a window on the line counts.
        if round(peak_entropy(m[0], window), 5) >= bits:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{a}:{b}" for a, k, b in sorted(found))


_ALL = (1 << 64) - 1


def _spread(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & _ALL
    return x ^ x >> 29


def lz_fingerprint(text, slots=128):
    """Phrases by a tree of characters, hashes in Python's whole numbers, slots one by one."""
    if not text:
        return "ffff" * slots
    tree, node, phrases, current = {}, None, set(), ""
    node = tree
    for c in text:
        current += c
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            phrases.add(current)
            node, current = tree, ""
    if current:
        phrases.add(current)
    least = {}
    for p in phrases:
        terms = (_spread(((ord(c) + 1) * 0x9E3779B97F4A7C15 + _spread(i + 1)) & _ALL) for i, c in enumerate(p))
        h = _spread(sum(terms) & _ALL)
        least[h % slots] = min(least.get(h % slots, _ALL), h)
    out = []
    for slot in range(slots):
        gap = next(g for g in range(slots) if (slot + g) % slots in least)
        out.append(_spread((least[(slot + gap) % slots] + gap * 0x9E3779B97F4A7C15) & _ALL) >> 48)
    return "".join(f"{x:04x}" for x in out)


def lz_likeness(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    return sum(x == y for x, y in pairs) / len(pairs)
