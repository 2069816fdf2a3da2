"""Token ids of whole texts, with each distinct piece of a task encoded once."""

from __future__ import annotations

import re
from codecs import charmap_decode
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Without U+0130: its lower case ends in a mark, which joins the marks after it.
_LETTER = r"A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: ASCII marks without the apostrophe, which begins units such as ``'s``.
_MARK = r"!-&(-/:-@\[-`{-~"
#: A run of letters before a mark or white space; a comma or full stop before white space; any
#: other run.  A cut between these never lies inside a unit that merges are applied to, because
#: both vocabularies separate letters from marks and never join what white space parts.
_LEADING = f" ?[{_LETTER}]+(?=[{_MARK} \n]|$)|[,.](?=[ \n]|$)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_BARE = f"[{_LETTER}]+(?=[{_MARK} \n]|$)|[,.](?=[ \n]|$)|[^{_SPACE}]+"
#: ``leading``: white space is kept and one space belongs to the word after it (byte-level BPE);
#: ``bare``: white space is dropped (BPE with word ends).
CUTS = {"leading": re.compile(_LEADING), "bare": re.compile(_BARE)}

#: Pieces of letters alone: one unit each, of which only case and bytes matter.
PLAIN = {"leading": re.compile(f" [{_LETTER}]+"), "bare": re.compile(f"[{_LETTER}]+")}
#: The character that byte-level vocabularies write for each byte.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = "".join(chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256))

#: Pieces a worker remembers; a full memory keeps those met most, which costs time and nothing else.
MEMORY = 300_000


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, thing: str) -> int:
        number = self[thing] = len(self)
        return number


class PieceEncoder:
    """Ids of texts as the tokenizer file gives them for the whole text with ``add_special_tokens=False``.

    Texts are cut where the vocabulary never merges (``cut``), and each distinct piece is
    encoded once.  The string of an added token, such as ``<|endoftext|>``, is that token's one id, as in
    the plain call, and parts the text around it.
    """

    def __init__(self, path: str, cut: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = CUTS[cut].findall
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path}: added tokens that depend on the text around them")
        self.added = {t.content: i for i, t in added.items()}
        self.parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split
        # One added token keeps the pieces of a long joint text apart, which costs far less than an
        # encoding object for each piece.
        self.between, self.between_id = next(iter(self.added.items()), (None, None))
        self.plain, self.units, self.edge = self._units(cut)
        self._forget()

    def _units(self, cut: str):
        """The test for pieces of letters alone, the same vocabulary for their joint text, and which ids stand at an edge of a unit.

        Such pieces need none of the file's patterns: lower case, if the file has it, and bytes are written here, and only
        a line feed parts two of them.  If the file does more to letters, no piece counts as plain.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = bool(suffix)
        letters = "".join(c for c in map(chr, range(0x250)) if PLAIN["bare"].fullmatch(c))
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lower = normal is not None and normal.normalize_str(letters) == letters.lower()
        probe = f" {letters}" if cut == "leading" else letters
        found = split.pre_tokenize_str(normal.normalize_str(probe) if normal else probe) if split else []
        if [x for x, _ in found] != [self._shown([probe])] or (cut == "bare") != self.ends:
            return lambda piece: None, None, None
        units = Tokenizer(self.tokenizer.model)
        units.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_BYTES[ord("\n")])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        edge[[i for x, i in vocabulary.items() if (x.endswith(suffix) if suffix else x.startswith(_BYTES[ord(" ")]))]] = True
        return PLAIN[cut].fullmatch, units, edge

    def _shown(self, pieces: list[str]) -> str:
        """A line for each piece, as the vocabulary writes it."""
        text = "\n".join(pieces)
        return charmap_decode((text.lower() if self.lower else text).encode(), "strict", _BYTES)[0]

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)
        self.met = np.zeros(1 << 16, dtype=np.int64)
        self.learned = self.used = 0

    def _keep_frequent(self) -> None:
        """Of a full memory keep the pieces met more than once, half of it at most; old counts fade."""
        met = self.met[: self.learned]
        least = max(2, int(np.partition(met, -MEMORY // 2)[-MEMORY // 2]) + 1)
        kept = np.flatnonzero(met >= least)
        names = list(self.known)
        ids, sizes, met = self._gathered(kept), self.sizes[kept], met[kept] // 2
        self._forget()
        self.known.update((names[i], k) for k, i in enumerate(kept.tolist()))
        self._add(ids, sizes)
        self.met[: len(met)] = met

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        """Ids of numbered pieces, end to end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _add(self, found: np.ndarray, sizes: np.ndarray, order: np.ndarray | slice = slice(None)) -> None:
        """Pieces of these sizes, ids end to end, get the next numbers in this order."""
        first, last, total = self.learned, self.learned + len(sizes), len(found)
        self.ids = _grown(self.ids, self.used + total)
        self.starts, self.sizes, self.met = (_grown(x, last) for x in (self.starts, self.sizes, self.met))
        self.ids[self.used : self.used + total] = found
        self.sizes[first:last][order] = sizes
        self.starts[first:last][order] = self.used + np.cumsum(sizes) - sizes
        self.learned, self.used = last, self.used + total

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            plain = np.fromiter((self.plain(p) is not None for p in some), dtype=bool, count=len(some))
            letters, rest = self._plain_ids(list(compress(some, plain))), self._ids(list(compress(some, ~plain)))
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            self._add(*map(np.concatenate, zip(letters, rest)), order)

    def _plain_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_ids`` of pieces of letters alone: a unit's one edge tells where it ends or starts."""
        if not pieces:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ids = np.array(self.units.encode_batch_fast([self._shown(pieces)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(pieces):
            return self._ids(pieces)
        return ids, np.diff(edges, prepend=-1) if self.ends else np.diff(edges, append=len(ids))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many belong to each piece."""
        if self.between is not None and not any(p in self.added for p in pieces):
            joined = self.tokenizer.encode_batch_fast([self.between.join(pieces)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) == len(pieces) - 1:
                return np.delete(ids, cuts), np.diff([-1, *cuts, len(ids)]) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _cut(self, text: str) -> list[str]:
        if not any(t in text for t in self.added):
            return self.pieces(text)
        return [p for part in self.parts(text) for p in ([part] if part in self.added else self.pieces(part))]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text."""
        if self.learned != len(self.known):  # an earlier call was broken off
            self._forget()
        elif self.learned > MEMORY:
            self._keep_frequent()
        cut = [self._cut(t) for t in texts]
        counts = [len(p) for p in cut]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(counts))
        del cut
        if len(self.known) > self.learned:
            self._learn(list(islice(reversed(self.known), len(self.known) - self.learned))[::-1])
        self.met[: self.learned] += np.bincount(at, minlength=self.learned)
        bounds = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.cumsum([0, *counts])]
        flat = self._gathered(at)
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])


@lru_cache(maxsize=2)
def encoder(path: str, cut: str) -> PieceEncoder:
    """The worker's encoder; kept from task to task."""
    return PieceEncoder(path, cut)


def portions(texts: pa.Array, chars: int = 500_000) -> Iterator[slice]:
    """Slices of about ``chars`` bytes of text, a longer text alone; texts need not be Python strings yet."""
    first = held = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + size > chars:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if first < len(texts):
        yield slice(first, len(texts))
