"""Double-array tries of phrases, walked by all positions of a text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A word is two digits of this many bits, so a node has at most 2,048 children and rows pack well.
DIGIT_BITS = 11
DIGITS = 1 << DIGIT_BITS
MOST_WORDS = DIGITS * DIGITS - 1
_TRIES = 24


@dataclass
class DoubleArray:
    """Slot ``base[s] + digit`` holds the child of slot ``s`` if ``check`` there is ``s``; ``accepts`` has a phrase's id or -1.

    ``words`` are the sorted hashes of all words in the phrases; a word's code is its place there plus one.
    """

    words: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray

    @classmethod
    def of(cls, phrases: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> "DoubleArray":
        """``phrases`` are rows of word hashes, ``lengths`` how many of a row's count."""
        inside = np.arange(phrases.shape[1]) < lengths[:, None]
        words = np.unique(phrases[inside])
        if len(words) > MOST_WORDS:
            raise ValueError("more words than two digits tell apart; take smaller portions")
        codes = np.where(inside, np.searchsorted(words, phrases) + 1, 0)
        # Nodes level by level: a node is (parent, digit), numbered; the root is node 0.
        at = np.zeros(len(phrases), dtype=np.int64)
        parents, digits, count = [], [], 1
        for k in range(phrases.shape[1]):
            for shift in (DIGIT_BITS, 0):
                going = inside[:, k]
                digit = (codes[:, k] >> shift) & (DIGITS - 1)
                keys, found = np.unique(at[going] * DIGITS + digit[going], return_inverse=True)
                parents.append(keys // DIGITS)
                digits.append(keys % DIGITS)
                at[going] = count + found
                count += len(keys)
        slot_of, base, check = _placed(np.concatenate(parents), np.concatenate(digits), count)
        accepts = np.full(len(base), -1, dtype=np.int64)
        accepts[slot_of[at]] = ids
        return cls(words, base, check, accepts)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Code of each hash, 0 for a word in no phrase."""
        place = np.minimum(np.searchsorted(self.words, symbols), max(0, len(self.words) - 1))
        return np.where(self.words[place] == symbols, place + 1, 0) if len(self.words) else np.zeros(len(symbols), np.int64)

    def counts(self, codes: np.ndarray, starts: int, most: int) -> np.ndarray:
        """How often each slot is reached at a word's end from the first ``starts`` positions of ``codes`` (0: none)."""
        total = np.zeros(len(self.base), dtype=np.int64)
        place = np.flatnonzero(codes[:starts])
        state = np.zeros(len(place), dtype=np.int32)
        for k in range(most):
            inside = place + k < len(codes)
            place, state = self._onward(place[inside], state[inside], codes[place[inside] + k])
            if not len(place):
                break
            total += np.bincount(state, minlength=len(total))
        return total

    def reached(self, phrases: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot in which each row of codes ends, of which ``lengths`` count; -1 where the trie has no such way."""
        end = np.full(len(phrases), -1, dtype=np.int64)
        row, state = np.arange(len(phrases)), np.zeros(len(phrases), dtype=np.int32)
        for k in range(phrases.shape[1]):
            row, state = self._onward(row, state, phrases[row, k])
            over = lengths[row] == k + 1
            end[row[over]] = state[over]
            row, state = row[~over], state[~over]
        return end

    def _onward(self, who: np.ndarray, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that get on from their states by a word, and where they are then."""
        for shift in (DIGIT_BITS, 0):
            slot = self.base[state] + (code >> shift & (DIGITS - 1))
            alive = (self.check[slot] == state) & (code > 0)
            who, state, code = who[alive], slot[alive].astype(np.int32), code[alive]
        return who, state


def _placed(parents: np.ndarray, digits: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all nodes, and both arrays; children of a node lie at their digits from a common base.

    Large families are placed first, at bases drawn from a fixed sequence, at the end where none of the draws is free;
    an only child takes any free slot.
    """
    order = np.lexsort((digits, parents))
    parents, digits, child = parents[order], digits[order], 1 + order
    heads = np.flatnonzero(np.diff(parents, prepend=-1))
    sizes = np.diff(np.append(heads, len(parents)))
    size = DIGITS + int(1.6 * count)
    used = np.zeros(size + DIGITS, dtype=bool)
    base_of = np.zeros(count, dtype=np.int64)
    slot_of = np.zeros(count, dtype=np.int64)
    used[0] = True
    draw = np.random.default_rng(0)
    for i in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
        family = slice(heads[i], heads[i] + sizes[i])
        steps = digits[family]
        for b in draw.integers(1, size - DIGITS, _TRIES).tolist() if parents[heads[i]] else [1]:
            if not used[b + steps].any():
                break
        else:
            b = size
            size += DIGITS
            used = np.append(used, np.zeros(DIGITS, dtype=bool))
        used[b + steps] = True
        base_of[parents[heads[i]]] = b
        slot_of[child[family]] = b + steps
    only = heads[sizes == 1]
    free = np.flatnonzero(~used[DIGITS:]) + DIGITS
    if len(free) < len(only):
        free = np.append(free, np.arange(len(used), len(used) + len(only)))
    slots = free[: len(only)]
    base_of[parents[only]] = slots - digits[only]
    slot_of[child[only]] = slots
    length = int(max(len(used), slots.max(initial=0) + 1)) + DIGITS
    base, check = np.zeros(length, dtype=np.int32), np.full(length, -1, dtype=np.int32)
    base[slot_of] = base_of
    check[slot_of[child]] = slot_of[parents]
    return slot_of, base, check
