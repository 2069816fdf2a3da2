"""Outlines of shingle sets never rule out a similar pair, and bring few others."""

from __future__ import annotations

import numpy as np
import pytest

from flowtide.llm.simhash import _folded, _may_share, _outline, _partnered, _possible


def sets_of(draw, kind):
    """Sets with everything, much, little or nothing in common."""
    base = draw.integers(0, 1 << 63, 600, dtype=np.uint64)
    if kind == "full cells":
        # All hashes end alike, so that one cell counts more than a byte holds.
        base = np.unique((base >> np.uint64(20)) << np.uint64(20))
    out = []
    for _ in range(40):
        size = int(draw.integers(1, len(base)))
        share = draw.choice([0.0, 0.5, 0.75, 0.85, 0.95, 1.0])
        kept = base[: int(size * share)]
        out.append(np.unique(np.concatenate([kept, draw.integers(0, 1 << 63, size - len(kept), dtype=np.uint64)])))
    return out


@pytest.mark.parametrize("kind", ["plain", "full cells"])
@pytest.mark.parametrize("similarity", [0.8, 0.3])
def test_no_similar_pair_is_ruled_out(kind, similarity):
    draw = np.random.default_rng(3)
    for _ in range(5):
        sets = sets_of(draw, kind)
        outlines, sizes = [_outline(s) for s in sets], np.array([len(s) for s in sets])
        roots = draw.integers(0, 4, len(sets))
        left, right = np.arange(0, 25), np.arange(20, 40)
        partner = np.zeros(len(sets), bool)
        for x in range(len(sets)):
            for y in range(len(sets)):
                both = len(np.intersect1d(sets[x], sets[y]))
                cells = min(len(outlines[x]), len(outlines[y]))
                shared = _may_share(_folded(outlines[x][None, :], cells), _folded(outlines[y][None, :], cells))
                assert shared[0] >= both
                if both >= similarity * (sizes[x] + sizes[y] - both):
                    assert _possible(sizes[x : x + 1], sizes[y], shared, similarity)[0]
                    if x in left and y in right and roots[x] != roots[y]:
                        partner[[x, y]] = True
        kept = _partnered(outlines, sizes, roots, left, right, similarity)
        assert partner.any() and not (partner & ~kept).any()


def test_texts_that_share_half_are_ruled_out():
    draw = np.random.default_rng(4)
    common = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, draw.integers(0, 1 << 63, 500, dtype=np.uint64)])) for _ in range(30)]
    kept = _partnered([_outline(s) for s in sets], np.array([len(s) for s in sets]), np.arange(30), np.arange(30), np.arange(30), 0.8)
    assert not kept.any()


def test_empty_sides():
    outlines, sizes = [_outline(np.zeros(0, np.uint64))] * 2, np.zeros(2, np.int64)
    assert not _partnered(outlines, sizes, np.arange(2), np.arange(0), np.arange(2), 0.8).any()
    assert not _partnered(outlines, sizes, np.arange(2), np.arange(2), np.arange(0), 0.8).any()
