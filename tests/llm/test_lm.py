"""Ranges of hashes that blocks of documents ask, and texts that ask nothing."""

from __future__ import annotations

import numpy as np

from flowtide.llm import lm


def test_no_row_without_n_grams():
    draw = np.random.default_rng(5)
    hashes = np.unique(np.concatenate([draw.integers(0, 1 << 64, 1_000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    for ranges in (1, 16, 1_000, 10**9):
        spans, cuts = lm._cuts(hashes, ranges)
        assert len(spans) <= min(ranges, len(hashes)) and len(cuts) == len(spans) + 1
        assert cuts[0] == 0 and cuts[-1] == len(hashes) and (np.diff(cuts) > 0).all()
        for span, a, b in zip(spans.tolist(), cuts, cuts[1:]):
            assert {((int(h) >> 32) * ranges) >> 32 for h in hashes[a:b]} == {span}
    spans, cuts = lm._cuts(np.zeros(0, np.uint64), 16)
    assert not len(spans) and cuts.tolist() == [0]


def test_blocks_of_blank_texts_keep_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, " "), (3, None), (4, "")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.mean_log_score is None) for r in lm.scores(docs, block_chars=1).collect()}
    assert got == {1: (4, False), 2: (0, True), 3: (0, True), 4: (0, True)}
    blank = lm.scores(docs.where("doc_id > 1")).collect()
    assert sorted((r.doc_id, r.n_words, r.log_score, r.mean_log_score) for r in blank) == [(2, 0, 0.0, None), (3, 0, 0.0, None), (4, 0, 0.0, None)]
