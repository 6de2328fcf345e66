"""Searches of many queries at once against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from peregrin.operators import retrieval as R
from test_scaled import plain_bm25


def test_best_are_those_of_everything_offered():
    rng = np.random.default_rng(5)
    scores, keys = rng.integers(0, 6, (90, 4)).astype(float), rng.permutation(90)
    scores[scores == 0] = -np.inf
    scores[:, 3] = -np.inf
    found = R.Best(4, 7)
    for a in range(0, 90, 11):
        found.offer(scores[a : a + 11], keys[a : a + 11])
    got = sorted(zip(found.q.tolist(), (-found.s).tolist(), found.d.tolist(), strict=True))
    want = [(q, *x) for q in range(4) for x in sorted((-scores[i, q], int(keys[i])) for i in range(90) if scores[i, q] > 0)[:7]]
    assert got == want


@pytest.mark.parametrize("dense,most", [(0.0, 1000), (0.02, 5), (2.0, 1000)])
def test_words_score_alike_in_the_matrix_and_in_lists(spark, monkeypatch, dense, most):
    monkeypatch.setattr(R, "DENSE", dense)
    monkeypatch.setattr(R, "DENSE_WORDS", most)
    monkeypatch.setattr(R, "PAIRS", 64)
    monkeypatch.setattr(R, "TEXT_BLOCK", 7)
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(18)], k=n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(120)] + [(500 + i, "ax ay bz") for i in range(20)] + [(900, "")]
    queries = [(i, text(rng.randrange(1, 60))) for i in range(10)] + [(20, "ax ay"), (21, "nothing"), (22, "")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = R.bm25_many(frame(docs, "doc_id long, text string"), frame(queries, "query_id long, query string"), top_k=5).collect()
    got, want = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got), sorted((q, r, i, s) for q, i, s, r in plain_bm25(docs, queries, 5))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
