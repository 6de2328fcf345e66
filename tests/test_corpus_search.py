"""The text search answers every hundredth document, as brute force does."""

from __future__ import annotations

import math
import re
from collections import Counter

from peregrin.operators import retrieval as R
from peregrin.plans import catalogue

DATA = "/root/testdata/sf0.01"


def brute(docs: dict, queries: list, k: int) -> dict:
    words = {i: Counter(re.findall(r"[a-zA-Z']+", (t or "").lower())) for i, t in docs.items()}
    size = {i: sum(c.values()) for i, c in words.items()}
    mean, n = sum(size.values()) / len(docs), len(docs)
    df = Counter(t for c in words.values() for t in c)
    raw = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if v < 0 else v for t, v in raw.items()}
    out = {}
    for q in queries:
        scores = {i: sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for t, m in words[q].items() if t in c) for i, c in words.items()}
        for rank, (s, i) in enumerate(sorted(((-s, i) for i, s in scores.items() if s > 0), key=lambda x: (round(x[0], 6), x[1]))[:k], 1):
            out[q, rank] = (i, -s)
    return out


def test_whole_texts_as_queries_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "TEXT_BLOCK", 4)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    queries = [i for i in docs if i % 100 == 0]
    want = brute(docs, queries, 10)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in catalogue.queries()["bm25_topk_corpus"](spark, DATA).collect()}
    assert got.keys() == want.keys() and len(queries) > 5
    assert all(abs(got[x][1] - want[x][1]) < 1e-4 * max(1, want[x][1]) for x in want)
    assert sum(got[x][0] != want[x][0] for x in want) <= len(want) // 100  # ties in the last digit


def test_fusion_answers_every_query(spark):
    ids = {r[0] for t, c in (("documents", "doc_id"), ("embeddings", "vec_id")) for r in spark.read.parquet(f"{DATA}/{t}.parquet").where(f"{c} % 100 = 0").select(c).collect()}
    assert {r.query_id for r in catalogue.queries()["rrf_fusion_corpus"](spark, DATA).collect()} == ids
