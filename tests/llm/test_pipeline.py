"""The corpus pipeline, stage by stage, against plain versions on each stage's own input."""

from __future__ import annotations

import collections
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.llm import quality, queries
from peregrin.llm.common import materialise

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Input and output of each stage, as {doc_id: row}, and the last stage's pieces."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA), name.replace(" ", "-")))
    assert all(t.columns == docs.columns for t in out[:-1])
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_quality_rejects_what_the_report_says(tables):
    kept = {r.doc_id for r in quality.quality_report(tables[0]).where("kept").collect()}
    assert set(texts(tables[1])) == kept and 0 < len(kept) < tables[0].count()


def test_lines(tables):
    rows = [(r.doc_id, r.source, r.text) for r in tables[1].collect()]
    sites, first = collections.defaultdict(set), {}
    for k, s, t in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                first[x.strip(" ")] = min(k, first.get(x.strip(" "), k))
    want = {}
    for k, _, t in rows:
        left = [x for x in t.split("\n") if not (len(sites.get(x.strip(" "), ())) >= 10 and first[x.strip(" ")] != k)]
        if len(left) == len(t.split("\n")) or "".join(left).strip(" \t\r"):
            want[k] = "\n".join(left)
    assert texts(tables[2]) == want


def test_near_duplicates(tables):
    rows = sorted(texts(tables[2]).items())
    want = {k for k, (_, c) in brute.components(rows, 5).items() if k == c}
    assert set(texts(tables[3])) == want


def test_decontamination(spark, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r[0] for r in brute.contamination(sorted(texts(tables[3]).items()), items) if not r[-1]}
    assert set(texts(tables[4])) == want


def test_packing(tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_tokenizer())
    got = tables[5].toPandas()
    assert set(got.doc_id) == set(texts(tables[4]))
    for k, t in texts(tables[4]).items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = got[got.doc_id == k].sort_values("start")
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(own.start, own.length, strict=True)] and own.length.sum() == len(ids) // 4
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_the_last_stage(spark, tables):
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(tables[5])


def test_empty_documents(spark, tables, tmp_path):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_tables(spark):
    """Nulls, empty and repeated rows, ties, and columns with names that operators use."""
    import random

    from test_operators import make, prose

    rng = random.Random(3)
    good = prose(rng, 300)
    rows = [(1, good), (1, good), (2, good), (None, good), (3, None), (4, ""), (5, "x"), (6, prose(rng, 200)), (7, prose(rng, 200) + "\n" + "Same line here " * 3)]
    docs = make(spark, rows)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 6, None).otherwise(F.col("lang")))
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), name.replace(" ", "-"))
        if name != "packing":
            assert docs.columns == make(spark, rows[:1]).columns
    assert {r.doc_id for r in docs.collect()} >= {1, 6, 7} and not {2, 3, 4, 5} & {r.doc_id for r in docs.collect()}
