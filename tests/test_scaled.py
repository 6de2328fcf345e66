"""The index, cells, one-pass k-means, classes, landing table, generators and stored graph against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.operators import cells as CL, cluster as C, graph as G, lloyd, postings as PO, retrieval as R
from peregrin.sources import landed as L, synthetic as SY, tables as TB

DATA = "/root/testdata/sf0.01"

# ------------------------------------------------------------------------ index


def plain_bm25(docs, queries, k):
    words = {i: t.split() for i, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else low for w, x in raw.items()}
    out = []
    for q, text in queries:
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in text.split() if w in tf)
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("rare,settled", [(PO.RARE, PO.SETTLED), (2, 0.9), (1, 0.0)])
def test_an_index_gives_the_scores_of_all_documents(spark, monkeypatch, rare, settled):
    monkeypatch.setattr(PO, "RARE", rare)
    monkeypatch.setattr(PO, "SETTLED", settled)
    monkeypatch.setattr(PO, "BLOCK", 8)
    rng = random.Random(7)
    vocabulary, weights = ["".join(p) for p in itertools.product("abcde", repeat=3)], [1 / (i + 1) for i in range(125)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(300)] + [(1000 + i, "aaa aab aac") for i in range(40)] + [(2000, "")]
    queries = [(1, text(3)), (2, text(200)), (3, "aaa"), (4, "aaa aaa aab"), (5, "zzz"), (6, ""), (7, docs[5][1]), (8, "aaa aab aac")]
    counts: dict = {}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = PO.bm25_indexed(frame(docs, "doc_id long, text string"), frame(queries, "query_id long, query string"), top_k=5, counts=counts).collect()
    got, want = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got), sorted((q, r, i, s) for q, i, s, r in plain_bm25(docs, queries, 5))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert counts["read"] <= counts["all"]


def test_common_words_are_not_read_where_rare_ones_settle_it(spark):
    docs = [(i, ("gold " if i % 20 == 0 else "") + "the " * (1 + i % 3) + f"w{i}") for i in range(600)]
    docs += [(1000 + i, f"x{i} y{i}") for i in range(900)]  # so that `the` raises scores
    queries, counts = [(1, "gold the")], {}
    got = PO.bm25_indexed(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), top_k=5, counts=counts).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(r, i) for _, i, _, r in plain_bm25(docs, queries, 5)]
    assert counts == {"read": 30, "all": 630}


def test_an_index_of_whole_documents_reads_a_part(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    counts: dict = {}
    got = PO.bm25_indexed(docs, queries, counts=counts).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.bm25_many(docs, queries).collect()))
    assert counts["read"] < counts["all"]


def test_a_tiny_collection_whose_words_lower_scores(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert PO.bm25_indexed(docs, queries).collect() == R.bm25_many(docs, queries).collect()
    assert PO.bm25_indexed(docs.limit(0), queries).collect() == [] and PO.bm25_indexed(docs, queries.limit(0)).collect() == []


# ------------------------------------------------------------------------ cells


@pytest.mark.parametrize("cells", [None, 1, 40])
def test_cells_give_what_all_vectors_give(spark, cells, monkeypatch):
    monkeypatch.setattr(CL, "PART", 30)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.1).tolist()) for i in range(400)] + [(1000 + i, centres[0].tolist()) for i in range(100)] + [(5000, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x) for i, x in rows[::37]] + [(9999, [0.0] * 16)], "query_id long, vector array<double>").where("vector is not null")
    counts: dict = {}
    got = CL.cosine_pruned(v, q, top_k=7, cells=cells, counts=counts).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.cosine_topk(v, q, top_k=7).collect()))
    assert counts["all"] == 500 * (len(rows[::37]) + 1) and (counts["met"] < 0.6 * counts["all"] if cells == 40 else counts["met"] <= counts["all"])


def test_no_vectors_and_fewer_than_asked_for(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.vec_id, r.score, r["rank"]) for r in CL.cosine_pruned(v, q).collect()] == [(1, 1.0, 1), (2, 0.5, 2)]
    assert CL.cosine_pruned(v.limit(0), q).collect() == [] and CL.cosine_pruned(v, q.limit(0)).collect() == []


# ---------------------------------------------------------------------- k-means


def test_one_pass_k_means_costs_no_more_than_ten_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v"))
    _, cost = lloyd.kmeans(v.persist(), 10)
    rows = v.select(array_to_vector("v").alias("features"))
    assert cost <= min(KMeans(k=10, seed=42 + i, maxIter=20).fit(rows).summary.trainingCost for i in range(10)) * 1.001


def test_k_means_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(4)
    rows = [((5.0 * c + rng.normal(size=3)).tolist(),) for c in range(4) for _ in range(60)]
    v = spark.createDataFrame(rows, "v array<double>")
    a, b = (lloyd.kmeans(v.repartition(n), 4, tries=3) for n in (1, 7))
    assert np.allclose(np.sort(a[0], 0), np.sort(b[0], 0)) and a[1] == pytest.approx(b[1])
    assert np.sort(np.round(a[0].mean(1) / 5)).tolist() == [0, 1, 2, 3]


def test_k_means_of_few_and_equal_vectors(spark):
    v = spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>")
    centres, cost = lloyd.kmeans(v, 3, tries=2)
    assert cost == 0.0 and np.unique(centres, axis=0).tolist() == [[1.0, 2.0]]
    assert lloyd.kmeans(v.limit(0), 3)[0].size == 0
    rows = spark.createDataFrame([(i, [float(i // 5)], "ab"[i // 5]) for i in range(10)] + [(99, None, "z")], "id int, e array<double>, label string")
    found, named = C.segment(rows, "e", "label", 2, tries=2)
    names = {r.cluster: r.segment for r in named.collect()}
    assert {(r.label, names[r.cluster]) for r in found.collect()} == {("a", "a"), ("b", "b")}


# ---------------------------------------------------------------------- classes


def test_classes_count_the_links_that_listing_finds(spark):
    rows = [(i, i % 3, ["museum", "food", None][i % 7 % 3], float(i % 5)) for i in range(90)]
    p = spark.createDataFrame(rows, "id long, destination_id int, category string, popularity double")
    listed = G.same_category_edges(p)
    assert G.same_category_classes(p).agg(F.sum("links")).first()[0] == listed.count()
    asked = p.where("id % 10 = 0")
    want = {tuple(r) for r in listed.join(asked.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "category").collect()}
    assert {tuple(r) for r in G.same_category_of(asked, p).collect()} == want
    popular = {i: x for i, _, _, x in rows}
    best = {s: {d for _, d in sorted((-popular[d], d) for a, d, _ in want if a == s)[:4]} for s in {a for a, _, _ in want}}
    got: dict = {}
    for r in G.same_category_of(asked, p, 4).collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert got == best


# ---------------------------------------------------------------------- landing


def test_loads_in_any_order_land_the_same(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(30)}", i, rng.choice([200, 200, 301, 404, 410, 429, 500, None]), rng.choice(['{"a": 1}', "{", None])) for i in range(200)]
    frame = lambda r: spark.createDataFrame(r, "key string, at long, status int, body string")
    empty = spark.createDataFrame([], L.LANDED)
    whole = sorted(map(tuple, L.land(empty, frame(rows)).collect()))
    late = L.land(L.land(L.land(empty, frame(rows[120:])), frame(rows[:50])), frame(rows[50:120] + rows[:9]))
    assert sorted(map(tuple, late.collect())) == whole
    want = {}
    for key, at, status, body in rows:
        ok = status is not None and status < 400 and body == '{"a": 1}'
        state = "answered" if ok else "absent" if status in (404, 410) else "failed"
        want[key] = max(want.get(key, (False, -1)), (ok, at, status, body if ok else None, state))
    assert {r[0]: r[1:] for r in whole} == {k: v[1:] for k, v in want.items()}
    keys = spark.createDataFrame([(k,) for k in [*want, "new", "new", None]], "key string")
    assert {r.key for r in L.to_ask(keys, late).collect()} == {k for k, v in want.items() if v[4] == "failed"} | {"new"}


# ------------------------------------------------------------------- generators


def test_generated_rows_do_not_depend_on_partitions(spark):
    cities = spark.createDataFrame([(i, f"c{i}", 40.0 + i, 2.0) for i in range(6)], "destination_id int, city string, lat double, lon double")
    for make in (lambda c: SY.scattered_places(c, 30), lambda c: SY.demand(spark, c)):
        assert sorted(map(tuple, make(cities.repartition(1)).collect())) == sorted(map(tuple, make(cities.repartition(5)).collect()))
    draws = spark.range(20_000).select(SY.uniform(1, F.col("id"), "a").alias("u"), SY.normal(1, F.col("id"), "b").alias("n"), SY.normal(1, F.col("id"), "c").alias("m"))
    r = draws.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev("n"), F.corr("n", "m")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 < r[1] and r[2] <= 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.02 and abs(r[5]) < 0.03


# ----------------------------------------------------------------- stored graph


def test_a_walk_does_not_move_the_edges(spark, tmp_path):
    rng = random.Random(6)
    nodes = spark.createDataFrame([(f"n{i}", "City" if i < 20 else "POI") for i in range(300)], "id string, type string")
    rows = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", rng.choice(["A", "B"])) for _ in range(2000)]
    TB.store_graph(nodes, spark.createDataFrame(rows, "src string, dst string, relation string"), "walked", str(tmp_path / "g"), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = TB.walk(spark, "walked", TB.stored_nodes(spark, "walked", "City"), "A")
        two = TB.walk(spark, "walked", TB.stored_nodes(spark, "walked", "City"), "A", "B")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(one) and "SortMergeJoin" in plan(one)
        assert plan(two).count("Exchange hashpartitioning(at") == 1 == plan(two).count("Exchange hash")  # only the walkers move
        by = {r: [(a, b) for a, b, x in rows if x == r] for r in "AB"}
        starts = {f"n{i}" for i in range(20)}
        assert Counter(map(tuple, one.collect())) == Counter((a, b) for a, b in by["A"] if a in starts)
        assert Counter(map(tuple, two.collect())) == Counter((a, d) for a, b in by["A"] if a in starts for c, d in by["B"] if c == b)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE walked_nodes")
        spark.sql("DROP TABLE walked_edges")
