"""The ten operators against plain versions, and on nulls, empty, long, repeated and clashing input."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.llm import common, decontaminate, language, lines, minhash, packing, quality, queries, substrings, toxicity, urls, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, v string, h string, k0 string, _gone string, _version string, rep string, `text_` string, grp string, _text string, _removed string, removed string, version string, gone string, id string, k1 string, h_ string, g1 string, block string, w string, n_words string, score string"
PROSE = "the of and to in a is that for it was on are as with be by this at from or an not river stone green house walked under small bridge morning people".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) + ("." if rng.random() < 0.08 else "") for _ in range(n))


def make(spark, rows):
    """rows: (doc_id, text[, source]); other columns have names that operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"s{i % 3}", len(r[1] or ""), *(["x"] * 21)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    near = [" ".join(w if i not in (k, 2 * k + 50) else f"new{k}" for i, w in enumerate(words)) for k in (3, 40, 90, 120)]
    out = [(10, base), (11, base), (12, base.upper())] + [(20 + i, t) for i, t in enumerate(near)]
    out += [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "one two three"), (None, base), (10, base)]
    out += [(100 + i, prose(rng, 120)) for i in range(30)]
    out += [(200, prose(rng, 60) + " " + base + " " + prose(rng, 60)), (300, prose(rng, 40_000))]
    return out


def reports(spark, docs):
    bench = spark.createDataFrame([(1, "the river stone")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    return {
        "minhash": lambda: minhash.near_duplicates(docs), "keep one": lambda: minhash.keep_one_of_each(docs), "lines": lambda: lines.line_report(docs), "drop lines": lambda: lines.drop_spread_lines(docs),
        "substrings": lambda: substrings.repeats_report(docs), "quality": lambda: quality.quality_report(docs), "drop poor": lambda: quality.drop_poor(docs), "language": lambda: language.language_report(docs),
        "toxicity": lambda: toxicity.toxicity_report(docs, labels), "packing": lambda: packing.pack_documents(docs, queries.word_tokenizer()), "contamination": lambda: decontaminate.contamination_report(docs, bench), "drop contaminated": lambda: decontaminate.drop_contaminated(docs, bench),
    }


@pytest.mark.parametrize("name", ["minhash", "keep one", "lines", "drop lines", "substrings", "quality", "drop poor", "language", "toxicity", "packing", "contamination", "drop contaminated"])
def test_empty_table(spark, name):
    df = reports(spark, spark.createDataFrame([], DOCS))[name]()
    assert df.columns and df.collect() == []


@pytest.mark.parametrize("name", ["minhash", "lines", "substrings", "quality", "language", "toxicity", "contamination"])
def test_a_row_for_each_row(spark, rows, name):
    got = collections.Counter(r.doc_id for r in reports(spark, make(spark, rows))[name]().collect())
    assert got == collections.Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", ["keep one", "drop lines", "drop poor", "drop contaminated"])
def test_filters_keep_the_columns(spark, rows, name):
    docs = make(spark, rows)
    out = reports(spark, docs)[name]()
    assert out.columns == docs.columns and out.count() <= len(rows)


@pytest.mark.parametrize("name", ["minhash", "substrings", "quality", "language", "packing", "contamination", "drop lines"])
def test_a_text_of_megabytes(spark, name):
    """One text of 5 MB beside null, empty and equal ones is a row like any other."""
    long = prose(random.Random(12), 1_000_000)
    docs = make(spark, [(1, long), (2, None), (3, ""), (4, "a b"), (4, "a b")])
    out = reports(spark, docs)[name]().collect()
    assert {r.doc_id for r in out} >= {1, 2, 3, 4}
    if name == "packing":
        assert sum(r.length for r in out if r.doc_id == 1) == next(r.doc_tokens for r in out if r.doc_id == 1) > 1_000_000
    if name == "quality":
        assert next(r.n_words for r in out if r.doc_id == 1) == len(long.split())


def test_samples_have_hard_bounds(spark):
    """Equal texts of many ids, of one id and of none: never more rows than stated, whatever the hash."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 10_000, F.col("id")).when(F.col("id") < 20_000, F.lit(7)).alias("id"), F.lit("same").alias("text"), F.when(F.col("id") % 100 == 0, "a").otherwise("b").alias("lang"))
    got = {r["lang"]: r["count"] for r in common.fixed_sample(rows, ["id", "text"], {"a": (50, 300), "b": (200, 29_700)}, "lang", 1).groupBy("lang").count().collect()}
    assert got == {"a": 50, "b": 200} or all(got.get(k, 0) <= v for k, v in (("a", 50), ("b", 200)))
    alone = spark.range(30_000).select(F.col("id"), F.lit("same").alias("text"), F.lit("a").alias("lang"))
    assert common.fixed_sample(alone, ["id", "text"], {"a": (500, 30_000)}, "lang", 1).count() == 500


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "777")
    lines.line_report(make(spark, [(1, "a")])).collect()
    assert spark.conf.get(key) == "777"
    spark.conf.unset(key)


def test_hot_keys_are_joined_like_others(spark):
    left = spark.range(20_000).select((F.col("id") % 2 * F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("k % 3 = 0")
    for how in ("inner", "left"):
        got = common.join_hot(left, right, ["k"], "n", 20_000, how)
        want = left.join(right.drop("n"), "k", how)
        assert got.count() == want.count() and got.select("k", "id", "first").exceptAll(want.select("k", "id", "first")).count() == 0


# ------------------------------------------------------------------- minhash


def test_minhash_equals_all_pairs(spark, rows):
    plain = [r for r in rows if r[0] is not None][:-3] + [rows[-2], rows[-1]]
    seen = {}
    for k, t in plain:
        seen.setdefault(k, t)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(spark, list(seen.items())), shingle=4).collect()}
    assert got == brute.components(list(seen.items()), 4)


def test_minhash_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=4).collect()}
    assert got == brute.components([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_chain_of_links_is_one_component(spark):
    """Each text is linked with the next but not with the one after: no centre reaches all."""
    words = [f"w{i}" for i in range(400)]
    texts = [(i + 1, " ".join(words[10 * i : 10 * i + 120])) for i in range(12)]
    want = brute.components(texts, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(spark, texts), shingle=4).collect()}
    assert got == want and len({c for _, c in want.values()}) == 1


def test_block_links_join_components_once():
    rng = np.random.default_rng(1)
    common = np.sort(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = [np.sort(np.append(common, rng.integers(0, 2**63, 3).astype(np.uint64))) for _ in range(40)]
    found = minhash.block_links(list(range(40)), list(range(40)), [0] * 40, sets, np.full(40, 3), np.zeros((40, 128), np.uint8), 80, 81, True)
    assert len(found) == 39


# --------------------------------------------------------------------- lines


def test_lines_follow_sites(spark):
    spread, near = "Subscribe now", "Follow us"
    rows = [(i, f"own {i}\n{spread}\n{near if i < 9 else 'x'}\n\nend {i}", f"s{i}") for i in range(14)] + [(50, f" {spread} ", "s0"), (51, None, "s1"), (52, spread, None)]
    got = {r.doc_id: (r.n_removed, r.kept_lines) for r in lines.line_report(make(spark, rows)).collect()}
    assert got[0] == (0, 5) and all(got[i] == (1, 4) for i in range(1, 9)) and got[50] == (1, 1) and got[51] == (0, 0) and got[52] == (1, 1)
    kept = {r.doc_id: r.text for r in lines.drop_spread_lines(make(spark, rows)).collect()}
    assert 50 not in kept and kept[0] == rows[0][1] and spread not in kept[3] and near in kept[3]


@pytest.mark.parametrize("most", [10, 12, 3000])
def test_spread_lines_equal_exact_counts(spark, most):
    """Thresholds in and beyond the range in which sketches are exact; one line makes up most of all occurrences."""
    rng = random.Random(most)
    of = {f"line {k}": int(most * rng.choice([0.5, 0.8, 0.95, 0.999, 1, 1.001, 1.05, 1.5])) for k in range(24)} | {"hot": most * 3}
    rows = [(i, "\n".join(x for x, n in of.items() if i < n), f"s{i}") for i in range(most * 3)] + [(10**6 + i, "hot", "s0") for i in range(most * 3)]
    docs = make(spark, rows)
    got, total = lines.spread_lines(docs, least_sites=most)
    hashes = {(r.h, r.g): r.line for r in lines._lines(docs, "doc_id", "text", "source").join(docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")), ["id", "pos"]).select("h", "g", "line").distinct().collect()}
    assert {hashes[r.h, r.g]: r.k for r in got.collect()} == {x: n * (2 if x == "hot" else 1) for x, n in of.items() if n >= most}
    assert total == sum(n * (2 if x == "hot" else 1) for x, n in of.items() if n * (2 if x == "hot" else 1) >= most)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    rows = [(1, "a b c d e f"), (1, "q w r t y u i"), (2, a), (2, a), (2, b), (3, a + " more"), (4, c), (5, c), (6, d), (6, None), (6, ""), (7, d), (None, a), (None, None)]
    docs = make(spark, rows)
    got = minhash.keep_one_of_each(docs)
    assert got.columns == docs.columns
    # 2's a comes after 3, 6's d after 7.
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f"), (1, "q w r t y u i"), (2, b), (3, a + " more"), (4, c), (6, None), (6, ""), (7, d), (None, a), (None, None)], key=str)


def test_one_id_for_all_texts_loses_none(spark):
    docs = spark.range(3000).select(F.lit(9).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(k))) for k in range(8))).alias("text"))
    assert minhash.keep_one_of_each(docs.union(docs)).distinct().count() == 3000 == minhash.keep_one_of_each(docs.union(docs)).count()


# ---------------------------------------------------------------------- urls


def test_urls(spark):
    cases = {
        "https://a.b.NET/x?y": ("a.b.net", "/x", "net/", "block"), "http://m.example.net/en/1": ("m.example.net", "/en/1", "example.net/en/", "allow"), "http://example.com/de/#t": ("example.com", "/de/", "example.com/de/", "block"),
        "http://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"), "http://x.net": ("x.net", "", None, "allow"), "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "ftp://h.org?a/b": ("h.org", "", None, "allow"),
        None: ("", "", None, "allow"), "mailto:x": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://freeadultcams.com/": ("freeadultcams.com", "/", None, "block"), "http://dailynews.org/sport/football": ("dailynews.org", "/sport/football", None, "allow"),
        "http://ads-track.example.com/en/1": ("ads-track.example.com", "/en/1", None, "block"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge_urls(pages.limit(0)).count() == 0
    twice = urls.judge_urls(pages.union(pages).withColumn("html", F.lit(None).cast("string")))
    assert twice.count() == 2 * len(cases) and twice.distinct().count() == len(cases)


def test_urls_learn_from_the_table(spark):
    """Words of the texts split hosts, urls that rules decide teach the classifier, and rules' own words don't count."""
    rows = [(i, f"http://blutomi{i % 3}.example.net/x{i}", "<p>blu tomi gre sana</p>" * 5) for i in range(60)] + [(100 + i, f"http://gresana.example.org/fr/{i}", None) for i in range(60)]
    rows += [(200, "http://blutomi.com/", ""), (201, "http://gresana.net.com/", ""), (202, "http://" + "blutomi" * 3000 + ".com/", "")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[200].words == ["blu", "tomi", "com"] and got[200].verdict == "block" and got[201].verdict == "allow" and got[202].words.count("tomi") == 3000
    assert got[0].rule == "net/" and got[100].rule == "org/fr/"
    # A model per page, from all sites but its own.
    words, sites = set(), set()
    for r in got.values():
        if r.rule:
            words |= {(urls.site_of(r.host), w, r.verdict) for w in r.words if w not in {"net", "example", "org", "fr", "com", "de", "en"} and len(w) > 1}
            sites.add((urls.site_of(r.host), r.verdict))
    for r in got.values():
        b, a, vocabulary = [collections.Counter(w for s, w, v in words if v == x and s != urls.site_of(r.host)) for x in ("block", "allow")] + [{w for s, w, _ in words if s != urls.site_of(r.host)}]
        model = urls.UrlModel({}, {w: (b[w], a[w]) for w in vocabulary}, tuple(sum(v == x and s != urls.site_of(r.host) for s, v in sites) for x in ("block", "allow")))
        assert r.score == pytest.approx(urls.probability(model.prior + sum(model.weight.get(w, 0) for w in r.words)))


def test_a_rule_for_a_path_says_nothing_of_its_site(spark):
    """Pages of example.com that no rule decides aren't blocked for the words that they share with example.com/de/."""
    rows = [(i, f"http://m.tionsh.example.com/{'de' if i % 2 else 'en'}/{i}.html", "") for i in range(200)] + [(1000 + i, f"http://www.other{i % 9}.example.net/es/{i}.html", "") for i in range(100)]
    rows += [(2000 + i, f"http://blog.third.example.org/{'fr' if i % 2 else 'en'}/{i}.html", "") for i in range(100)] + [(3000, "http://ads-track.example.com/en/1.html", "")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    verdicts = {(r.host, r.rule is None, r.verdict) for r in got.collect()}
    assert ("m.tionsh.example.com", True, "allow") in verdicts and ("m.tionsh.example.com", True, "block") not in verdicts
    assert ("m.tionsh.example.com", False, "block") in verdicts and ("ads-track.example.com", True, "block") in verdicts and ("blog.third.example.org", True, "allow") in verdicts
    assert {r.site: r.pages for r in urls.held_out_accuracy(got).collect()} == {"example.com": 100, "example.net": 100, "example.org": 50}


def test_segmentation_is_the_likeliest():
    """Against all splits of a name, over a lexicon and with letters of no word."""
    import math

    m = urls.UrlModel({"ab": 9, "abc": 3, "c": 5, "bc": 4, "cab": 2, "b": 1}, block=(), allow=())

    def cost(parts):
        return sum(m.logp[p] if p in m.logp else m.unknown - len(p) * math.log(10) for p in parts)

    def splits(name):
        return [[]] if not name else [[name[:i], *rest] for i in range(1, len(name) + 1) for rest in splits(name[i:])]

    for name in ("abc", "abcab", "cabbc", "abxcab", "zzabz", "bcbcabca", "xyz"):
        assert cost(m.segment(name)) == pytest.approx(max(map(cost, splits(name)))) and "".join(m.segment(name)) == name
    m = urls.UrlModel()
    assert m.segment("dailynewsblog") == ["daily", "news", "blog"] and m.segment("") == []
    assert "".join(m.segment("xqzadultzzz")) == "xqzadultzzz" and "adult" in m.segment("xqzadultzzz")


# ---------------------------------------------------------------- substrings


def test_substrings_equal_brute_force(spark):
    rng = random.Random(3)
    rnd = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    a, b, c = rnd(700), rnd(399), rnd(401)
    rows = [(1, rnd(500) + a + rnd(300)), (2, a[50:600] + rnd(700)), (3, b + rnd(500)), (4, rnd(20) + b), (5, c), (6, rnd(900) + c + "x"), (7, None), (8, ""), (9, "ab " * 500), (10, rnd(1000)), (10, "zz"), (11, a), (12, a), (12, a), (13, rnd(450) + a[:420] + rnd(30) + a[:410]), (14, "ab " * 100), (None, a + rnd(10)), (16, "x" * 1000)]
    key = lambda r: tuple(map(str, r))
    want = sorted(brute.remove_repeats(rows, 400), key=key)
    for most in (3000, 1):
        got = [tuple(r) for r in substrings.repeats_report(make(spark, rows), most=most).collect()]
        assert sorted((r[:5] for r in got), key=key) == want
        assert all(r[5] == r[1] - r[2] and r[6] == (r[2] > 0) for r in got)


def test_substrings_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted(tuple(r)[:5] for r in substrings.repeats_report(docs).collect())
    assert got == sorted(brute.remove_repeats([(r.doc_id, r.text) for r in docs.collect()], 400))


def test_anchors_cover_each_window_once_over_chunks(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 700)
    text = bytes(np.random.default_rng(4).integers(97, 103, 5000, dtype=np.uint8))
    _, at, lo, hi = substrings.anchors(text)
    starts = [s for a, b in zip(lo, hi, strict=True) for s in range(a, b + 1)]
    assert starts == list(range(len(text) - 399)) and ((at >= lo) | (at >= 0)).all() and (at >= hi).all() and (at + 32 <= lo + 400).all()


@pytest.mark.parametrize(("letters", "size"), [(100, 1 << 17), (100, 300), (98, 500), (1, 200)])
def test_refine_finds_equal_windows(monkeypatch, letters, size):
    monkeypatch.setattr(substrings, "SLICE", size)
    rng = np.random.default_rng(6)
    contexts = [bytes(rng.integers(97, max(98, letters), 450, dtype=np.uint8)) for _ in range(6)]
    contexts += [contexts[0][:420] + b"zzz", contexts[1], b"q" * 405, contexts[2][5:405], contexts[3][:399] + b"#" + contexts[3][400:], b"ab" * 250, contexts[4][3:] + contexts[4]]
    starts = [len(c) - 399 for c in contexts]
    seen = collections.Counter(c[i : i + 400] for c, n in zip(contexts, starts, strict=True) for i in range(n))
    got = substrings.refine(contexts, starts)
    assert [g.tolist() for g in got] == [[i for i in range(n) if seen[c[i : i + 400]] > 1] for c, n in zip(contexts, starts, strict=True)]


def test_parts_of_classes_meet_if_windows_are_equal():
    """Equal windows with the anchor at one place come to one group; each window lies in one part."""
    rng = np.random.default_rng(8)
    core = bytes(rng.integers(97, 103, 700, dtype=np.uint8))
    for stretch in (48, 6, 1):
        groups = {}
        for k, (a, b) in enumerate(((0, 650), (100, 700), (20, 560))):
            data, place = core[a:b], 340 - a
            n = min(place, len(data) - 400) + 1
            seen = []
            for first, group, p, m, part in substrings.split_class((1, 0), place, n, data, 400, stretch):
                assert p == place - first and part == data[first : first + m + 399]
                seen += range(first, first + m)
                for j in range(m):
                    groups.setdefault((p - j, part[j : j + 400]), set()).add(group)
            assert sorted(seen) == list(range(n)) and k < 3
        assert all(len(g) == 1 for g in groups.values())


# ------------------------------------------------------------------- quality


def test_quality_counts(spark):
    import re

    rng = random.Random(9)
    texts = [(1, prose(rng, 200)), (2, None), (3, ""), (4, "a b c a b c é é\n\nx\nx\n \n x"), (5, "w " * 80), (6, "#*$ <a> |b & %"), (7, "one two\x0bthree\x0cfour"), (8, prose(rng, 30))]
    got = {r.doc_id: r for r in quality.quality_report(make(spark, texts)).collect()}
    for k, t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        with_word = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(with_word) - len(set(with_word)), len(repeated), failed)
        assert not (r.base_failed and r.kept)


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(8)
    good = [(i, prose(rng, 150)) for i in range(30)]
    bad = [(100, " ".join(w + "%%%" for w in prose(rng, 150).split())), (101, " | ".join(f"{w}{i}" for i, w in enumerate(prose(rng, 150).split())))]
    kept = {r.doc_id for r in quality.drop_poor(make(spark, good + bad)).select("doc_id").collect()}
    assert kept == set(range(30))


def test_jensen_shannon():
    p, q = np.array([1.0, 0, 0]), np.array([0, 0.5, 0.5])
    assert quality.jensen_shannon(p, q) == pytest.approx(1) and quality.jensen_shannon(p, p) == 0


def test_nearest_equals_one_row_at_a_time():
    import math

    rng = np.random.default_rng(3)
    chars, words, n = rng.integers(0, 60, (50, 10)), rng.integers(0, 9, (50, 12)), rng.integers(0, 120, 50)
    chars[0], words[0] = 0, 0
    known = [(rng.dirichlet(np.ones(10)), rng.dirichlet(np.ones(12))) for _ in range(3)]
    known.append(known[0])

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    got = quality.nearest(n, chars, words, known, 50, 200)
    for i in range(50):
        pairs = [(distance(chars[i] / chars[i].sum(), a) if chars[i].sum() >= 200 else None, distance(words[i] / max(1, words[i].sum()), b) if n[i] >= 50 else None) for a, b in known]
        want = min(pairs, key=lambda p: (p[0] or 0) + (p[1] or 0))
        assert all((math.isnan(g[i]) if x is None else g[i] == pytest.approx(x, abs=1e-9)) for g, x in zip(got, want, strict=True))


# ------------------------------------------------------- language and toxicity


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_without_letters(spark):
    rows = [(i, "the house is here and there") for i in range(20)] + [(50, None), (51, ""), (52, "123 !?"), (53, "é")]
    got = {r.doc_id: r.lang_pred for r in language.language_report(make(spark, rows)).collect()}
    assert got[50] == got[51] == got[52] == "und" and got[53] == got[0] == "en"
    none = language.language_report(make(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_penalty_makes_zeros():
    m = language.Ftrl(50, 2, l1=0.5)
    for i in range(40):
        m.learn(np.array([i % 2, 10 + i % 30]), np.array([1.0, 0.1]), i % 2)
    w = m.weights()
    assert (w[10:] == 0).all() and w[0, 0] > 0 > w[0, 1]


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 10, (400, 3))
    labels = np.array([rng.choice(3, p=language.softmax(z / 4)) for z in logits])
    assert 2.5 < language.fit_temperature(logits, labels) < 6


def test_toxicity_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80) + (" you stupid idiot " + prose(rng, 20) if i % 8 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(make(spark, rows), labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and all(got[i].predicted == int(i % 8 == 0) for i in held)
    assert got[900].score == got[901].score and got[900].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())


def test_toxic_features_equal_counts_by_hand(spark):
    """Counts and choice in Spark are those of a plain loop; of equal gains the smaller feature comes first."""
    rng = random.Random(9)
    texts = [(prose(rng, 30) + (" vile awful" if k == 0 else ""), k) for k in (0, 1) for _ in range(60)] + [(None, 1), ("", 0)]
    sample = spark.createDataFrame(texts, "text string, kind int")
    want = {f: [sum(f in toxicity.features_of(t or "") for t, k in texts if k == kind) for kind in (0, 1)] for f in {f for t, _ in texts for f in toxicity.features_of(t or "")}}
    counts = toxicity.count_features(sample)
    assert {r.feature: [r.a, r.b] for r in counts.collect()} == want
    p, u, prior = 61, 61, 0.3
    gain = {f: round(a / p * np.log((a + 0.5) / p / ((b + 0.5) / u)), 9) for f, (a, b) in want.items() if a >= 3 and prior * a / p > 0.5 * (b + 1) / u}
    got = [(r.feature, r.gain) for r in toxicity.select(counts, p, u, prior, most=6).collect()]
    assert [f for f, _ in got] == sorted(gain, key=lambda f: (-gain[f], f))[:6] and {"vile", "awful"} <= {f for f, _ in got}
    names = [f for f, _ in got]
    assert sorted((r.kind, r["at"]) for r in toxicity.marked(sample, names).collect()) == sorted((k, [i for i, f in enumerate(names) if f in toxicity.features_of(t or "")]) for t, k in texts)


def test_labels_of_held_out_rows_are_not_used(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + (" stupid idiot" if i % 6 == 0 else "")) for i in range(300)]
    marks = [(i, 1, int(i % 6 == 0)) for i in range(300)]
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    run = lambda m: sorted((r.doc_id, r.score) for r in toxicity.toxicity_report(make(spark, rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect())
    assert run(marks) == run(other)


# ---------------------------------------------------------------------- warc


def test_warc_round_trip(spark):
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefghij\r\né") for _ in range(200_000))
    rows = [(5, "http://a/1", "<p>x</p>"), (3, "http://a/2", "<p>x</p>"), (7, None, big), (8, "http://b/\nX: y", big), (9, "u", None), (2, "u", ""), (None, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (11, "u", "0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = collections.Counter(tuple(r) for r in warc.round_trip(pages, segment_bytes=1000).collect())
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    want = collections.Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        same = first[h or ""] == k
        want[(k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else first[h or ""])] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=3).collect()} == {"response"}


def test_segments_and_framing_are_verified():
    assert warc.decode_chunked(warc.encode_chunked(b"x" * 20_000, 7)) == b"x" * 20_000 and warc.decode_chunked(b"3;a=b\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n"):
        with pytest.raises(warc.BadArchive):
            warc.decode_chunked(bad)
    assert warc.join_segments([(1, None, b"ab"), (2, 3, b"c")]) == b"abc"
    for bad in ([(1, None, b"ab"), (3, 3, b"c")], [(1, None, b"ab"), (2, 4, b"c")], [(1, None, b"a"), (1, None, b"a"), (2, 3, b"c")]):
        with pytest.raises(warc.BadArchive):
            warc.join_segments(bad)


# ------------------------------------------------------------------- packing


def test_packing_keeps_every_id(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_tokenizer())
    unique = list({k: (k, t) for k, t in rows if k is not None}.values())
    got = packing.pack_documents(make(spark, unique), queries.word_tokenizer()).toPandas()
    for k, t in unique:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = got[got.doc_id == k].sort_values("start")
        assert (own.doc_tokens == len(ids) // 4).all() and own.length.sum() == len(ids) // 4 and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(own.start, own.length, strict=True)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_packing_of_repeated_rows_null_ids_and_ties(spark):
    """Rows without id stand beside ids that no double can hold; repeated rows and equal lengths are packed each."""
    big = 2**53 + 1
    same = "the river stone " * 40
    rows = [(big, same), (big, same), (big + 2, same), (None, same), (None, same), (None, None), (7, ""), (7, "")]
    for groups in (100, 2):
        pieces = packing.cut_pieces(make(spark, rows), queries.word_tokenizer())
        got = packing.pack(pieces, group_pieces=groups).toArrow().to_pylist()
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
        lengths = {r["doc_id"]: r["length"] for r in got if r["doc_id"] is not None}
        assert lengths[big] == lengths[big + 2] > 100 and lengths[7] == 1
        by_sequence = collections.defaultdict(list)
        for r in got:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in by_sequence.values():
            s.sort()
            assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        if groups == 100:
            assert len(by_sequence) == 1


def test_equal_rows_are_dealt_over_all_groups(spark):
    docs = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    pieces = common.materialise(packing.cut_pieces(docs, queries.word_tokenizer()), "pieces")
    sizes = [r["count"] for r in packing.pack(pieces, group_pieces=1000).groupBy((F.col("sequence_id") / 2**32).cast("int").alias("g")).count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 20_000 and max(sizes) < 1300


def test_encoder_equals_the_tokenizer():
    e = packing.ChunkEncoder(queries.word_tokenizer())
    for t in ["", "  ", "don't WE'LL 'S it''s A1b2 x́e İstanbul ΑΣΣ a\x1cb ²³ ½ <|endoftext|>x 日本語 ﬁ 🙂👍 \x85q r", "Ünïcode, ÅǺ ſs ŉ ß ẞ", "Word, word. (word) WORD!!! $$$ 12,5"]:
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_first_fit_decreasing_equals_a_scan():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    load = []
    for n, b, o in zip(sizes, bins, offsets, strict=True):
        at = next((i for i, x in enumerate(load) if x + n <= 100), len(load))
        if at == len(load):
            load.append(0)
        assert (b, o) == (at, load[at])
        load[at] += n


# ------------------------------------------------------------ decontamination


def test_contamination_equals_brute_force(spark, rows):
    items = [(1, rows[0][1][200:700]), (2, "one two three"), (3, None), (4, ""), (5, "ONE"), (6, prose(random.Random(77), 40)), (6, rows[-1][1][:400]), (12, "the")]
    docs = [r for r in rows if r[0] is not None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    want = sorted(brute.contamination(docs, items), key=key)
    for block in (200_000, 7):
        got = sorted((tuple(r) for r in decontaminate.contamination_report(make(spark, docs), bench, block_windows=block).collect()), key=key)
        assert got == want


def test_empty_benchmark(spark, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(make(spark, rows), bench).count() == len(rows)
