"""Fill-in-middle, hard negatives and chat formatting against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.llm import chat, middle, negatives

CLASH = "key string, at string, rows string, head string, `pos` string, block string, chunk string, anchor string, p string, r string, ids string, turns string, segments string, fsm string, t string, read string"
CLASHED = ["x"] * 16

# ---------------------------------------------------------------- fill-in-middle


def plain_middle(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    odd = ["", None, "a", "<", "<P", "<P>", "x<S>y", "a<M", "ab<", "P>", "<<<<", "é́ß日本🙂" * 40, "\x00\n\r\t ", "tie"]
    rows = [(i, odd[i % len(odd)]) for i in range(60)]
    rows += [(100 + i, "".join(rng.choice("<>PSM ab🙂\n") for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(7, "tie")] * 5 + [(7, "other text of the same id"), (None, "no id"), (None, None), (-3, "negative"), (2**62, "great")]
    return [*rows, (500, "".join(rng.choice("abc <>PS") for _ in range(400_000))), (501, "z" * 3_000_000)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *CLASHED) for i, t in rows], f"doc_id long, text string, {CLASH}").repartition(parts)


@pytest.mark.parametrize("chunk", [7, middle.CHUNK])
def test_middle_is_as_plain_python_has_it(spark, docs, chunk):
    small = [r for r in docs if chunk > 100 or len(r[1] or "") < 1000]
    got = sorted(map(tuple, middle.middle_report(frame(spark, small), chunk=chunk).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(((*r[:5], sha(r[5]), sha(t or "")) for (i, t) in small for r in [plain_middle(i, t)]), key=str)


def test_all_forms_occur(docs):
    assert {plain_middle(*r)[2] for r in docs} == {"plain", "psm", "spm"}


def test_middle_texts_join_to_the_output(spark, docs):
    rows = middle.middle_texts(frame(spark, docs), chunk=1000).collect()
    parts: dict = {}
    for r in sorted(rows, key=lambda r: r.part):
        if r.doc_id is not None and r.doc_id != 7:
            parts[r.doc_id] = parts.get(r.doc_id, "") + r.text
    assert parts == {i: o[5] for i, t in docs if i is not None and i != 7 for o in [plain_middle(i, t)] if o[5]}
    assert max(len(r.text) for r in rows) <= 1003


def test_a_reader_finds_sentinels_across_pieces():
    for cut in range(1, 14):
        out, reader = {0: "", 1: "", 2: ""}, middle.Reader("psm")
        data = "<P>ab<<S>c<P<M>d<S"
        for piece in (data[i : i + cut] for i in range(0, len(data), cut)):
            for section, text in reader.feed(piece):
                out[section] += text
        for section, text in reader.close():
            out[section] += text
        assert out == {0: "ab<", 2: "c<P", 1: "d<S"}


def test_middle_of_nothing_and_of_many_equal_rows(spark):
    assert middle.middle_report(frame(spark, [])).collect() == []
    many = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = middle.middle_report(many).groupBy("doc_id", "output_sha256").count().collect()
    assert [(r.doc_id, r["count"]) for r in got] == [(5, 20_000)]
    assert middle.output_pieces(many).count() <= 4 * many.rdd.getNumPartitions() * 2  # a task sends a repeated row's pieces once


def test_restoring_shuffles_once(spark):
    rdd = middle.output_pieces(frame(spark, [(1, "a b c")]))
    again = rdd.mapPartitions(middle.assemble, preservesPartitioning=True).repartitionAndSortWithinPartitions(rdd.getNumPartitions(), middle.place)
    assert again._jrdd.rdd().toDebugString().count("ShuffledRDD") == 1


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, k=5, every=100):
    rows = sorted({(i, y, tuple(math.floor(256 * float(x)) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in rows:
        if i % every:
            continue
        ranked = sorted((-dot(v, w), j, z) for j, z, w in rows if j != i)
        for s, j, _ in [r for r in ranked if r[2] == y][:k]:
            fits = [(n, m) for n, m, z in ranked if z != y and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(i, j, r, m, -s, -n) for r, (n, m) in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, *CLASHED) for i, y, v in rows], f"vec_id long, label int, embedding array<float>, {CLASH}").repartition(3)


def test_negatives_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 12))
    rows = [(i, int(c), (centres[c if rng.random() < 0.8 else (c + 1) % 4] + rng.normal(size=12) * 0.5).astype(np.float32).tolist()) for i, c in enumerate(rng.integers(0, 4, 900))]
    rows += [(1000 + i, i % 2, [0.5, 0.25, -0.5] + [0.0] * 9) for i in range(300)]  # one vector, two labels: ties throughout
    rows += [(2000 + i, 3, [0.1 * i]) for i in range(5)] + [(2100, 1, [0.0] * 12), (2200, 9, [1.0] * 12)]
    rows += [(None, 1, [1.0] * 12), (3000, None, [1.0] * 12), (3001, 1, None), (3002, 1, [1.0, None]), (3003, 1, [math.nan] * 12), (3004, 2, [math.inf] + [0.0] * 11), (3005, 2, [])]
    rows += [rows[100]] * 3 + [(200, 2, rows[7][2]), (-100, 0, rows[5][2])]
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows), block=150, anchors_at_once=5).collect()))
    assert got == plain_negatives(rows) and len(got) > 100


def test_no_vectors_no_negatives(spark):
    assert negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(100, 1, [1.0])])).collect() == []


def test_one_vector_in_all_rows_goes_on_as_few(spark):
    same = spark.range(30_000).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    classes = negatives.classes_of(negatives.integer_vectors(same, "vec_id", "embedding", "label")).collect()
    assert sorted(c.ids for c in classes) == [[0, 2, 4, 6, 8, 10], [1, 3, 5, 7, 9, 11]]


def test_a_search_ends_before_the_lists_do():
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(-100, 100, (2000, 2)), axis=0)
    lists, best = negatives.Lists(v, [[i] for i in range(2000)]), negatives.Best(None, None, 5)
    depth = negatives.threshold_search(np.array([3, 1]), lists, [best])
    scores = v @ np.array([3, 1])
    assert best.ids.tolist() == np.lexsort((np.arange(2000), -scores))[:5].tolist() and depth < 200


# ---------------------------------------------------------------- chat formatting

CONTROLS = chat.TEMPLATE.controls()


def plain_escape(text):
    out = []
    for i, c in enumerate(text):
        out.append(c)
        at = i + 1
        while c in "[<" and text.startswith("\\", at):
            at += 1
        if c in "[<" and any(text.startswith(s[1:], at) for s in CONTROLS):
            out.append("\\")
    return "".join(out)


def talk(spark, rows):
    return spark.createDataFrame([(*r, *CLASHED) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    bits = [*CONTROLS, "\\", "\\\\", "<", "[", "s>", "INST]", " ", "é🙂", "\n", "$1", "%"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(14)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE] ", "", None, "User"]), text()) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100, t, r, "ok") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(101, 1, "user", "a"), (101, 1, "user", "a"), (101, 1, "assistant", "b"), (101, None, "system", "first"), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    return [*rows, (102, 0, "user", "[INST]" * 100_000), (102, 1, "assistant", "\\" * 200_000 + "</s>"), *[(103, t, "assistant", f"t{t}") for t in range(5000)]]


def test_chats_read_back_as_they_were(spark, talks):
    got = {r.conv_id: r for r in chat.chat_report(talk(spark, talks)).collect()}
    convs: dict = {}
    for c, t, role, text in talks:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    follows = chat.TEMPLATE.follows
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(t for *_, role, t in turns if role == "assistant")
        form = lambda role: chat.TEMPLATE.roles.get(role)
        length = 3 + sum(len(form(r).before + form(r).after) if form(r) else len("[ROLE]  [/ROLE]  [/TURN]" + plain_escape(r)) for *_, r, _ in turns) + sum(len(plain_escape(t)) for *_, t in turns)
        bad = [i for i, (before, now) in enumerate(zip(["start", *(r for *_, r, _ in turns)], [r for *_, r, _ in turns], strict=False), 1) if now not in follows.get(before, ())]
        want = (c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learnt), sha(learnt), length, not bad, len(bad), bad[0] if bad else None)
        assert tuple(got[c]) == want


def test_no_control_string_in_any_escaped_text(spark, talks):
    rows = spark.createDataFrame([(t,) for *_, t in talks if t and len(t) < 1000], "text string")
    e = chat.TEMPLATE.escape(F.col("text"))
    for r in rows.select("text", e.alias("e"), chat.TEMPLATE.unescape(e).alias("u")).collect():
        assert r.u == r.text and r.e == plain_escape(r.text) and not any(s in r.e for s in CONTROLS)


def test_segments_carry_the_loss(spark, talks):
    rows = chat.format_chat(talk(spark, talks)).collect()
    assert all("".join(s.text for s in r.segments) == r.formatted for r in rows)
    one = next(r for r in rows if r.conv_id == 100)
    assert one.valid and one.complete and one.formatted == "<s>[SYS] ok [/SYS][INST] ok [/INST][OUT] ok </s>[INST] ok [/INST][OUT] ok </s>"
    assert [s.text for s in one.segments if s.loss] == ["ok", "ok"]


def test_no_python_in_the_plan(spark, talks):
    plan = chat.chat_report(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_no_turns_no_chats(spark):
    assert chat.chat_report(talk(spark, [])).collect() == []


@pytest.mark.parametrize("change", [{"begin": "<<s>"}, {"begin": "[INST]x"}, {"begin": "<\\"}, {"roles": {"user": chat.Turn("[A]", "[/A]"), "bot": chat.Turn("[A]", "[/B]")}}])
def test_a_template_that_could_not_be_read_is_refused(change):
    with pytest.raises(ValueError):
        chat.Template(**change)


def test_another_template(spark):
    chatml = chat.Template(begin="<|begin|>", roles={"user": chat.Turn("<|user|>\n", "<|end|>\n"), "bot": chat.Turn("<|bot|>\n", "<|end|>\n", True)}, other=chat.Turn("<|role|>", "<|end|>\n"), named="<|is|>", follows={"start": ("user",), "user": ("bot",), "bot": ("user",)})
    rows = [(1, 0, "user", "<|end|>hi"), (1, 1, "bot", "<|bot|>\n"), (1, 2, "tool", "x")]
    r = chat.format_chat(talk(spark, rows), chatml).withColumn("back", chat.read_chat(F.col("formatted"), chatml)).first()
    assert [(b.role, b.text) for b in r.back] == [(role, t) for *_, role, t in rows] and (r.valid, r.n_errors, r.first_error) == (False, 1, 3)
