"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other text is unlabelled. The
risk of a classifier f is estimated as

    prior * R_pos(f = 1)  +  max(0, R_unl(f = 0) - prior * R_pos(f = 0)),

where the bracket, the risk on the negatives among the unlabelled, may not fall
below zero; when it does, the step goes the other way, so that a flexible model
doesn't learn the positives by heart. The class prior comes from the labels.

Features are words and word beginnings (present or not, so that a long text's
length says nothing), of which those kept stand far oftener in the positives.
The classifier is linear, with weights in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fixed_sample, materialise
from .language import held_out

#: The classifier is fitted on at most this many positive and unlabelled documents.
POSITIVES, UNLABELLED = 1500, 4000
#: Most features, and least share of the positives that has one.
FEATURES, LEAST_SHARE = 300, 0.02
WORD = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (3, 4, 5, 6)


def features_of(text: str) -> set[str]:
    """Words of the whole text, and the beginnings of words (marked by ^)."""
    words = set(WORD(text.lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in BEGINNINGS))


def count_features(sample: DataFrame) -> DataFrame:
    """feature, a, b: in how many of the positives (kind 0) and of the unlabelled texts (kind 1) each feature stands."""

    def count(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features_of(text or ""):
                    counts.setdefault(f, [0, 0])[kind] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["feature", "a", "b"])

    return sample.select("text", "kind").mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def select(counts: DataFrame, p: int, u: int, prior: float, most: int = FEATURES, least: float = LEAST_SHARE) -> DataFrame:
    """feature, gain: those in at least a share of the p positives, with which a text is likelier toxic than not, by how much likelier they are there than among the u unlabelled."""
    a, b = F.col("a"), F.col("b")
    gain = a / F.lit(p) * F.log((a + 0.5) / F.lit(p) / ((b + 0.5) / F.lit(u)))
    frequent = (a >= max(3.0, least * p)) & (F.lit(prior) * a / F.lit(p) > 0.5 * (b + 1) / F.lit(u))
    return counts.where(frequent).select("feature", F.round(gain, 9).alias("gain")).orderBy(F.desc("gain"), "feature").limit(most)


def marked(sample: DataFrame, names: list[str]) -> DataFrame:
    """kind and the places in names of each text's features."""
    places = {f: i for i, f in enumerate(names)}

    def mark(batches):
        for batch in batches:
            at = [sorted(places[f] for f in features_of(t or "") if f in places) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32()))], names=["kind", "at"])

    return sample.select("text", "kind").mapInArrow(mark, "kind int, at array<int>")


def train(pos: np.ndarray, unl: np.ndarray, prior: float, *, steps: int = 500, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of the sigmoid loss, by Adam.

    The sigmoid loss lies between 0 and 1, so a few texts far on the wrong side,
    of which the two samples have unlike shares, can't turn the estimate.
    """
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def side(x):
        """Mean loss if x were negative (1 less if positive), and its gradient."""
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500)))
        g = p * (1 - p)
        return float(p.mean()), np.append(x.T @ g, g.sum()) / len(x)

    for t in range(1, steps + 1):
        pos_neg, grad_pos = side(pos)
        unl_neg, grad_unl = side(unl)
        rest = grad_unl - prior * grad_pos
        grad = rest - prior * grad_pos if unl_neg >= prior * pos_neg else -rest
        grad[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class ToxicityModel:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.places = {f: float(w) for f, w in zip(names, weights, strict=True)}
        self.bias = bias

    def score(self, text: str | None) -> float:
        """The probability of toxic; a text without a known feature has that of the bias."""
        z = self.bias + sum(w for f in features_of(text or "") if (w := self.places.get(f)) is not None)
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for r, at in enumerate(rows):
        out[r, at] = 1
    return out


def fit(rows: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 7) -> ToxicityModel:
    """rows: id, text, and toxic (1, 0 or null) of rows whose labels may be learnt from.

    Texts are those of smallest hash of id and text, of the stated numbers at
    most; the prior comes from all labels. Features are counted, chosen and
    marked where the texts lie: the driver gets the chosen ones, and for each
    text of the sample which of them it has.
    """
    n_pos, n_all, n_labelled = rows.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count("*"), F.count("toxic")).first()
    take = lambda df, most, n, kind: fixed_sample(df.withColumn("all_", F.lit(1)), ["id", "text"], {1: (most, n)}, "all_", seed).select("text", F.lit(kind).alias("kind"))
    if not n_pos:
        return ToxicityModel([], np.zeros(0), -5.0)
    prior = n_pos / n_labelled
    sample = materialise(take(rows.where("toxic = 1"), positives, n_pos, 0).unionByName(take(rows, unlabelled, n_all, 1)), "sample")
    p, u = sample.agg(F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") == 1)).first()
    chosen = materialise(select(count_features(sample), max(1, p), max(1, u), prior), "features").collect()
    names = [r.feature for r in sorted(chosen, key=lambda r: (-r.gain, r.feature))]
    bits = sorted((r.kind, r["at"]) for r in materialise(marked(sample, names), "marked").collect())
    if not p or not u:
        return ToxicityModel([], np.zeros(0), -5.0)
    pos, unl = (matrix([at for k, at in bits if k == kind], len(names)) for kind in (0, 1))
    return ToxicityModel(names, *train(pos, unl, prior))


def score_texts(docs: DataFrame, model: ToxicityModel, *, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns in keep, score and predicted for each row; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())], names=[*batch.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.col(text_col).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return materialise(rows.mapInArrow(score, f"{schema}, score double"), "scores").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Labels of held-out rows and of rows without id are never read into the
    model; a document with several labels is toxic if any says so; null labels
    count as none; null and empty texts get the model's base score.
    """
    aside = held_out(id_col, 5, 0)
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.max("toxic").alias("toxic"))
    learn = docs.where(~aside & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    model = fit(learn.join(marks, F.col("_id") == F.col("_of"), "left").select(F.col("_id").alias("id"), "text", "toxic"), **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), aside.alias("held_out"), F.col(text_col).alias("text"))
    return score_texts(rows, model, keep=("doc_id", "held_out"))
