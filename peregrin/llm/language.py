"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed 2- and 3-gram counts of their lower-cased characters, weighted
by the logarithm of the count and the inverse document frequency over all
documents to learn from, at unit length. The model is trained by
follow-the-regularised-leader (FTRL-proximal) with an L1 and L2 penalty, which
leaves weights that say nothing at exactly zero; a temperature fitted on texts
kept aside makes its probabilities honest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fixed_sample, materialise, texts

#: Hashed n-grams; more n-grams than this share places.
FEATURES = 1 << 14
#: The classifier is fitted on at most this many documents, however many there are.
SAMPLE = 4000
#: Languages with a smaller share of the rows to learn from aren't learnt, so there are at most 1000.
LEAST_SHARE = 0.001
UNKNOWN = "und"


def gram_counts(text: str, features: int = FEATURES) -> np.ndarray:
    """How often each hashed 2- and 3-gram stands in the whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = (c[:-1] * np.uint64(0x9E3779B1) + c[1:]) * np.uint64(0x9E3779B97F4A7C15)
    out = np.bincount((two >> np.uint64(50)).astype(np.int64) % features, minlength=features)
    if len(c) > 2:
        three = (two[:-1] + c[2:] * np.uint64(0x85EBCA77)) * np.uint64(0xD6E8FEB86659FD93)
        out += np.bincount((three >> np.uint64(50)).astype(np.int64) % features, minlength=features)
    return out


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights at unit length."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = float(np.sqrt((x * x).sum()))
    return at, x / norm if norm else x


class Ftrl:
    """FTRL-proximal for multinomial logistic regression, updated text by text."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.bias = np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = softmax(x @ w + self.bias)
        g[label] -= 1
        self.bias -= 0.01 * g
        grad = np.outer(x, g)
        sigma = (np.sqrt(self.n[at] + grad * grad) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += grad - sigma * w
        self.n[at] += grad * grad


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm."""

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    """What prediction needs: classes, idf, weights, bias, temperature."""

    def __init__(self, classes: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes, self.idf, self.weights, self.bias, self.temperature = classes, idf, weights.astype(np.float32), bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = tfidf(gram_counts(text, len(self.idf)), self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def document_frequency(rows: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed n-gram stands, and how many texts there are; one row per place reaches the driver."""

    def count(batches):
        df, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for t in texts(batch.column(0)):
                c = gram_counts(t.decode(), features)
                df += c > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["at", "n"])

    out, total = np.zeros(features, np.int64), 0
    for r in materialise(rows.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")), "frequency").collect():
        if r["at"] < 0:
            total = r["n"]
        else:
            out[r["at"]] = r["n"]
    return out, total


def fit(rows: DataFrame, *, features: int = FEATURES, sample: int = SAMPLE, epochs: int = 3, seed: int = 5, least_share: float = LEAST_SHARE) -> LanguageModel:
    """rows: id, text and lang (not null). Statistics come from all rows, the weights from at most `sample` of them.

    Each language gives as many rows as any other, or all it has: those of
    smallest hash of id and text.
    """
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_share * rows.count()).collect()}
    if not counts:
        return LanguageModel([], np.ones(features), np.zeros((features, 0)), np.zeros(0), 1.0)
    df, total = document_frequency(rows, features)
    idf = np.log((1 + total) / (1 + df)) + 1
    classes = sorted(counts)
    each = max(1, sample // len(classes))
    picked = fixed_sample(rows, ["id", "text"], {k: (each, n) for k, n in counts.items()}, "lang", seed)

    def featurise(batches):
        for batch in batches:
            pairs = [tfidf(gram_counts(t.decode(), features), idf) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in pairs], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in pairs], pa.binary())], names=["lang", "at", "x"])

    data = [(classes.index(r["lang"]), np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in materialise(picked.select("text", "lang").mapInArrow(featurise, "lang string, at binary, x binary"), "sample").collect()]
    data.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    order = np.random.default_rng(seed).permutation(len(data))
    aside, learn = order[: len(data) // 5], order[len(data) // 5 :]
    model = Ftrl(features, len(classes))
    for _ in range(epochs):
        for i in learn:
            model.learn(data[i][1], data[i][2], data[i][0])
    weights = model.weights()
    temperature = 1.0
    if len(aside):
        temperature = fit_temperature(np.stack([data[i][2] @ weights[data[i][1]] + model.bias for i in aside]), np.array([data[i][0] for i in aside]))
    return LanguageModel(classes, idf, weights, model.bias, temperature)


def identify(docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns in keep, lang_pred and score for each row.

    A null text, one without a letter, and every text if the model knows no
    language, is `und` with score 0. Repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text_col).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return materialise(rows.mapInArrow(predict, f"{schema}, lang_pred string, score double"), "languages")


def held_out(id_col: str, parts: int, part: int):
    """Whether a row's crc32 of its id as text leaves this remainder; false without id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def language_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows with id that aren't held out and name a language."""
    aside = held_out(id_col, 4, 2)
    known = docs.where(~aside & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = fit(known.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), aside.alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model, keep=("doc_id", "held_out"))
