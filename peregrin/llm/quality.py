"""Quality rules: divergence from language references, beside simple counts.

One pass over the texts counts what the rules need: words, symbols, repeated
lines and words, a histogram over character classes and one over common words of
each language. The references are these histograms summed over all documents of
a language that pass the count rules and have at most a symbol for ten words, so
that junk doesn't become a part of what it is compared with. A document fails if its Jensen-Shannon distance to every language's
reference is too great, in either histogram; short documents, whose histograms
say little, are guarded by a minimum length and pass that test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, texts, unused

#: Common words, about as frequent as they stand in line.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by this at from or an not",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas ne se",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "mark", "symbol", "control", "beyond")
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Least share of the ordinary documents that a language needs for a reference.
LEAST_SHARE = 0.001
#: Limits for long texts; a text of n words gets SLACK / n more, as chance alone moves short ones.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE, SLACK = 0.15, 0.42, 5.0


def _classes() -> np.ndarray:
    """Byte -> class; UTF-8 continuation bytes have none, lead bytes are `beyond`."""
    out = np.full(256, -1)
    for b in range(256):
        c = chr(b)
        if b >= 192:
            name = "beyond"
        elif b >= 128:
            continue
        elif "a" <= c <= "z":
            name = "lower"
        elif "A" <= c <= "Z":
            name = "upper"
        elif c.isdigit():
            name = "digit"
        elif c == "\n":
            name = "newline"
        elif c in " \t\r":
            name = "blank"
        elif c in ".,":
            name = "stop"
        elif c in "!?;:'\"()-":
            name = "mark"
        elif b < 32 or b == 127:
            name = "control"
        else:
            name = "symbol"
        out[b] = CLASSES.index(name)
    return out


def common_places(common: dict[str, str] = COMMON) -> tuple[dict[bytes, int], int]:
    """Chunk -> place in the word histogram, whose last place is all other words."""
    words = sorted({w for line in common.values() for w in line.split()})
    places = {}
    for i, w in enumerate(words):
        for form in (w, w.capitalize()):
            for end in ("", ",", ".", ";", ":", "!", "?"):
                places[(form + end).encode()] = i
    return places, len(words) + 1


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * np.int64(len(names)) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def count_features(docs: DataFrame, *, keep: tuple[str, ...], text_col: str = "text", lang_col: str | None = "lang", common: dict[str, str] = COMMON) -> DataFrame:
    """The columns in keep (as k0, k1, ...), lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, words."""
    places, size = common_places(common)
    classes = _classes()

    def count(batches):
        member = np.zeros((256, len(CLASSES)), np.int64)
        member[np.flatnonzero(classes >= 0), classes[classes >= 0]] = 1
        for batch in batches:
            rows = []
            for text in texts(batch.column(batch.num_columns - 1)):
                words = text.split()
                of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                hist = np.zeros(size, np.int64)
                known = [places[w] for w in words if w in places]
                if known:
                    hist += np.bincount(np.array(known), minlength=size)
                hist[-1] = len(words) - len(known)
                points = len(text) - int(of[128:192].sum())
                rows.append((len(words), points - int(of[list(BLANKS)].sum()), int(of[list(SYMBOLS)].sum()), duplicate_lines(text), repeated_words(words), (of @ member).tolist(), hist.tolist()))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*batch.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), lang.alias("lang"), F.col(text_col).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{schema}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>")


def references(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language -> its two distributions over all its ordinary documents; rows without lang don't count.

    Languages of under one in 1000 of these documents have no reference, so the
    result has at most 1000 rows, whatever stands in the column.
    """
    sums = lambda c, n: [F.sum(F.col(c)[i]).alias(f"{c}{i}") for i in range(n)]
    size = common_places()[1]
    ordinary = features.where(f"lang is not null and not ({BASE_FAILED}) and 10 * n_symbols <= n_words")
    rows = ordinary.groupBy("lang").agg(F.count("*").alias("rows"), *sums("chars", len(CLASSES)), *sums("words", size)).where(F.col("rows") >= LEAST_SHARE * ordinary.count()).collect()
    out = {}
    for r in rows:
        chars, words = (np.array([r[f"{c}{i}"] or 0 for i in range(n)], float) for c, n in (("chars", len(CLASSES)), ("words", size)))
        if chars.sum() and words.sum():
            out[r.lang] = (chars / chars.sum(), words / words.sum())
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance of each row of p from q: the root of the divergence to base 2, from 0 to 1."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


def nearest(n_words: np.ndarray, chars: np.ndarray, words: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], least_words: int, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its two distances to the language of least sum (the first of equals); nan under the minimum lengths."""
    if not known or not len(n_words):
        return np.full(len(n_words), np.nan), np.full(len(n_words), np.nan)
    long_chars, long_words = chars.sum(axis=1) >= max(1, least_chars), n_words >= max(1, least_words)
    share = lambda x: x / np.maximum(1, x.sum(axis=1, keepdims=True))
    c = np.stack([np.where(long_chars, jensen_shannon(share(chars), rc), np.nan) for rc, _ in known])
    w = np.stack([np.where(long_words, jensen_shannon(share(words), rw), np.nan) for _, rw in known])
    at = (np.nan_to_num(c) + np.nan_to_num(w)).argmin(axis=0), np.arange(len(n_words))
    return c[at], w[at]


def judge(docs: DataFrame, *, keep: tuple[str, ...], most_char: float = MOST_CHAR_DISTANCE, most_word: float = MOST_WORD_DISTANCE, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS, **options) -> DataFrame:
    """The columns in keep, the counts, base_failed, char_distance, word_distance and kept.

    base_failed: under 50 words, or more than half of the words in repeated
    3-word windows. Distances are those to the nearest language, null for texts
    under the minimum length and if no row names a language. A null text has no
    word and fails; repeated rows are judged each; empty tables give no rows.
    """
    features = materialise(count_features(docs, keep=keep, **options), "features")
    known = references(features)
    names = sorted(known)

    def measure(batches):
        pairs = [known[n] for n in names]
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            matrix = lambda c: batch.column(at[c]).values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)  # noqa: B023, E731
            n_words = batch.column(at["n_words"]).to_numpy(zero_copy_only=False)
            found = nearest(n_words, matrix("chars"), matrix("words"), pairs, least_words, least_chars) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: at["chars"]], *(pa.array(x, pa.float64(), from_pandas=True) for x in found)], names=[*batch.schema.names[: at["chars"]], "char_distance", "word_distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields[:-2])
    out = materialise(features.mapInArrow(measure, f"{schema}, char_distance double, word_distance double"), "distances")
    out = out.withColumn("base_failed", F.expr(BASE_FAILED))
    slack = SLACK / F.greatest(F.col("n_words"), F.lit(1))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= most_char + slack) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word + slack)
    out = out.withColumn("kept", ~F.col("base_failed") & near)
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *results)


def quality_report(docs: DataFrame, **options) -> DataFrame:
    return judge(docs, keep=("doc_id",), **options)


def drop_poor(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that fail; rows are told apart by id and text, so each is judged by its own text."""
    version, gone_id, gone_version = (unused(docs, n) for n in ("_version", "_gone_id", "_gone_version"))
    marked = docs.withColumn(version, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    judged = judge(marked, keep=(id_col, version), text_col=text_col, **options)
    gone = judged.where("not kept").select(F.col(id_col).alias(gone_id), F.col(version).alias(gone_version)).distinct()
    return marked.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(version) == F.col(gone_version)), "left_anti").drop(version)
