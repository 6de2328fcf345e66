"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word tokens that must lie in a document as they
stand (containment 1). The tokens of each window are ordered by their rarity in
the corpus; containment 1 makes the necessary prefix one token long, so a
document's words are joined with the rarest token of each window only. A
matching word fixes where the window would start (positional bound), it must
end inside the document (length bound), and then its words are looked up among
the windows with that token at that place.

Windows, their items, the tokens' document frequencies and the prefixes are
tables that Spark makes. The windows are dealt into blocks of bounded size by a
hash; each block's index goes to the executors, where documents are searched in
place, so documents are never shuffled. A benchmark of some thousand items is
one block; more blocks are more steps within the same stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialise, texts, unused

#: A-Z to a-z; every other ASCII byte that is no digit or letter becomes a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Windows in a block, on average: some 200 MB in a Python worker.
BLOCK_WINDOWS = 200_000


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """All n consecutive words; shorter items are one window, empty ones none."""
    if len(words) < n:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def item_windows(bench: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """w (the words, joined by blanks) and item: the distinct windows of each item."""

    def cut(batches):
        for batch in batches:
            rows = [(b" ".join(w), k) for k, text in enumerate(texts(batch.column(1))) for w in dict.fromkeys(windows_of(words_of(text), n))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), batch.column(0).take(pa.array([k for _, k in rows], pa.int64()))], names=["w", "item"])

    kind = bench.schema[item_col].dataType.simpleString()
    return bench.select(F.col(item_col).alias("item"), text_col).mapInArrow(cut, f"w binary, item {kind}").distinct()


def token_frequency(docs: DataFrame, text_col: str, tokens: set[bytes]) -> DataFrame:
    """t, df: in how many of all documents each of the tokens stands."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        seen: dict[bytes, int] = {}
        known = shared.value
        for batch in batches:
            for text in texts(batch.column(0)):
                for w in known.intersection(words_of(text)):
                    seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["t", "df"])

    return docs.select(text_col).mapInArrow(count, "t binary, df long").groupBy("t").agg(F.sum("df").alias("df"))


def prefixes(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """t, w, items: each window with its rarest token (of equally rare ones the smaller) and its items."""
    items = windows.groupBy("w").agg(F.collect_list("item").alias("items"))
    tokens = windows.select("w").distinct().select("w", F.explode(F.split(F.col("w").cast("string"), " ")).alias("t")).withColumn("t", F.col("t").cast("binary"))
    # As many rows as the block has tokens, at most.
    rarest = tokens.join(F.broadcast(frequency), "t", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")).alias("p"))
    return items.join(rarest, "w").select(F.col("p.t").alias("t"), "w", "items")


def window_index(rows) -> dict[bytes, dict[tuple[int, int], dict[tuple, list]]]:
    """Prefix token -> (its first place in the window, window length) -> window -> items."""
    index: dict = {}
    for token, window, items in rows:
        words = tuple(bytes(window).split(b" "))
        index.setdefault(bytes(token), {}).setdefault((words.index(bytes(token)), len(words)), {})[words] = sorted(items, key=str)
    return index


def find_windows(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set]:
    """Word ranges in which windows occur (sorted, disjoint), and the windows' items.

    A word costs one lookup, and one more for each place that it has as a
    prefix; windows have 13 words at most, however many share a token.
    """
    found, items, n = [], set(), len(words)
    for at, w in enumerate(words):
        if w in index:
            for (place, length), windows in index[w].items():
                start = at - place
                if start >= 0 and start + length <= n and (of := windows.get(tuple(words[start : start + length]))) is not None:
                    found.append((start, start + length))
                    items.update(of)
    return merge(found), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents' columns named in keep as k0, k1, ..., with n_words, hits and items.

    hits: ranges [start, end) of words that lie inside an occurring window,
    sorted and disjoint; items: the items that these windows come from.
    Null and empty texts have no words and no hits; null items have no windows;
    rows of documents that repeat are judged each on its own; an empty benchmark
    hits nothing; columns not named in keep are not read, whatever their names.
    """
    spark = docs.sparkSession
    item_type = bench.schema[item_col].dataType
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"), F.lit(-1).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("hits"), F.array().cast(T.ArrayType(item_type)).alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    windows = materialise(item_windows(bench, item_col, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)))
    for k in range(blocks):
        block = dealt.where(F.col("block") == k).select("w", "item")
        tokens = {bytes(r.t) for r in block.select(F.explode(F.split(F.col("w").cast("string"), " ")).alias("t")).distinct().select(F.col("t").cast("binary").alias("t")).collect()}
        index = window_index(materialise(prefixes(block, token_frequency(docs, text_col, tokens)), "prefixes").collect())
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(index)), schema)
    return materialise(out.drop("text"), "hits")


def _search(shared):
    def search(batches):
        index = shared.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            old_hits, old_items = batch.column(at["hits"]).to_pylist(), batch.column(at["items"]).to_pylist()
            counts, hits, items = [], [], []
            for text, h, i in zip(texts(batch.column(at["text"])), old_hits, old_items, strict=True):
                words = words_of(text)
                found, of = find_windows(words, index)
                counts.append(len(words))
                hits.append(merge(found + [tuple(x) for x in h]) if h else found)
                items.append(sorted(of.union(i), key=str) if i else sorted(of, key=str))
            new = {"n_words": counts, "hits": hits, "items": items}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    return search


def _n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda t, r: t + r[1] - r[0])


def contamination_report(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, per document."""
    found = find_contamination(docs, bench, keep=(id_col,), **options)
    return found.select(
        F.col("k0").alias("doc_id"),
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those of which at least a twentieth is benchmark text.

    Rows are told apart by id and text, so each is judged by its own text.
    """
    version, gone_id, gone_version = (unused(docs, n) for n in ("_version", "_gone_id", "_gone_version"))
    marked = docs.withColumn(version, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = find_contamination(marked, bench, keep=(id_col, version), text_col=text_col, **options)
    gone = found.where((_n_hit() > 0) & (20 * _n_hit() >= F.col("n_words"))).select(F.col("k0").alias(gone_id), F.col("k1").alias(gone_version)).distinct()
    return marked.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(version) == F.col(gone_version)), "left_anti").drop(version)
