"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Rows of equal vector and label tie for every anchor, so a class of them is known
by its smallest ids: those that can be among the first k. Classes are dealt into
blocks and each block keeps, per label, its classes sorted by every dimension.
For an anchor the lists are read from the end where its own component puts the
greatest product (from the top for positive ones, from the bottom for negative
ones), all in step; what a list shows for the first time is scored by random
access. The threshold, the sum of the products at the present depth, bounds the
score of all that has not been shown. A search ends once it lies strictly below
the kth score of every window, or below the window itself while that holds fewer
than k, so ties are all seen. Blocks answer by themselves; the best k of their
answers are the answer.

The first search finds an anchor's positives, which make the windows of the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise

#: Positives of an anchor, negatives of a positive.
TOP = 5
#: Classes of a block, and anchors that meet it at a time: on average, as both are dealt by hash.
BLOCK, ANCHORS = 8192, 1024
#: Least depth of a step; each is twice the one before.
STEP = 2
LOWEST = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None = None) -> DataFrame:
    """vec_id, label, v (floor of 256 times each component), each different row once.

    Without rows that lack an id, a label or a vector, or have a component that is null, infinite or no number.
    """
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~odd)
    made = whole.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(256.0))).cast("array<long>").alias("v"))
    return made.distinct()


def classes_of(vectors: DataFrame, most: int = TOP + 1) -> DataFrame:
    """label, v, ids: the smallest ids of each label and vector; each task keeps so many of a class before anything is shuffled."""
    first = vectors.withColumn("r", F.row_number().over(W.partitionBy("label", "v").orderBy("vec_id"))).where(F.col("r") <= most)
    return first.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat, width = column.flatten().to_numpy(zero_copy_only=False), max(width or 0, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Lists:
    """A label's classes of one block, with their order by each dimension."""

    def __init__(self, vectors: np.ndarray, ids: list):
        self.vectors, self.n = vectors, len(vectors)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)
        self.counts = np.array([len(x) for x in ids])
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in ids])
        self.starts = np.cumsum(self.counts) - self.counts

    def bound(self, anchor: np.ndarray) -> int:
        """The threshold before anything is read."""
        return int((np.maximum(anchor, 0) * self.sorted[:, -1] + np.minimum(anchor, 0) * self.sorted[:, 0]).sum())

    def pairs(self, found: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of every kept id of the classes found."""
        counts = self.counts[found]
        at = np.repeat(self.starts[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.repeat(scores, counts), self.ids[at]


class Best:
    """The first k by score and id whose score lies within a window."""

    def __init__(self, low: int | None, high: int | None, k: int, without: int | None = None):
        self.low, self.high, self.k, self.without = LOWEST if low is None else low, high, k, without
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> int:
        """Whatever scores strictly less can't come in any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def take(self, lists: Lists, found: np.ndarray, scores: np.ndarray) -> None:
        fits = scores >= self.bar
        if self.high is not None:
            fits &= scores <= self.high
        if not fits.any():
            return
        s, i = lists.pairs(found[fits], scores[fits])
        if self.without is not None:
            s, i = s[i != self.without], i[i != self.without]
        s, i = np.concatenate([self.scores, s]), np.concatenate([self.ids, i])
        first = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[first], i[first]


def threshold_search(anchor: np.ndarray, lists: Lists, windows: list[Best]) -> int:
    """Reads the lists in step until no window can change; returns the depth reached."""
    n, depth, step = lists.n, 0, STEP
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = np.zeros(n, bool)
    while depth < n:
        threshold = int(anchor[up] @ lists.sorted[up, n - 1 - depth] + anchor[down] @ lists.sorted[down, depth])
        if all(threshold < w.bar for w in windows):
            break
        end = min(n, depth + step)
        shown = np.zeros(n, bool)
        shown[lists.order[up, n - end : n - depth].ravel()] = True
        shown[lists.order[down, depth:end].ravel()] = True
        if not len(up) and not len(down):
            shown[:], end = True, n
        fresh = np.flatnonzero(shown & ~seen)
        seen |= shown
        if len(fresh):
            scores = lists.vectors[fresh] @ anchor
            for w in windows:
                w.take(lists, fresh, scores)
        depth, step = end, step * 2
    return depth


def _lists(block: pa.Table, width: int) -> dict[int, Lists]:
    labels, vectors, ids = block["label"].to_numpy(), matrix(block["v"], width), block["ids"].to_pylist()
    return {int(k): Lists(vectors[at], [ids[i] for i in at]) for k in np.unique(labels) for at in [np.flatnonzero(labels == k)]}


def _width(*tables: pa.Table) -> int:
    return max((max((len(x) for x in t["v"].to_pylist()), default=0) for t in tables), default=0)


FOUND = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("p", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _searcher(k: int, percent: int, negatives: bool):
    def search(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and block.num_rows:
            width = _width(anchors, block)
            groups, vectors = _lists(block, width), matrix(anchors["v"], width)
            scores = anchors["scores"].to_pylist() if negatives else [None] * anchors.num_rows
            for key, own, label, v, positives in zip(anchors["anchor"].to_pylist(), anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), vectors, scores, strict=True):
                if negatives:
                    # 80 * p <= 100 * n; no score is that of a negative positive's window.
                    windows = {p: Best(-(-percent * p // 100), p, k) for p in positives if p >= 0}
                    chosen = [g for other, g in groups.items() if other != label]
                else:
                    windows = {None: Best(None, None, k, own)}
                    chosen = [groups[label]] if label in groups else []
                # Lists of great thresholds first: they raise the bars for the others.
                for bound, _, g in sorted(((g.bound(v), i, g) for i, g in enumerate(chosen)), reverse=True):
                    open_ = [w for w in windows.values() if bound >= w.bar]
                    if open_:
                        threshold_search(v, g, open_)
                out += [(key, own, p, i, s) for p, w in windows.items() for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)]
        return pa.table({f.name: pa.array([r[j] for r in out], f.type) for j, f in enumerate(FOUND)}, schema=FOUND)

    return search


def _search(anchors: DataFrame, classes: DataFrame, blocks: int, chunks: int, k: int, percent: int, negatives: bool) -> DataFrame:
    """What each block finds for each anchor."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int")).withColumn("block", numbers(blocks))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("label", "v"), F.lit(blocks)).cast("int")).withColumn("chunk", numbers(chunks))
    schema = "anchor long, anchor_id long, p long, id long, score long"
    return asked.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(_searcher(k, percent, negatives), schema)


def hard_negatives(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, every: int = 100, k: int = TOP, percent: int = 80, block: int = BLOCK, anchors_at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x), scores are inner products of these. Anchors
    are the rows whose id is divisible by `every`. The positives of an anchor are
    its first k rows of the same label and another id; the negatives of a
    positive are the first k of other labels with percent * positive <= 100 *
    negative <= 100 * positive score. Higher scores come first, ties by id. label:
    an expression that replaces the label before anything else.

    Rows without id, label or vector, or with a component that isn't finite, take
    no part. A row that is repeated counts once; rows that share an id and differ
    are rows of their own, each an anchor if the id says so. Shorter vectors end
    in zeros. Scores must fit in 64 bits. Empty tables give no rows; other
    columns aren't read.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, label_col, label)
    classes = materialise(classes_of(vectors, k + 1), "classes")
    anchors = materialise(integer_vectors(rows.where(F.col(id_col) % every == 0), id_col, vector_col, label_col, label).withColumn("anchor", F.xxhash64("vec_id", "label", "v")), "anchors")
    blocks = -(-classes.count() // block) or 1
    chunks = max(-(-anchors.count() // anchors_at_once), -(-spark.sparkContext.defaultParallelism // blocks))
    best = lambda found, by: found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= k)
    positives = materialise(best(_search(anchors, classes, blocks, chunks, k, percent, False), ["anchor"]).select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("p")), "positives")
    windows = anchors.join(positives.groupBy("anchor").agg(F.collect_set("p").alias("scores")), "anchor")
    negatives = best(_search(windows, classes, blocks, chunks, k, percent, True), ["anchor", "p"]).select("anchor", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score")
