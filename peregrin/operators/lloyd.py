"""k-means with all starts in one pass, and cells of vectors with their radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .retrieval import top

#: Passes that draw candidates, and how many each draws for a centre wanted.
DRAWS, OVER = 3, 1
TOLERANCE = 1e-4


def as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres (any leading dimensions)."""
    flat = centres.reshape(-1, centres.shape[-1])
    out = (x**2).sum(1)[:, None] + (flat**2).sum(1) - 2 * x @ flat.T
    return np.maximum(out, 0.0).reshape(len(x), *centres.shape[:-1])


def _draw(vectors: DataFrame, chosen: list[np.ndarray], want: int, seed: int) -> list[np.ndarray]:
    """For each try `want` vectors more, drawn with chances as their squared distance to those chosen (all alike while none is).

    A vector's key is an exponential variate of a hash over its square, so the
    smallest keys of all tasks are such a draw, the same however rows are dealt.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def smallest(batches):
        best: list[list] = [[] for _ in shared.value]
        for batch in batches:
            x = as_matrix(batch.column(0))
            if not len(x):
                continue
            for t, have in enumerate(shared.value):
                u = (np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed + t) for r in x], float) + 1) / 2.0**64
                weight = gaps(x, have).min(1) if len(have) else np.ones(len(x))
                keys = np.where(weight > 0, -np.log(u) / np.maximum(weight, 1e-300), np.inf)
                for i in np.argsort(keys, kind="stable")[:want]:
                    if np.isfinite(keys[i]):
                        best[t].append((float(keys[i]), x[i].tolist()))
                best[t] = sorted(best[t])[:want]
        rows = [(t, k, v) for t, found in enumerate(best) for k, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["t", "key", "v"])

    found = top(vectors.mapInArrow(smallest, "t int, key double, v array<double>").distinct(), ["t"], [F.asc("key"), F.asc("v")], want).select("t", "v").collect()
    return [_joined(have, [r.v for r in found if r.t == t]) for t, have in enumerate(chosen)]


def _joined(have: np.ndarray, more: list) -> np.ndarray:
    new = np.array(sorted(more), float)
    return have if not len(new) else np.vstack([have, new]) if len(have) else new


def _totals(vectors: DataFrame, centres: list[np.ndarray], sums: bool = True) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each try: how many vectors each centre is nearest to, their sums, and the cost. One pass; each task sends a row per try, centre and dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def add(batches):
        total = None
        for batch in batches:
            x = as_matrix(batch.column(0))
            if not len(x):
                continue
            if total is None:
                total = [(np.zeros((len(c), x.shape[1] + 2))) for c in shared.value]
            x1 = np.column_stack([x, np.ones(len(x)), np.zeros(len(x))])
            for c, into in zip(shared.value, total, strict=True):
                d = gaps(x, c)
                near = d.argmin(1)
                x1[:, -1] = d[np.arange(len(x)), near]
                order = near.argsort(kind="stable")
                at = np.flatnonzero(np.diff(near[order], prepend=-1))
                into[near[order][at]] += np.add.reduceat(x1[order], at, axis=0)
        for t, into in enumerate(total or []):
            z, d = np.nonzero(np.ones_like(into) if sums else np.broadcast_to(np.arange(into.shape[1]) >= into.shape[1] - 2, into.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), t, np.int32)), pa.array(z.astype(np.int32)), pa.array((d - into.shape[1] + 2).astype(np.int32)), pa.array(into[z, d])], names=["t", "z", "d", "x"])

    rows = vectors.mapInArrow(add, "t int, z int, d int, x double").groupBy("t", "z", "d").agg(F.sum("x").alias("x")).collect()
    out = []
    for t, c in enumerate(centres):
        table = np.zeros((len(c), c.shape[1] + 2))
        for r in rows:
            if r.t == t:
                table[r.z, r.d + c.shape[1]] = r.x
        out.append((table[:, -2], table[:, :-2], float(table[:, -1].sum())))
    return out


def _reduce(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of a try's candidates by weighted k-means++, moved by a few weighted rounds. Candidates are few."""
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < min(k, len(points)):
        chance = weights * gaps(points, centres).min(1)
        centres = np.vstack([centres, points[rng.choice(len(points), p=chance / chance.sum()) if chance.sum() > 0 else rng.integers(len(points))]])
    for _ in range(10):
        near = gaps(points, centres).argmin(1)
        for z in range(len(centres)):
            if weights[near == z].sum() > 0:
                centres[z] = np.average(points[near == z], axis=0, weights=weights[near == z])
    return centres


def lloyd(vectors: DataFrame, centres: list[np.ndarray], rounds: int, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], list[float]]:
    """Centres of each try after so many rounds (fewer where none moves by more than the tolerance), and their costs."""
    going, cost = list(range(len(centres))), [np.inf] * len(centres)
    centres = [np.array(c, float) for c in centres]
    for _ in range(rounds):
        moved = []
        for t, (n, sums, _) in zip(going, _totals(vectors, [centres[t] for t in going]), strict=True):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[t])
            if np.sqrt(((new - centres[t]) ** 2).sum(1)).max(initial=0) > tolerance:
                moved.append(t)
            centres[t] = new
        going = moved
        if not going:
            break
    for t, (_, _, c) in enumerate(_totals(vectors, centres, sums=False)):
        cost[t] = c
    return centres, cost


def kmeans(vectors: DataFrame, k: int, *, tries: int = 10, rounds: int = 20, seed: int = 42) -> tuple[np.ndarray, float]:
    """Centres of the best of several starts and its cost; vectors: one column, array<double>, all of one length.

    All starts advance in the same passes: draws of candidates in proportion to
    their squared distance, a count of how many vectors each candidate stands
    for, and rounds. The driver holds tries * k centres and a few candidates for each.
    """
    chosen = _draw(vectors, [np.empty((0, 0))] * tries, 1, seed) if tries else []
    if not all(len(c) for c in chosen):
        return np.empty((0, 0)), 0.0
    for r in range(DRAWS):
        chosen = _draw(vectors, chosen, OVER * k, seed + 1000 * (r + 1))
    rng = np.random.default_rng(seed)
    starts = [_reduce(c, np.maximum(n, 1e-9), k, rng) for c, (n, _, _) in zip(chosen, _totals(vectors, chosen, sums=False), strict=True)]
    centres, cost = lloyd(vectors, starts, rounds)
    best = int(np.argmin(cost))
    return centres[best], cost[best]


def nearest_of(centres: np.ndarray):
    """A column function: the number of the centre nearest to a vector, the first on a tie."""

    @pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array(batch.tolist(), float).reshape(len(batch), -1)
            yield pd.Series(gaps(x, centres).argmin(1) if len(x) else [], dtype="int32")

    return nearest
