"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if it lies in a string of `length` bytes that starts anywhere else.

1. Anchors. The q-gram of smallest hash among those of a window of `length`
   bytes is the window's anchor; equal windows have equal anchors at equal
   places, so an anchor found once can't take part in a repeat. About two in
   `length` positions are anchors; only their hashes are shuffled.
2. Contexts. For each anchor found more than once, the bytes of all windows
   that it anchors. Equal contexts are one class with a count; a batch of texts
   sends the bytes of a class once.
3. Refinement, where an anchor has several classes: positions are bucketed by
   their first 8 bytes, in order; then a bucket of depth d is refined by sorting
   on the bucket pointers of the positions d bytes on. New pointers count at
   once: the sub-buckets are refined again until they are done, and later
   buckets, which meet pointers that stand for more bytes, need fewer rounds.
   Buckets of one position leave the work. Where a bucket was cut by pointers
   beyond `length` bytes, neighbours in the order are compared.
   An anchor with more than `most` classes is refined in sub-buckets: windows
   with the anchor in the same stretch of places share their middle, so classes
   meet by place and middle; where that is still too much, by ever shorter
   stretches, down to single windows. So no task holds an unbounded group.
4. Spans of repeated windows go back to their documents.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, materialise, texts
from .minhash import _longs, mixed

LENGTH, GRAM, REFINE_BYTES = 400, 32, 3_000_000
#: Classes of an anchor that one task refines together, and the stretches of places by which more are dealt out.
GROUP_CLASSES, STRETCHES = 3000, (48, 6, 1)
#: Positions whose buckets are refined at a time.
SLICE = 1 << 17
#: Bytes of a text that are searched for anchors at a time.
CHUNK = 1 << 20
_P1, _P2, _P3, _P4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def eights(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as integers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each 32-byte gram."""
    x = eights(data)
    n = len(data) - GRAM + 1
    return mixed(x[:n] * _P1 + mixed(x[8 : 8 + n] * _P2 + x[16 : 16 + n]) * _P3 + x[24 : 24 + n] * _P4)


def _chunk_anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = gram_hashes(data)
    w = length - GRAM + 1
    n = len(h)
    rank = (h & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = rank
    rows = full.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - w + 1], before[w - 1 : n])
    at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]], at[first], first, last


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """hash, position, first and last window start of each anchor of a text; the starts partition all windows.

    Long texts are searched in overlapping chunks; an anchor at a seam may then
    come in two parts, which changes nothing, as its windows are judged singly.
    """
    parts = []
    for a in range(0, len(text) - length + 1, CHUNK):
        h, at, lo, hi = _chunk_anchors(text[a : a + CHUNK + length - 1], length)
        parts.append((h, at + a, lo + a, hi + a))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def refine(contexts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the places of its first `starts` windows that are equal to another of these windows.

    A bucket is known by its first place in `order`; its pointer is that place,
    and `depth` says how many equal bytes it stands for. Two buckets differ
    within the smaller of their depths.
    """
    data = b"".join(contexts)
    n = len(data)
    gram = np.ndarray((n,), ">u8", data + bytes(7), 0, (1,)).astype(np.uint64)
    order = np.argsort(gram)
    first = np.flatnonzero(np.concatenate([[True], gram[order[1:]] != gram[order[:-1]]]))
    sizes = np.diff(np.append(first, n))
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(first, sizes)
    depth, unsure = np.full(n, 8), np.zeros(n, bool)
    first, sizes = first[sizes > 1], sizes[sizes > 1]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(SLICE, int(sizes.sum()) + SLICE, SLICE)) + 1
    for heads, counts in zip(np.split(first, cuts), np.split(sizes, cuts), strict=True):
        while len(heads):
            heads, counts = _refine_buckets(heads, counts, order, pointer, depth, unsure, length)
    same = np.concatenate([[False], pointer[order[1:]] == pointer[order[:-1]]])
    check = np.flatnonzero(unsure)
    check = check[np.maximum(order[check - 1], order[check]) + length <= n]
    for o in (*range(0, length - 8, 8), length - 8):
        check = check[gram[order[check - 1] + o] == gram[order[check] + o]]
    same[check] = True
    group = np.cumsum(~same) - 1
    valid = np.zeros(n, bool)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    for o, s in zip(offsets[:-1], starts, strict=True):
        valid[o : o + s] = True
    times = np.bincount(group, weights=valid[order])
    twice = np.zeros(n, bool)
    twice[order] = times[group] > 1
    return [np.flatnonzero(twice[o : o + s]) for o, s in zip(offsets[:-1], starts, strict=True)]


def _refine_buckets(heads, counts, order, pointer, depth, unsure, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts these buckets on the pointers at their depth; the first places and sizes of those to refine further."""
    n = len(order)
    own = np.repeat(heads, counts)
    places = own + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = order[places]
    to = at + depth[own]
    ends = to >= n
    key = np.where(ends, n - 1 - to, pointer[np.minimum(to, n - 1)])
    deep = depth[own] + np.where(ends, 1, depth[np.maximum(key, 0)])
    rank = own * (n + 2 * length) + key
    by = np.argsort(rank)
    at, rank, deep = at[by], rank[by], deep[by]
    order[places] = at
    new = np.concatenate([[True], rank[1:] != rank[:-1]])
    inner = np.flatnonzero(new[1:] & (own[1:] == own[:-1])) + 1
    unsure[places[inner]] = np.minimum(deep[inner - 1], deep[inner]) > length
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(at)))
    heads = places[begin]
    pointer[at] = np.repeat(heads, sizes)
    depth[heads] = deep[begin]
    more = (sizes > 1) & (deep[begin] < length)
    return heads[more], sizes[more]


def to_ranges(places: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of consecutive places."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]], axis=1).tolist()


def _scan(length: int):
    def scan(batches):
        for batch in batches:
            data = texts(batch.column(1))
            found = []
            for t in data:
                h, counts = np.unique(anchors(t, length)[0], return_counts=True)
                found.append(np.concatenate([h, h[counts > 1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(t) for t in data], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in data]), _longs(found)], names=["doc_id", "version", "n_bytes", "sha", "found"])

    return scan


_KEYS = ["g1", "g2", "d1", "d2"]
#: A class: group and digest, the anchor's place in it, its windows and bytes.
_CLASS = "g1 long, g2 long, d1 long, d2 long, place int, n int, bytes binary"
_CONTEXT = f"doc_id long, version long, lo long, {_CLASS}"
_OWNER = ["o1", "o2", "c1", "c2"]
#: A part of a class: its owner, the owner's window where it starts, and its own group and digest; the bytes are the owner's.
_PART = "o1 long, o2 long, c1 long, c2 long, lo int, g1 long, g2 long, d1 long, d2 long, place int, n int"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _digest(data: bytes, seed: int) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(data, seed=seed))


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            rows, size, sent = [], 0, set()
            for key, version, text, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                h, at, lo, hi = anchors(text, length)
                keep = np.isin(h, np.array(shared, np.int64).view(np.uint64))
                for x, p, a, b in zip(h[keep].view(np.int64).tolist(), at[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), strict=True):
                    data = text[a : b + length]
                    d = _digest(data, p - a)
                    # The bytes of a class are sent once for each batch.
                    rows.append((key, version, a, x, 0, *d, p - a, b - a + 1, None if d in sent else data))
                    size += len(data)
                    sent.add(d)
                    if size > 8_000_000:
                        yield _batch(rows, _CONTEXT)
                        rows, size = [], 0
            yield _batch(rows, _CONTEXT)

    return cut


def split_class(group: tuple[int, int], place: int, n: int, data: bytes, length: int, stretch: int):
    """(first window, group, place, n, bytes) of each part of a class; windows that may be equal get equal groups.

    The anchor's place in a window falls from `place` on; windows whose places lie
    in one stretch share the bytes from its first place before the anchor to what
    the last leaves behind it. Group and those bytes name the part's group.
    """
    for i in range((place - n + 1) // stretch, place // stretch + 1):
        near, far = max(place - n + 1, i * stretch), min(place, (i + 1) * stretch - 1)
        middle = data[place - i * stretch : place + length - (i + 1) * stretch + 1]
        a = place - far
        yield a, _digest(struct.pack("<qqi", *group, i) + middle, 0), far, far - near + 1, data[a : a + far - near + length]


def _split(length: int, stretch: int):
    def split(batches):
        for batch in batches:
            rows = []
            for g1, g2, d1, d2, place, n, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                for lo, group, p, k, part in split_class((g1, g2), place, n, data, length, stretch):
                    rows.append((g1, g2, d1, d2, lo, *group, *_digest(part, p), p, k))
            yield _batch(rows, _PART)

    return split


def _refine_groups(length: int, most_bytes: int):
    """Rows come sorted by group; groups of one class say nothing and are left out."""

    def work(batches):
        held, own, size, last = [], [], 0, None

        def flush():
            spans = refine([r[5] for r in held], [r[4] for r in held], length) if held else []
            rows = [(*r[:4], x) for r, s in zip(held, spans, strict=True) if (x := to_ranges(s))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.list_(pa.list_(pa.int64())))], names=[*_KEYS, "spans"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[:2] != last:
                    if len(own) > 1:
                        held += own
                        size += sum(len(r[5]) for r in own)
                    if size >= most_bytes:
                        yield flush()
                        held, size = [], 0
                    own, last = [], row[:2]
                own.append(row)
        if len(own) > 1:
            held += own
        yield flush()

    return work


def _refined(classes: DataFrame, length: int) -> DataFrame:
    """Rows of _CLASS, each class once -> g1, g2, d1, d2, spans; groups are refined whole, each in one task."""
    rows = classes.select(*_KEYS, "n", "bytes").repartition("g1", "g2").sortWithinPartitions(*_KEYS)
    return rows.mapInArrow(_refine_groups(length, REFINE_BYTES), "g1 long, g2 long, d1 long, d2 long, spans array<array<long>>")


def class_spans(members: DataFrame, length: int, most: int, stretches: tuple[int, ...] = STRETCHES) -> tuple[DataFrame, DataFrame]:
    """members: rows of _CLASS. Which of a class's windows are equal to another in its group: two tables.

    The classes found more than once (k times), all of whose windows are; and
    g1, g2, d1, d2, spans ([first, last] window) of classes that share windows
    with others of their group.
    """
    classes = materialise(members.groupBy(_KEYS).agg(F.count("*").alias("k"), F.first("n").alias("n")), "classes")
    hot = materialise(classes.groupBy("g1", "g2").agg(F.count("*").alias("c")).where(F.col("c") > most).select("g1", "g2"), "hot")
    once = lambda df: df.groupBy(_KEYS).agg(F.first("place").alias("place"), F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    held = members.where("bytes is not null")
    if not hot.count():
        return classes.where("k > 1"), materialise(_refined(once(held), length), "found")
    found = materialise(_refined(once(held.join(hot, ["g1", "g2"], "left_anti")), length), "found")
    base = materialise(once(held.join(hot, ["g1", "g2"], "left_semi")), "base")
    return classes.where("k > 1"), materialise(found.unionByName(part_spans(base, length, most, stretches)), "found")


def part_spans(base: DataFrame, length: int, most: int, stretches: tuple[int, ...]) -> DataFrame:
    """base: rows of _CLASS, each class once, of groups too large for a task -> g1, g2, d1, d2, spans.

    Parts travel without bytes; only those that meet another class get their
    owner's bytes.
    """
    parts = materialise(base.mapInArrow(_split(length, stretches[0]), _PART), "parts")
    owner = F.struct(*_OWNER, "lo")
    classes = materialise(parts.groupBy(_KEYS).agg(F.count("*").alias("k"), F.first("place").alias("place"), F.first("n").alias("n"), F.min(owner).alias("of")), "classes")
    groups = materialise(classes.groupBy("g1", "g2").agg(F.count("*").alias("c")).where("c > 1"), "groups")
    owners = base.select(*(F.col(k).alias(o) for k, o in zip(_KEYS, _OWNER, strict=True)), F.col("bytes").alias("all"))

    def with_bytes(chosen: DataFrame) -> DataFrame:
        rows = classes.join(chosen.select("g1", "g2"), ["g1", "g2"], "left_semi").select(*_KEYS, "place", "n", *(F.col(f"of.{o}").alias(o) for o in _OWNER), F.col("of.lo").alias("lo"))
        return rows.join(owners, _OWNER).select(*_KEYS, "place", "n", F.expr(f"substring(all, lo + 1, n + {length - 1})").alias("bytes"))

    inside = classes.where("k > 1").select(*_KEYS, _all_windows()).unionByName(_refined(with_bytes(groups.where(F.col("c") <= most)), length))
    large = groups.where(F.col("c") > most)
    if stretches[1:] and large.count():
        inside = inside.unionByName(part_spans(materialise(with_bytes(large), "base"), length, most, stretches[1:]))
    inside = materialise(inside, "inside")
    shifted = F.transform("spans", lambda s: F.array(s[0] + F.col("lo"), s[1] + F.col("lo"))).alias("spans")
    return parts.select(*_OWNER, "lo", *_KEYS).join(inside, _KEYS).select(*(F.col(o).alias(k) for k, o in zip(_KEYS, _OWNER, strict=True)), shifted)


def _all_windows():
    return F.array(F.array(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("spans")


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Disjoint maximal runs of [start, end) spans; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = GROUP_CLASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of doc_id and version (a hash of the text): n_bytes and sha of every row; the texts with repeats; their spans.

    spans: [start, end) byte runs of repeated windows, neither sorted nor merged.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    scanned = materialise(source.mapInArrow(_scan(length), "doc_id long, version long, n_bytes long, sha string, found array<long>"), "scanned")
    # An anchor that a text holds more than once comes twice from it.
    grams = scanned.select("doc_id", "version", F.explode("found").alias("h"))
    shared = grams.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    lists = grams.join(shared, "h", "left_semi").groupBy("doc_id", "version").agg(F.collect_set("h").alias("shared"))
    same = F.col("s.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("s.version") == F.col("l.version"))
    texts_ = materialise(source.alias("s").join(lists.alias("l"), same).select("s.doc_id", "s.version", "s.text", "l.shared"), "texts")
    contexts = materialise(texts_.select("doc_id", "version", "text", "shared").mapInArrow(_cut(length), _CONTEXT), "contexts")
    whole, found = class_spans(contexts.drop("doc_id", "version", "lo"), length, most)
    held = contexts.select("doc_id", "version", "lo", *_KEYS)
    places = join_hot(held, whole.select(*_KEYS, "k", _all_windows()), _KEYS, "k", contexts.count()).unionByName(held.join(found, _KEYS))
    places = places.select("doc_id", "version", "lo", F.explode("spans").alias("span")).select("doc_id", "version", F.struct((F.col("lo") + F.col("span")[0]).alias("a"), (F.col("lo") + F.col("span")[1] + length).alias("b")).alias("span"))
    gone = places.groupBy("doc_id", "version").agg(F.collect_set("span").alias("spans"))
    return scanned.select("doc_id", "version", "n_bytes", "sha"), texts_, gone


def _strip(batches):
    for batch in batches:
        removed, runs, shas = [], [], []
        for text, spans in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            spans = merge_spans([(s["a"], s["b"]) for s in spans])
            edges = [0, *(x for s in spans for x in s), len(text)]
            left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(text) - len(left))
            runs.append(len(spans))
            shas.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas)], names=["doc_id", "version", "n_removed", "n_spans", "kept_sha256"])


def repeats_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, has_repeats for each row of docs.

    n_bytes is the whole text's length, n_kept what is left of it; has_repeats
    says whether anything is removed. A null text is empty; texts under `length`
    bytes lose nothing; rows that repeat a text lose it, ids or not; empty tables
    give no rows.
    """
    scanned, texts_, gone = repeated_spans(docs, **options)
    same = F.col("t.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("t.version") == F.col("g.version"))
    held = texts_.select("doc_id", "version", "text").dropDuplicates(["doc_id", "version"])
    cut = materialise(held.alias("t").join(gone.alias("g"), same).select("t.doc_id", "t.version", "t.text", "g.spans").mapInArrow(_strip, "doc_id long, version long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    same = F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.version") == F.col("c.version"))
    zero = F.lit(0).cast("long")
    out = scanned.alias("s").join(cut.alias("c"), same, "left").select("s.doc_id", "s.n_bytes", F.coalesce("c.n_removed", zero).alias("n_removed"), F.coalesce("c.n_spans", zero).alias("n_spans"), F.coalesce("c.kept_sha256", "s.sha").alias("kept_sha256"))
    return out.withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "has_repeats": F.col("n_removed") > 0})
