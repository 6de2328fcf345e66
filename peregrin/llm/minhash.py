"""MinHash near-duplicates with tensored banding and verified links.

A set gets two small collections of hashes, A_1..A_m and B_1..B_m, each value
joining `rows` minhashes. The m * m tables of the index are the pairs (A_i, B_j),
so m * m tables need only 2 * m * rows minhashes instead of m * m * 2 * rows.
Two sets meet in a table exactly if they share an A and a B; with m = 16 and
rows = 4 that holds for 99.95 % of pairs of Jaccard similarity 0.8 and for nearly
all above. Copies are one class throughout, so only different sets meet.

Links are confirmed on full sets, and no step lists all pairs of a group:

1. In each table the member with the least share of unique shingles (usually
   the text that the others were copied from) is the centre, and each other
   member is compared with it.
2. Tables' members that share a centre make a family. Families still in more
   than one component are compared throughout, in blocks of bounded size, but
   for pairs which are ruled out: by the sizes of their sets, by the shingles
   that no other candidate has (which bound the intersection), or by fewer
   equal minhashes than a linked pair has but once in a million.

A document with over a fifth of its shingles in no other candidate can have no
link at all and leaves before step 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, materialise, release, texts, unused
from .components import connected_components

TABLES, ROWS = 16, 4
#: Equal minhashes of 128 below which a pair is not compared: 4.8 standard deviations under the mean at 0.8.
LEAST_EQUAL = 81
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _ADD
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, none none.

    Words are runs of anything but blank, tab, line and page breaks; A-Z count as a-z.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    m = len(h) - k + 1
    out = mixed(h[:m] + np.uint64(k))
    for i in range(1, k):
        out = mixed(out * _MUL + h[i : i + m])
    return np.unique(out)


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def minhashes(items: np.ndarray, mul: np.ndarray, add: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """The smallest value of each hash function; items come in chunks, so memory is bounded."""
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), chunk):
        np.minimum(out, (items[None, a : a + chunk] * mul[:, None] + add[:, None]).min(axis=1), out=out)
    return out


def collections(mins: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """2 * tables values, each of `rows` minhashes and its own place; A even, B odd."""
    parts = mins.reshape(2 * tables, rows)
    out = mixed(np.arange(2 * tables, dtype=np.uint64) + np.uint64(1))
    for i in range(rows):
        out = mixed(out * _MUL + parts[:, i])
    side = np.repeat(np.array([0, 1], np.uint64), tables)
    return (out & ~np.uint64(1)) | side


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _sets(column: pa.ListArray) -> list[np.ndarray]:
    """Views of the sets, sorted as unsigned integers."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signer(n: int, tables: int, rows: int, seed: int):
    def sign(batches):
        mul, add = hash_family(2 * tables * rows, seed)
        for batch in batches:
            sizes, first, second, values = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text, n)
                print_ = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                first.append(int.from_bytes(print_[:8], "little", signed=True))
                second.append(int.from_bytes(print_[8:], "little", signed=True))
                values.append(collections(minhashes(s, mul, add), tables, rows) if len(s) else s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _longs(values)], names=["doc_id", "n", "p1", "p2", "v"])

    return sign


def _set_maker(n: int, tables: int, rows: int, seed: int):
    def make(batches):
        mul, add = hash_family(2 * tables * rows, seed)
        for batch in batches:
            sets = [shingle_set(t, n) for t in texts(batch.column(1))]
            sigs = [(minhashes(s, mul, add) >> np.uint64(32)).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _longs(sets), pa.array(sigs, pa.binary())], names=["rep", "n", "items", "sig"])

    return make


def _star_check(percent: int):
    def check(batches):
        for batch in batches:
            ok = [linked(a, b, percent) for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["u", "c", "ok"])

    return check


def block_links(ids: list, roots: list, sides: list[int], sets: list[np.ndarray], unique: np.ndarray, sigs: np.ndarray, percent: int, least_equal: int, same: bool) -> list[tuple]:
    """Links that join components within a block pair; same: the two blocks are one."""
    parent = {r: r for r in roots}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = np.array([len(s) for s in sets], np.int64)
    core = n - unique
    side = np.array(sides)
    links = []
    for i in range(len(ids)):
        others = np.arange(i) if same else np.flatnonzero(side != side[i])
        if not same and side[i]:
            continue
        most = np.minimum(core[others], core[i])
        others = others[100 * most >= percent * (n[others] + n[i] - most)]
        others = others[(sigs[others] == sigs[i]).sum(axis=1) >= least_equal]
        for j in others:
            a, b = find(roots[i]), find(roots[j])
            if a != b and linked(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def _family_check(percent: int, least_equal: int):
    def check(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, blocks = table["u"].to_pylist(), table["block"].to_numpy()
        same = bool(table["bi"][0].as_py() == table["bj"][0].as_py())
        column = table["items"].chunk(0) if isinstance(table["items"], pa.ChunkedArray) else table["items"]
        sigs = np.stack([np.frombuffer(x, np.uint8) for x in table["sig"].to_pylist()])
        links = block_links(ids, table["root"].to_pylist(), (blocks != blocks.min()).astype(int).tolist(), _sets(column), table["uniq"].to_numpy(), sigs, percent, least_equal, same)
        return pa.table({"u": pa.array([a for a, _ in links], table["u"].type), "v": pa.array([b for _, b in links], table["u"].type)})

    return check


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, tables: int = TABLES, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest id reachable over links. Null and
    empty texts have an empty set and are linked with nothing. Rows that share an
    id are one document with several sets. A row without id is linked only with
    equal sets, and is kept if no row with an id has that set. An empty table
    gives no rows; columns other than these two are not read. doc_id must be an
    integer type.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(source.mapInArrow(_signer(shingle, tables, rows, seed), "doc_id long, n long, p1 long, p2 long, v array<long>"), "signed")
    classes = materialise(signed.where("n > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("rep"), F.first("v").alias("v")), "classes")

    # Tables: values that no other class has are left out before pairs are formed.
    values = classes.where("rep is not null").select("rep", F.explode("v").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").select("v")
    sides = values.join(shared, "v", "left_semi").groupBy("rep").agg(F.collect_set(F.when(F.col("v") % 2 == 0, F.col("v"))).alias("a"), F.collect_set(F.when(F.col("v") % 2 != 0, F.col("v"))).alias("b"))
    keys = sides.select("rep", F.explode("a").alias("x"), "b").select("rep", "x", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep")
    keys = materialise(keys, "keys")
    full = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    members = materialise(keys.join(full, "key", "left_semi").select("key", "rep"), "members")
    release(keys)

    # Full sets of the candidates, and how many shingles each has alone.
    wanted = members.select("rep").distinct()
    sets = materialise(source.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_set_maker(shingle, tables, rows, seed), "rep long, n long, items array<long>, sig binary"), "sets")
    alone = sets.select("rep", F.explode("items").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("rep").agg(F.count("*").alias("uniq"))
    strong = materialise(sets.select("rep", "n").join(alone, "rep", "left").select("rep", "n", F.coalesce("uniq", F.lit(0)).alias("uniq")).where(100 * (F.col("n") - F.col("uniq")) >= percent * F.col("n")), "strong")

    # Step 1: each member against the centre of each of its tables.
    one = strong.groupBy("rep").agg(F.min(F.col("uniq") / F.col("n")).alias("share"), F.min("uniq").alias("uniq"))
    rated = members.join(one.select("rep", "share"), "rep")
    centres = rated.groupBy("key").agg(F.min(F.struct("share", "rep")).alias("c"), F.count("*").alias("k")).where("k > 1").select("key", F.col("c.rep").alias("c"))
    star = rated.join(centres, "key").where("rep <> c").select(F.col("rep").alias("u"), "c").distinct()
    star = star.join(sets.select(F.col("rep").alias("u"), F.col("items").alias("x")), "u").join(sets.select(F.col("rep").alias("c"), F.col("items").alias("y")), "c").select("u", "c", "x", "y")
    star = materialise(star.mapInArrow(_star_check(percent), "u long, c long, ok boolean"), "star")
    links = star.where("ok").select("u", F.col("c").alias("v"))
    roots = connected_components(links)

    # Step 2: families in several components, in blocks.
    family = star.select("c", "u").unionByName(star.select("c", F.col("c").alias("u"))).distinct().join(roots, F.col("u") == F.col("node"), "left").select("c", "u", F.coalesce("root", "u").alias("root"))
    info = strong.groupBy("rep").agg(F.max("n").alias("n"), F.min("uniq").alias("uniq"))
    family = family.join(info, F.col("u") == F.col("rep")).select("c", "u", "root", "n", "uniq")
    open_ = family.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("all")).where("lo <> hi").select("c", F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("all") / BLOCK_SHINGLES)).alias("nb"))
    dealt = family.join(open_, "c").withColumn("block", F.pmod(F.xxhash64("u"), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.select("c", "u", "root", "uniq", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    dealt = dealt.join(sets.select(F.col("rep").alias("u"), "items", "sig"), "u")
    more = dealt.groupBy("c", "bi", "bj").applyInArrow(_family_check(percent, LEAST_EQUAL * 2 * tables * rows // 128), "u long, v long")
    roots = connected_components(links.unionByName(more))

    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("p1", "p2", F.coalesce("root", "rep").alias("root"))
    out = signed.join(named, ["p1", "p2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near-duplicates of a document with a smaller id.

    Rows that repeat id and text stay once. Rows of one id with different texts
    are documents of their own, which count as if their ids came after all
    others; so none goes but for a near-duplicate that stays. Rows without id stay.
    """
    one, two, number = (unused(docs, n) for n in ("_h1", "_h2", "_number"))
    hashes = {one: F.xxhash64(F.lit(1), F.col(text_col), F.col(text_col).isNull()), two: F.xxhash64(F.lit(2), F.col(text_col), F.col(text_col).isNull())}
    named = docs.where(F.col(id_col).isNotNull()).withColumns(hashes)
    versions = materialise(named.groupBy(F.col(id_col).alias("id"), one, two).agg(F.lit(1).alias("x")).drop("x"), "versions")
    several = versions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        # As they were read, so that no step below shuffles texts to look at them.
        numbered = named.withColumn(number, F.col(id_col).cast("long"))
    else:
        stats = versions.agg(F.max("id"), F.count("*")).first()
        new = materialise(join_hot(versions, several, ["id"], "n", stats[1]), "several")
        new = materialise(new.withColumn("m", F.monotonically_increasing_id() + F.lit(stats[0] + 1)), "numbered").select(F.col("id").alias("id_"), F.col(one).alias("one_"), F.col(two).alias("two_"), F.col("m").alias(number))
        once = named.dropDuplicates([id_col, one, two])
        joined = once.join(new, (F.col(id_col) == F.col("id_")) & (F.col(one) == F.col("one_")) & (F.col(two) == F.col("two_")), "left").drop("id_", "one_", "two_")
        numbered = materialise(joined.withColumn(number, F.coalesce(number, F.col(id_col).cast("long"))), "versioned")
    judged = near_duplicates(numbered.select(F.col(number).alias("doc_id"), F.col(text_col).alias("text")), **options)
    gone = judged.where("not kept").select(F.col("doc_id").alias("gone_")).distinct()
    left = numbered.join(gone, F.col(number) == F.col("gone_"), "left_anti").dropDuplicates([number]).select(*docs.columns)
    return left.unionByName(docs.where(F.col(id_col).isNull()))
