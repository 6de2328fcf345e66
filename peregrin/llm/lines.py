"""Line dedup across sites: lines that stand on many distinct sites are boilerplate.

Lines are known by 128 bits of hash. One aggregation gives each line hash a HyperLogLog
sketch of its sites; sketches merge, so the state of a line on every site stays
small and hot lines combine before the shuffle. Estimates within `band` of the
threshold are replaced by exact distinct counts of those lines only. A line on
at least `least_sites` sites then goes from every document but the first that
has it, so that no text is lost altogether.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, materialise

LEAST_SITES = 10
#: Six standard deviations of the sketch (2^12 registers).
BAND = 0.1
LG_K = 12


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    trimmed = F.trim("line")
    return lines.where(trimmed != "").select("id", "version", "site", F.col("pos").cast("long").alias("pos"), F.xxhash64(trimmed, F.length(trimmed)).alias("h"), F.xxhash64(F.lit("line"), trimmed).alias("g"))


def spread_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES, band: float = BAND) -> tuple[DataFrame, int]:
    """h, g, k: the hashes of lines that stand on at least least_sites distinct sites, and how often; and how many occurrences all lines of so many have.

    Blank lines and null sites don't count. No task gets all occurrences of a
    line that makes up over a thousandth of these.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    sketches = lines.groupBy("h", "g").agg(F.count("*").alias("k"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("s")).where(F.col("k") >= least_sites)
    guess = materialise(sketches.select("h", "g", "k", F.hll_sketch_estimate("s").alias("sites")), "sketches")
    total = guess.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    near = guess.where(F.col("sites").between(least_sites * (1 - band), least_sites * (1 + band))).select("h", "g", "k")
    exact = join_hot(lines.select("h", "g", "site"), near, ["h", "g"], "k", total).distinct().groupBy("h", "g").agg(F.count("site").alias("sites"))
    exact = near.join(exact.where(F.col("sites") >= least_sites), ["h", "g"], "left_semi")
    return guess.where(F.col("sites") > least_sites * (1 + band)).select("h", "g", "k").unionByName(exact), total


def removable(docs: DataFrame, **options) -> DataFrame:
    """id, version (hash of the text), gone: the line numbers that go, for documents that lose any."""
    columns = {k: options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("site_col", "source"))}
    lines = _lines(docs, **columns)
    spread, total = spread_lines(docs, **options)
    found = materialise(join_hot(lines, materialise(spread, "spread"), ["h", "g"], "k", total).select("h", "g", "id", "version", "pos"), "found")
    first = materialise(found.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("k")), "first")
    return join_hot(found, first, ["h", "g"], "k", found.count()).where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))


def _strip(batches):
    for batch in batches:
        at = batch.schema.names.index("text")
        kept, removed = [], []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.schema.names.index("_gone")).to_pylist(), strict=True):
            if gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            kept.append(text)
            removed.append(len(gone or ()))
        arrays = [pa.array(kept, pa.string()) if n == "text" else pa.array(removed, pa.int64()) if n == "removed" else batch.column(i) for i, n in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def strip_lines(docs: DataFrame, *, keep: tuple[str, ...], **options) -> DataFrame:
    """The columns named in keep as k0, k1, ..., then text (without boilerplate lines) and removed (lines).

    A spread line stays in the document with the smallest id that has it. A null
    text stays null and has no lines; a row without id never counts as first,
    and loses its spread lines if some row with an id has them. Rows that repeat
    an id and text are treated alike. An empty table gives no rows.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = removable(docs, **options)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("version")), "left")
    rows = rows.select(*names, "text", F.col("gone").alias("_gone"), F.lit(0).cast("long").alias("removed"))
    return materialise(rows.mapInArrow(_strip, rows.schema), "stripped").drop("_gone")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_removed, kept_lines, kept_sha256 per document."""
    out = strip_lines(docs, keep=(options.get("id_col", "doc_id"),), **options)
    return out.select(F.col("k0").alias("doc_id"), F.col("removed").alias("n_removed"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("kept_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_spread_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with their texts stripped (and n_chars anew); a document that loses its every word goes.

    Every line of such a document stands in documents with smaller ids, which keep it.
    """
    text_col = options.get("text_col", "text")
    kept = [c for c in docs.columns if c != text_col]
    out = strip_lines(docs, keep=tuple(kept), **options).where((F.col("removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    now = {c: F.col(f"k{i}") for i, c in enumerate(kept)} | {text_col: F.col("text")}
    if "n_chars" in now:
        now["n_chars"] = F.when(F.col("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(now["n_chars"])
    return out.select(*(now[c].alias(c) for c in docs.columns))
