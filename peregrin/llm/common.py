"""What the operators share: shared storage, Arrow batches and word rules."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Arrow batches sent to Python while an operator works: at most so many rows, and cut after so many bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "400", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: A key with more than one in so many of all rows is hot; there are fewer such keys than this, whatever the input.
HOT_PARTS = 1000
_made: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local one, as in tests, gets a temporary
    folder; any other can't share such a folder and has to name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='peregrin-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches of the jobs run inside, and gives the session its own settings back."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, on whichever file system it lies."""
    jvm, sc = spark._jvm, spark.sparkContext
    if jvm is None or sc._jsc is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            return


atexit.register(_remove_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder, in bounded Arrow batches, and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with short_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing lazy reads it any more."""
    if getattr(df, "_written", None):
        remove(df.sparkSession, df._written)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row per key and how many rows of left have it (count), of total rows.

    Keys with over one in HOT_PARTS of left's rows, of which there are fewer than
    that, are joined where left's rows lie; all others are dealt out by key. The
    count doesn't stay. how: inner or left.
    """
    hot = F.col(count) * HOT_PARTS > F.lit(total)
    hot_keys = right.where(hot).drop(count)
    rest = left.join(F.broadcast(hot_keys.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot_keys), on).unionByName(rest.join(right.where(~hot).drop(count), on, how))


def fixed_sample(rows: DataFrame, columns: list[str], sizes: dict, by: str, seed: int) -> DataFrame:
    """Of each value of `by`, at most the stated number of rows: sizes maps it to (number, rows that it has).

    Rows are taken by a 64-bit hash of the columns named, the smallest first. A
    bound on it, which leaves about twice as many, keeps the window small.
    """
    h = F.xxhash64(F.lit(seed), *columns)
    bound, most = F.lit(None).cast("long"), F.lit(0)
    for k, (want, have) in sizes.items():
        share = min(1.0, (2 * want + 100) / max(1, have))
        bound = F.when(F.col(by) == k, F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).otherwise(bound)
        most = F.when(F.col(by) == k, F.lit(want)).otherwise(most)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h_"))
    return rows.withColumn("h_", h).where(F.col("h_") <= bound).withColumn("rank_", rank).where(F.col("rank_") <= most).drop("h_", "rank_")


def unused(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
