"""Session factory for local runs, tests and the benchmark."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def get_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session in UTC with AQE; a cluster brings its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("peregrin")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a constant as a table that the plan holds itself, so that no Python worker has to read it."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow), schema)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its few files would keep most of them idle; large inputs stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """df by a checkpoint, so that what follows neither plans nor runs its lineage again.

    It lies in the folder of spark.checkpoint.dir; a temporary one only where none is set, as in tests.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="peregrin-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path beside the checkpoints for a table that is written and read again; deleted when the driver ends."""
    path = f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
