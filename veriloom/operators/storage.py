"""Cutting lineage by checkpoints and tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAVED: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where that is unset, a session on one machine takes a temporary folder; a cluster, whose machines share none, is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="veriloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read back from a checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of its own in the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/veriloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """What files a folder of tables holds: their number, and a sum over their paths, sizes and times of change; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir)
    return tuple(files.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first())


def saved(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage's output that later stages read: written once for each application and state of the input, and read back.

    A table that was replaced, grown or touched since makes another state.  ``forget`` deletes what was written.
    """
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir), name)
    if key not in _SAVED:
        path = f"{folder(spark)}/veriloom/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _SAVED[key] = path
    return spark.read.parquet(_SAVED[key])


def forget(spark: SparkSession, sf_dir: str | None = None) -> int:
    """Delete the saved tables of this application, or only those of one input; queries that still read them must have run."""
    mine = [k for k in _SAVED if k[0] == spark.sparkContext.applicationId and sf_dir in (None, k[1])]
    for key in mine:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SAVED.pop(key))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(mine)
