"""Helpers shared by the operators: tables in the shared folder, checked broadcasts, broadcasts of files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Joins against a side of at most so many narrow rows (a few longs each) are broadcast joins.
BROADCAST_ROWS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, so an
    executor lost later never re-runs what came before."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan refers to any more; else they stay until the
    driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored, narrow table) marked for a broadcast join if its counted rows are within
    ``limit``, else as it is: the planner then joins by shuffle. The result is the same."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("merge")


def text_file(path: str) -> str:
    """A vocabulary file (a few MB), read on the driver; executors get it by a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def binary_file(path: str) -> bytes:
    """A model file (a few MB), read on the driver; executors get it by a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def importable(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package where it lies on a path that
    they see too (as in local mode). On a cluster it comes with ``--py-files``."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` to the shared folder and let every executor, also later ones, fetch it.
    Returns the name under which ``SparkFiles.get`` finds the local copy."""
    sc = spark.sparkContext
    folder = shared_path(spark, name)
    file = f"{folder}/{folder.rsplit('/', 1)[1]}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    sc.addFile(file)
    return file.rsplit("/", 1)[1]


def slices(batches, rows: int):
    """Arrow batches cut to at most ``rows`` rows, which bounds what one step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
