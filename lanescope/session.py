"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every lanescope job relies on: UTC dates, AQE for runtime coalescing and skew splits.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # files written by DataFrame.checkpoint() are removed once their plan is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "lanescope", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster use the session you are given."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.driver.memory", "8g"))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised tables and checkpoints.

    On a cluster ``spark.checkpoint.dir`` names shared storage (HDFS/S3/...) and is used as is.
    Only in local mode may it be unset: then we create a private folder and register it with
    ``setCheckpointDir`` so that ``DataFrame.checkpoint()`` works too. On a cluster that is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        if sc.getCheckpointDir() is None:       # DataFrame.checkpoint() writes below it too
            sc.setCheckpointDir(d)
        return d.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = sc.applicationId
    if key not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[key] = tempfile.mkdtemp(prefix="lanescope-ckpt-")
        sc.setCheckpointDir(_LOCAL_ROOTS[key])
    return _LOCAL_ROOTS[key]


#: Shuffle partitions that aggregates start with at most: they move partial rows of few segments.
AGGREGATE_PARTITIONS = 4000


def cluster_conf(total_cores: int, shuffle_bytes: int = 0, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Sizing for a cluster run with ``total_cores`` cores.

    The analyses shuffle partial aggregates, whose size follows the number of segments and not
    the input, so they start with two waves of the cores, ``AGGREGATE_PARTITIONS`` at most: every
    map task writes an index of all partitions. A job that joins or rewrites rows
    names the bytes of its largest shuffle and gets one partition per
    ``target_partition_bytes`` of them. AQE coalesces both at run time to the advisory size. Skewed partitions (a warehouse with a third of the rows) are split by the
    AQE skew-join rule; aggregations are skew-safe through map-side partial aggregation.
    """
    parts = max(min(2 * total_cores, AGGREGATE_PARTITIONS), -(-shuffle_bytes // target_partition_bytes))
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 256 << 20)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
