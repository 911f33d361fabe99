"""Structured Streaming: staging CSV files arriving in a folder -> parsed table + live KPIs.

* ``read_staging_stream``: file source with the fixed staging schema (new files only, each
  processed once; the checkpoint records which files were taken).
* ``start_parsed_sink``: row-level cleaning of every micro-batch, appended to a Parquet table
  with the file sink (exactly-once through its commit log). Rejected rows keep their text and
  reason, so the quarantine report is a filter on this table.
* ``start_measures_sink``: a stateful aggregation of the additive KPI measures per segment
  (state = one row per segment, never per shipment), written as a complete snapshot per epoch by
  ``foreachBatch``; ``read_snapshot`` takes the newest whole one. The cost mean cannot be known while data is still arriving, so the stream
  keeps ``n_cost``/``sum_cost`` of the known costs and ``kpis_from_measures`` applies the mean
  fill at read time; because the fill is linear, the result equals the batch clean+impute.

All checkpoints belong in the shared folder (``spark.checkpoint.dir``) so a restarted driver or
lost executor resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kpi import MEASURE_NAMES, MONEY, SUM_COST, ratio, rollup_measure
from ..operators import clean as C
from ..operators.segment import finalize, measures
from ..sources import store
from ..sources.files import QUOTES
from ..sources.schema import STAGING_SCHEMA


def read_staging_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(STAGING_SCHEMA).option("header", True).options(**QUOTES)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(path)


def start_parsed_sink(staging_stream: DataFrame, table_path: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    parsed = C.parse_staging(staging_stream, "quarantine", keep_raw=True)
    w = (parsed.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def measures_stream(parsed_stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive measures of the accepted rows per segment, before the cost fill."""
    return measures(C.accepted(parsed_stream), keys, extra=MEASURE_NAMES)


def start_measures_sink(parsed_stream: DataFrame, keys: Sequence[str], table_path: str,
                        checkpoint: str, available_now: bool = True) -> StreamingQuery:
    def write_snapshot(batch: DataFrame, epoch: int) -> None:
        # a folder of its own for each epoch: readers never see a snapshot that is being replaced, and a batch that
        # runs again after a failure writes the same rows to the same folder
        batch.write.mode("overwrite").parquet(f"{table_path}/epoch-{epoch:012d}")

    w = (measures_stream(parsed_stream, keys).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(write_snapshot))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_snapshot(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest complete snapshot of ``start_measures_sink``."""
    done = store.found(spark, f"{table_path}/epoch-*/_SUCCESS")
    if not done:
        raise FileNotFoundError(f"no complete snapshot below {table_path}")
    return spark.read.parquet(max(done).rsplit("/", 1)[0])


def kpis_from_measures(m: DataFrame, keys: Sequence[str], kpis: Sequence[str],
                       count_name: str = "shipments") -> DataFrame:
    """Rounded KPIs from streamed measures, with missing costs filled by the overall mean of
    the known costs (rounded to cents), exactly as the batch cleaning does."""
    overall = m.agg(rollup_measure("sum_cost").alias("s"), rollup_measure("n_cost").alias("c"))
    mean = overall.select(ratio(F.col("s"), F.col("c")).cast(MONEY).alias("mean")).scalar()
    missing = F.col("n") - F.col("n_cost")
    filled = m.withColumn("sum_cost", (F.coalesce(F.col("sum_cost"), F.lit(0))
                                       + F.when(missing > 0, missing * mean).otherwise(0)).cast(SUM_COST))
    filled = filled.withColumn("n_cost", F.when(mean.isNotNull(), F.col("n")).otherwise(F.col("n_cost")))
    return finalize(filled, keys, kpis, count_name)


def stream_segment_kpis(spark: SparkSession, staging_dir: str, work_dir: str, keys: Sequence[str],
                        kpis: Sequence[str], count_name: str = "shipments",
                        max_files_per_trigger: int = 1) -> DataFrame:
    """Run the measures stream over every file now in ``staging_dir`` (several micro-batches,
    ``availableNow``), then return KPIs from the snapshot it maintains in ``work_dir``."""
    snapshot, ckpt = f"{work_dir}/measures", f"{work_dir}/_checkpoint"
    parsed = C.parse_staging(read_staging_stream(spark, staging_dir, max_files_per_trigger), "quarantine")
    q = start_measures_sink(parsed, keys, snapshot, ckpt, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"measures stream failed: {q.exception()}")
    return kpis_from_measures(read_snapshot(spark, snapshot), keys, kpis, count_name)


def write_staging_files(staging: DataFrame, path: str) -> None:
    """Write staging rows as header CSV files, keeping padding spaces as they are."""
    (staging.write.mode("overwrite").option("header", True).options(**QUOTES)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
