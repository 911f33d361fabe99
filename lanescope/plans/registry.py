"""Registry of runnable queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables of ``sf_dir`` through the adapter, or the clean table that
Spark derives from them once (``log_data_for``). Decimal results are cast to DOUBLE at the edge
only (all arithmetic before that is exact decimal).

Parameters that name entities of the analysed project's own data (focus warehouses, drill
pairs) are derived from the data instead, the way the analysis chose them: the focus is the
top three of the priority scorecard, the cost / delay drill pairs are the top warehouse with its
most expensive / most delayed carrier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..fixed_values import DELAYED, FOCUS_K, HIGH_VOLUME_GATE
from ..operators import clean as C
from ..operators import quality as Q
from ..sources import store
from ..sources.schema import CLEAN_COLUMNS, STAGING_COLUMNS
from ..sources.tpch_adapter import DRIVER_TABLES, shipment_facts, staging_from_facts, staging_from_tpch
from . import analyses as A


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in DRIVER_TABLES]


def staging_for(spark: SparkSession, sf_dir: str, **variant) -> DataFrame:
    """Staging rows: the driver tables joined, one row per lineitem. Not stored: the parsed table is the one copy."""
    return staging_from_tpch(spark, sf_dir, **variant)


@contextmanager
def staged(spark: SparkSession, sf_dir: str, **variant) -> Iterator[DataFrame]:
    """Staging rows for one build, over a scratch copy of the typed join that is deleted after it: join and text in one
    stage make one generated method that is too large for the JVM's compiler."""
    path = store.scratch(spark, "facts")
    facts = shipment_facts(spark, sf_dir)
    try:
        facts.write.parquet(path)
        yield staging_from_facts(spark.read.schema(facts.schema).parquet(path), **variant)
    finally:
        store.remove(spark, path)


def parsed_for(spark: SparkSession, sf_dir: str, **variant) -> DataFrame:
    """Parsed staging rows (typed columns, reject reason, raw text of rejected rows),
    materialised once per input and adapter variant: the first, lineage-cutting step."""
    tag = "".join(f"-{k}{v}" for k, v in sorted(variant.items()))
    key = store.fingerprint(spark, _inputs(sf_dir), "parsed" + tag)
    with ExitStack() as scratch:
        return store.materialize(
            spark, lambda: C.parse_staging(scratch.enter_context(staged(spark, sf_dir, **variant)), keep_raw=True),
            "parsed" + tag, key)


_LOG_DATA: dict[tuple[str, str], DataFrame] = {}


def log_data_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean, imputed shipment table for ``sf_dir``: accepted rows of the stored parsed table
    with missing costs filled by the mean of the known costs.

    Only the mean (one value) is stored beside the parsed table; the clean table is a read-time
    projection of it, so the data is written once. Queries read only the columns they use and
    the ``reject_reason IS NULL`` filter is pushed into the Parquet scan."""
    key = store.fingerprint(spark, _inputs(sf_dir), "log_data")
    memo = (spark.sparkContext.applicationId, key)
    if memo not in _LOG_DATA:
        _LOG_DATA[memo] = _filled(spark, parsed_for(spark, sf_dir), key)
    return _LOG_DATA[memo]


def _filled(spark: SparkSession, parsed: DataFrame, key: str) -> DataFrame:
    mean = store.materialize_value(spark, lambda: C.mean_cost(C.accepted(parsed)), "cost_mean", key, "mean_cost")
    return C.fill_cost(C.accepted(parsed), mean)


def log_data_from_csv(spark: SparkSession, path: str, mode: str = "quarantine", multi_line: bool = False, unique: bool = False,
                      date_format: str | None = None) -> DataFrame:
    """The clean, imputed table of staging CSV files, parsed and stored once per state of the files: every
    analysis reads that table."""
    from ..sources import files

    key = store.fingerprint(spark, [path], "csv", mode, str(multi_line), str(unique), str(date_format))

    def build():
        staging = files.read_staging_csv(spark, path, strict=mode == "strict", multi_line=multi_line)
        parsed = C.parse_staging(staging, mode, keep_raw=True, date_format=date_format)
        return C.enforce_key(store.cut(parsed, "csv-parsed"), mode) if unique else parsed

    return _filled(spark, store.materialize(spark, build, "csv", key), f"csv-{key}")


def edge(df: DataFrame) -> DataFrame:
    """Cast DECIMAL columns to DOUBLE for the consumer (charts, CSV, oracle comparison)."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _on_log(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edge(fn(log_data_for(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def _on_parsed(fn: Callable[[DataFrame], DataFrame], **variant) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edge(fn(parsed_for(spark, sf_dir, **variant)))
    run.__doc__ = fn.__doc__
    return run


STREAM_FILES_PER_TRIGGER = 4    # landing files per micro-batch (several batches share the state)
STREAM_KPIS = ("cost_per_unit", "cost_per_kg", "avg_transit_days", "delivered_rate", "delay_rate",
               "lost_rate", "returned_rate")


def stream_warehouse_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse KPIs maintained by Structured Streaming from staging CSV files.

    Spark writes the adapter's staging rows as CSV files into the shared folder (the input
    "arriving" in a landing folder); a stateful streaming aggregation keeps the measures per
    warehouse across micro-batches (``STREAM_FILES_PER_TRIGGER`` files each); KPIs are read
    from its snapshot, with the cost mean applied at read time."""
    from ..streaming import ingest

    key = store.fingerprint(spark, _inputs(sf_dir), "stream", ingest.__file__)
    root = f"{store.checkpoint_root(spark)}/lanescope/stream-{key}"
    src = f"{root}/landing"
    if not store.path_exists(spark, f"{src}/_SUCCESS"):
        with staged(spark, sf_dir) as staging:
            ingest.write_staging_files(staging, src)
    run = f"{root}/run-{store.run_id()}"
    return edge(ingest.stream_segment_kpis(spark, src, run, [A.WH], STREAM_KPIS, "shipment_count",
                                           max_files_per_trigger=STREAM_FILES_PER_TRIGGER))


def delay_pareto(log: DataFrame) -> DataFrame:
    """Per carrier: delayed shipments by lane, largest first, with the cumulative share."""
    delayed = (log.where(F.col("status") == DELAYED)
               .groupBy(A.CARRIER, A.WH, A.DEST).agg(F.count(F.lit(1)).alias("delayed")))
    return Q.pareto(delayed, [A.CARRIER], [A.WH, A.DEST], "delayed")


def monthly_delay_change(log: DataFrame) -> DataFrame:
    """Per warehouse and calendar month between its first and last: delay / delivered share and the change from the
    month before; a month without shipments has no share, nor has the month after it a change (X3)."""
    seg = A.segment(log, [A.month_of().alias("month"), A.WH], ["delay_rate", "delivered_rate"],
                    count_name="shipment_count")
    full = Q.change_over_previous(seg, [A.WH], "month", ["delay_rate", "delivered_rate"])
    return full.withColumn("shipment_count", F.coalesce("shipment_count", F.lit(0)))


def unique_shipments(parsed: DataFrame) -> DataFrame:
    """Accepted rows with the key enforced (CL-8, D-7)."""
    return C.accepted(C.enforce_key(parsed))


def key_quarantine(parsed: DataFrame) -> DataFrame:
    """Rows that the key sets aside, with the reason (CL-8, D-7)."""
    out = C.enforce_key(parsed).where(F.col("reject_reason").isin(C.REPEATED_ID, C.MISSING_ID))
    return out.select(*CLEAN_COLUMNS, "reject_reason")


#: Literal parameters, as an analyst writes them: their filters reach the scan.
LITERAL_FOCUS = ("NATION_1", "NATION_2", "NATION_3")
BENCHMARK_WAREHOUSE = "NATION_4"


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warehouse KPI table exported as CSV into the shared folder and read back (SNK-2, SRC-5)."""
    from ..sources import files

    kpi = edge(A.warehouse_kpi(log_data_for(spark, sf_dir)))
    path = store.scratch(spark, "export")
    files.export_csv(kpi, path, single_file=True)
    return files.read_result_csv(spark, path, kpi.schema)


def view_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the published views counted by SQL (SNK-3)."""
    from ..sources import files

    log, issues = files.publish_views(spark, log_data_for(spark, sf_dir), prefix="registered_")
    return spark.sql(f"""SELECT status, count(*) AS rows, 'log_data' AS view_name FROM {log} GROUP BY status
                         UNION ALL SELECT status, count(*), 'v_data_issues' FROM {issues} GROUP BY status""")


def flagged_warehouses(log: DataFrame) -> DataFrame:
    """Warehouses with at least one flag and enough volume."""
    return (A.warehouse_scorecard(log)
            .where((F.col("flag_count") > 0) & (F.col("shipment_count") >= HIGH_VOLUME_GATE)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # cleaning and data quality
    "clean_shipments": _on_parsed(C.accepted),
    "impute_cost": _on_log(lambda log: log),
    "quarantine_rows": _on_parsed(C.rejected),
    "duplicate_ids": _on_parsed(lambda p: C.duplicate_ids(C.accepted(p))),
    "missing_profile": _on_parsed(lambda p: Q.missing_profile_from_mask(p, STAGING_COLUMNS)),
    "data_issues": _on_log(C.data_issues),
    "unique_shipments": _on_parsed(unique_shipments),
    "key_quarantine": _on_parsed(key_quarantine),
    "csv_round_trip": csv_round_trip,
    "view_status_counts": view_status_counts,
    "preview": _on_log(lambda log: A.preview(log, ordered=True)),
    "iqr_outliers": _on_log(Q.iqr_outliers),
    "outlier_sources": _on_log(Q.outlier_sources),
    # overview and benchmark
    "overview": _on_log(A.overview),
    "overview_wide": _on_log(A.overview_wide),
    "overall_kpi": _on_log(A.overall_kpi),
    "overall_kpi_wide": _on_log(A.overall_kpi_wide),
    # time trends
    "avg_daily_shipments": _on_log(A.avg_daily_shipments),
    "monthly_volume": _on_log(A.monthly_volume),
    "monthly_delivered": _on_log(A.monthly_delivered),
    "monthly_returned": _on_log(A.monthly_returned),
    "monthly_cost": _on_log(A.monthly_cost),
    "monthly_transit": _on_log(A.monthly_transit),
    "warehouse_monthly": _on_log(lambda log: A.warehouse_monthly(log, FOCUS_K)),
    "carrier_monthly": _on_log(A.carrier_monthly),
    "monthly_delay_change": _on_log(monthly_delay_change),
    # warehouses
    "warehouse_kpi": _on_log(A.warehouse_kpi),
    "warehouse_scorecard": _on_log(A.warehouse_scorecard),
    "warehouse_scorecard_wide": _on_log(A.warehouse_scorecard_wide),
    "flagged_warehouses": _on_log(flagged_warehouses),
    "decision_scorecard": _on_log(A.decision_scorecard),
    "top_warehouses": _on_log(A.top_warehouses),
    # carriers
    "focus_warehouse_carrier": _on_log(lambda log: A.focus_warehouse_carrier(log, FOCUS_K)),
    "literal_focus_carrier": _on_log(lambda log: A.focus_warehouse_carrier(log, LITERAL_FOCUS)),
    "carrier_vs_warehouse": _on_log(A.carrier_vs_warehouse),
    "carrier_vs_one_warehouse": _on_log(lambda log: A.carrier_vs_warehouse(log, [BENCHMARK_WAREHOUSE])),
    "carrier_positioning": _on_log(A.carrier_positioning),
    "carrier_tradeoff": _on_log(A.carrier_tradeoff),
    "variability": _on_log(A.variability),
    "delay_pareto": _on_log(delay_pareto),
    "stream_warehouse_kpi": stream_warehouse_kpi,
    # destinations and lanes
    "destination_cost_drill": _on_log(lambda log: A.destination_cost_drill(log, "cost_per_unit")),
    "destination_delay_drill": _on_log(lambda log: A.destination_delay_drill(log, "delay_rate")),
    "focus_lanes": _on_log(lambda log: A.focus_lanes(log, FOCUS_K)),
    "lane_delivered": _on_log(A.lane_delivered),
    "worst_lanes": _on_log(A.worst_lanes),
    "worst_lanes_wide": _on_log(lambda log: A.worst_lanes(log, with_lost_rate=True)),
    "top_lanes": _on_log(A.top_lanes),
    # shipment profile buckets
    "weight_buckets": _on_log(A.weight_buckets),
    "cost_buckets": _on_log(A.cost_buckets),
    "distance_buckets": _on_log(A.distance_buckets),
}

#: Analyses over the clean table by report name, for the command line and the SQL views.
REPORTS = {**A.LOG_ANALYSES, "delay_pareto": delay_pareto, "monthly_delay_change": monthly_delay_change,
           "flagged_warehouses": flagged_warehouses}
