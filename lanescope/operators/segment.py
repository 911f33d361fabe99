"""Segment KPIs: group by any keys, aggregate additive measures, derive rounded KPIs.

Nearly every named analysis is *keys × KPI columns × filter × volume gate × order*::

    segment(log, ["origin_warehouse", "destination"],
            ["cost_per_unit", "delay_rate"], min_volume=20, order=[...])

Plan shape: Parquet scan (filters pushed down, only the needed columns read) -> partial
HashAggregate -> hash Exchange on the keys -> final HashAggregate -> Filter (gate) -> Project.
Partial aggregation runs before the shuffle, so a hot key (a third of all rows in one
warehouse) sends one partial row per task, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kpi import MEASURE_NAMES, kpi, measure, needed_measures, rollup_measure

KpiSpec = str | tuple[str, str]   # KPI name, or (KPI name, output column name)


def _split(spec: KpiSpec) -> tuple[str, str]:
    return (spec, spec) if isinstance(spec, str) else spec


def _key_cols(keys: Iterable[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def key_names(df: DataFrame, keys: Sequence[str | Column]) -> list[str]:
    return [k if isinstance(k, str) else df.select(k).columns[0] for k in keys]


def measures(df: DataFrame, keys: Sequence[str | Column] = (), kpis: Sequence[KpiSpec] = (),
             extra: Sequence[str] = (), extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """One row per key combination with the additive measures the KPIs need (plus any
    ``extra_aggs`` computed in the same aggregation)."""
    names = needed_measures([_split(s)[0] for s in kpis])
    for e in extra:
        if e not in names:
            names.append(e)
    if "n" not in names:
        names.insert(0, "n")
    aggs = [measure(m).alias(m) for m in names] + list(extra_aggs)
    return df.groupBy(*_key_cols(keys)).agg(*aggs) if keys else df.agg(*aggs)


def rollup(m: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Re-aggregate measure rows to coarser keys (``()`` = overall). Exact: only sums and
    counts are added, never rounded KPIs."""
    aggs = [rollup_measure(c).alias(c) for c in m.columns if c in MEASURE_NAMES]
    return m.groupBy(*keys).agg(*aggs) if keys else m.agg(*aggs)


def finalize(m: DataFrame, keys: Sequence[str], kpis: Sequence[KpiSpec],
             count_name: str | None = "shipments", keep: Sequence[str] = ()) -> DataFrame:
    cols: list[Column] = [F.col(k) for k in keys] + [F.col(k) for k in keep]
    if count_name:
        cols.append(F.col("n").alias(count_name))
    for spec in kpis:
        name, alias = _split(spec)
        cols.append(kpi(name).alias(alias))
    return m.select(*cols)


def segment(df: DataFrame, keys: Sequence[str | Column], kpis: Sequence[KpiSpec], *,
            where: Column | None = None, min_volume: int | None = None,
            count_name: str | None = "shipments", order: Sequence[Column] | None = None) -> DataFrame:
    """KPI table for the segments ``keys`` (``HAVING COUNT(*) >= min_volume`` when given)."""
    src = df.where(where) if where is not None else df
    m = measures(src, keys, kpis)
    if min_volume is not None:
        m = m.where(F.col("n") >= F.lit(min_volume))
    out = finalize(m, key_names(src, keys), kpis, count_name)
    return out.orderBy(*order) if order else out
