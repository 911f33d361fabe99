"""Compare segments with a benchmark: deltas, threshold flags, scores and labels.

A benchmark is either one row (overall KPIs, medians, averages over segments) or one row per
coarser key (a warehouse as benchmark for its carriers).

* One-row benchmarks are bound as ONE scalar subquery returning a struct
  (``DataFrame.scalar()``): Spark runs it once, ships a single value to the tasks and the
  projection reads its fields. No join is planned and no rows are paired.
* Keyed benchmarks are an equi-join on the benchmark keys; Spark broadcasts the benchmark side
  only when its statistics are under the broadcast threshold, else it shuffle-joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import FAST_CHEAP, FAST_EXPENSIVE, MEDIAN, SLOW_CHEAP, SLOW_EXPENSIVE
from ..functions.kpi import ratio


def attach(df: DataFrame, one_row: DataFrame, alias: str = "_bench") -> tuple[DataFrame, dict[str, Column]]:
    """Bind a one-row frame (a global aggregate) to every row of ``df`` as a struct column.

    Returns the widened frame and a mapping column name -> field expression. The value is a
    single scalar subquery, evaluated once per query (callers select the fields they need,
    so the struct column itself never reaches the output).
    """
    value = one_row.select(F.struct(*one_row.columns).alias(alias)).scalar()
    return df.withColumn(alias, value), {c: F.col(alias).getField(c) for c in one_row.columns}


def delta_pp(seg: Column, bench: Column) -> Column:
    """Difference in percentage points / days: ``ROUND(seg - bench, 2)``."""
    return F.round(seg - bench, 2)


def delta_pct(seg: Column, bench: Column) -> Column:
    """Relative difference in %: ``ROUND((seg - bench) / NULLIF(bench, 0) * 100, 2)``."""
    return F.round(ratio(seg - bench, bench) * 100, 2)


def flag(cond: Column) -> Column:
    """1 when the condition holds, else 0 (a NULL condition is 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


@dataclass(frozen=True)
class Rule:
    """A delta column and/or a flag on one KPI compared with its benchmark.

    kind ``pp``  : delta = seg - bench (points / days); flag when the *unrounded* difference
                   is ``<= threshold`` (``direction="le"``) or ``>= threshold`` (``"ge"``).
    kind ``pct`` : delta = relative difference in %; flag when ``(seg - bench)/bench`` (a ratio,
                   not %) is ``>= threshold``.
    """
    kpi: str
    kind: str
    delta: str | None = None
    flag: str | None = None
    threshold: float | None = None
    direction: str = "ge"

    def delta_col(self, seg: Column, bench: Column) -> Column:
        return delta_pp(seg, bench) if self.kind == "pp" else delta_pct(seg, bench)

    def flag_col(self, seg: Column, bench: Column) -> Column:
        t = F.lit(self.threshold).cast("decimal(10,4)")
        diff = (seg - bench) if self.kind == "pp" else ratio(seg - bench, bench)
        return flag(diff <= t if self.direction == "le" else diff >= t)


def versus(seg: DataFrame, bench: DataFrame, rules: Sequence[Rule], *,
           on: Sequence[str] = (), bench_prefix: str = "b_", flag_count: str | None = None,
           priority: tuple[str, str] | None = None) -> DataFrame:
    """Append delta and flag columns of ``seg`` against the benchmark KPIs in ``bench``.

    Without ``on``, ``bench`` is one row (bound with ``attach``). With ``on``, it holds one row
    per key of ``on`` and is equi-joined to the segments. ``flag_count`` adds the number of
    raised flags and ``priority=(volume column, name)`` adds volume x flag count, in the same
    projection.
    """
    kp = sorted({r.kpi for r in rules})
    if on:
        b = bench.select(*on, *[F.col(k).alias(bench_prefix + k) for k in kp])
        joined = seg.join(b, list(on))
        bcol = {k: F.col(bench_prefix + k) for k in kp}
    else:
        # bind the whole benchmark row: when it is a roll-up of the segment aggregate, both
        # then need the same measures and Spark reuses the segment shuffle for the subquery
        joined, bcol = attach(seg, bench)
    cols = [F.col(c) for c in seg.columns]
    flags: list[Column] = []
    for r in rules:
        s, b = F.col(r.kpi), bcol[r.kpi]
        if r.delta:
            cols.append(r.delta_col(s, b).alias(r.delta))
        if r.flag:
            f = r.flag_col(s, b)
            flags.append(f)
            cols.append(f.alias(r.flag))
    if flag_count:
        total = F.lit(0)
        for f in flags:
            total = total + f
        total = total.cast("int")
        cols.append(total.alias(flag_count))
        if priority:
            cols.append((F.col(priority[0]) * total).cast("bigint").alias(priority[1]))
    return joined.select(*cols)


def flag_sum(names: Sequence[str]) -> Column:
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return total.cast("int")


# --------------------------------------------------------------------------------------
# Positioning against medians (2x2) and ratio-to-average scores.
# --------------------------------------------------------------------------------------



def medians(seg: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: exact median (linear interpolation) of each column over the segment rows.

    The input is a segment table (one row per segment, already gated), so the exact
    ``percentile`` aggregate holds one value per segment, not per shipment. Spark interpolates
    as ``(1-f)·lo + f·hi``; SQL's ``lo + f·(hi-lo)`` may differ in the last bit for an even
    number of segments, which cannot change a comparison against a segment's own value (the
    2x2 labels). For the SQL value itself use ``operators.quantile.exact_percentiles``.
    """
    return seg.agg(*[F.percentile(F.col(c).cast("double"), MEDIAN).alias(f"med_{c}") for c in cols])


def position_2x2(cost: Column, days: Column, med_cost: Column, med_days: Column) -> Column:
    """First match wins; ties go to CHEAP and SLOW, a NULL comparison falls to the last label."""
    fast = days < med_days
    return (F.when((cost > med_cost) & fast, F.lit(FAST_EXPENSIVE))
            .when((cost <= med_cost) & fast, F.lit(FAST_CHEAP))
            .when((cost > med_cost) & (days >= med_days), F.lit(SLOW_EXPENSIVE))
            .otherwise(F.lit(SLOW_CHEAP)))


def averages(seg: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: unweighted mean of each KPI over segments, kept exact (SUM/COUNT in decimal)."""
    return seg.agg(*[ratio(F.sum(c), F.count(c)).alias(f"avg_{c}") for c in cols])


def ratio_score(terms: Sequence[tuple[Column, Column]]) -> Column:
    """``ROUND(sum(value / NULLIF(benchmark, 0)), 2)``; any zero benchmark makes it NULL."""
    total = None
    for v, b in terms:
        t = ratio(v, b)
        total = t if total is None else total + t
    return F.round(total, 2)
