"""Data-quality and outlier operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .benchmark import attach
from .quantile import exact_percentiles

from ..fixed_values import IQR_FENCE, Q1, Q3


def iqr_bounds(df: DataFrame, col: str = "cost", fence: float = IQR_FENCE,
               approx_accuracy: int | None = None) -> DataFrame:
    """One row: quartiles of ``col`` (as DOUBLE) and the fence step.

    Exact ``PERCENTILE_CONT`` by default; ``approx_accuracy=a`` is an explicit opt-in to
    ``percentile_approx`` (one pass, rank error at most n/a, no interpolation)."""
    if approx_accuracy:
        q = df.select(F.percentile_approx(F.col(col).cast("double"), [Q1, Q3], approx_accuracy).alias("qs")) \
              .select(F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("q3"))
    else:
        q = exact_percentiles(df, col, {"q1": Q1, "q3": Q3})
    return q.select("q1", "q3", ((F.col("q3") - F.col("q1")) * F.lit(fence)).alias("step"))


def iqr_outliers(df: DataFrame, col: str = "cost", fence: float = IQR_FENCE,
                 approx_accuracy: int | None = None) -> DataFrame:
    """Rows strictly outside ``[q1 - step, q3 + step]`` with the bounds appended.

    The bounds are one row bound as a scalar subquery, so the filter is a plain predicate on
    each row of the scan.
    """
    b = iqr_bounds(df, col, fence, approx_accuracy)
    wide, k = attach(df, b)
    v = F.col(col).cast("double")
    return (wide.select(*[F.col(c) for c in df.columns], k["q1"].alias("q1"), k["q3"].alias("q3"),
                        k["step"].alias("step"))
            .where((v > F.col("q3") + F.col("step")) | (v < F.col("q1") - F.col("step"))))


def outlier_sources(df: DataFrame, keys: Sequence[str] = ("origin_warehouse", "carrier"),
                    col: str = "cost") -> DataFrame:
    """Which segments produce the IQR outliers: outliers, shipments and outlier share in %."""
    b = iqr_bounds(df, col)
    wide, k = attach(df, b)
    v = F.col(col).cast("double")
    is_out = (v > k["q3"] + k["step"]) | (v < k["q1"] - k["step"])
    return (wide.groupBy(*keys)
            .agg(F.count_if(is_out).alias("outliers"), F.count(F.lit(1)).alias("shipments"))
            .where(F.col("outliers") > 0)
            .withColumn("outlier_pct",
                        F.round((F.col("outliers") * 100).cast("decimal(22,0)") / F.col("shipments"), 2)
                        .cast("decimal(5,2)")))


def missing_profile(staging: DataFrame) -> DataFrame:
    """Blank or NULL count per staging column, one row per column."""
    counts = staging.agg(*[F.count_if(F.nullif(F.trim(F.col(c)), F.lit("")).isNull()).alias(c)
                           for c in staging.columns])
    return counts.unpivot([], list(staging.columns), "column_name", "missing")


def missing_profile_from_mask(parsed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Same profile as ``missing_profile`` from the ``blank_mask`` recorded while parsing:
    one pass over a single int column instead of the raw text (X1)."""
    counts = parsed.agg(*[F.sum(F.shiftright("blank_mask", i).bitwiseAND(1)).cast("bigint").alias(c)
                          for i, c in enumerate(columns)])
    return counts.unpivot([], list(columns), "column_name", "missing")


def pareto(seg: DataFrame, group: Sequence[str], item: Sequence[str], value: str,
           share_name: str = "cum_share_pct") -> DataFrame:
    """Cumulative share of ``value`` over the items of each group, largest first, ties by item.

    ``seg`` is already aggregated (one row per group x item; ``value`` a count). The running sums are prefix sums by
    steps, so the items of one group spread over tasks: over the group's distinct values (n shipments have fewer than
    sqrt(2n) different counts), then, among equal values, over the first item column, and last over the items that share
    both. Every step adds up its rows before the next coarser one sees them.
    """
    group, head, rest = list(group), item[0], list(item[1:])
    value_first = [F.col(value).desc()]

    def before(rows: DataFrame, keys: list[str], order: list[Column], at: str) -> DataFrame:
        """Rows and their sum that come before each row of ``rows`` inside its keys."""
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        none = F.lit(0).cast("bigint")
        return rows.withColumns({f"{at}_n": F.coalesce(F.sum("_n").over(w), none), f"{at}_sum": F.coalesce(F.sum("_sum").over(w), none)})

    sums = [F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum")]
    heads = seg.groupBy(*group, value, head).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    values = heads.groupBy(*group, value).agg(*sums)
    totals = values.groupBy(*group).agg(F.sum("_sum").alias("_total"))
    values = _same(before(values, group, value_first, "_v").drop("_n", "_sum"), totals, group)
    heads = _same(before(heads, [*group, value], [F.col(head).asc()], "_h").drop("_n", "_sum"), values, [*group, value])
    own = Window.partitionBy(*group, value, head).orderBy(*[F.col(c).asc() for c in (rest or [head])])
    placed = _same(seg.withColumn("_place", F.row_number().over(own)), heads, [*group, value, head])
    rank = F.col("_v_n") + F.col("_h_n") + F.col("_place")
    running = F.col("_v_sum") + F.col("_h_sum") + F.col("_place") * F.col(value)       # items of one step have the same value
    return placed.select(
        *group, *item, value, rank.cast("int").alias("rank"),
        F.round((running * 100).cast("decimal(22,0)") / F.nullif(F.col("_total"), F.lit(0)), 2).cast("decimal(5,2)").alias(share_name))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, where NULL equals NULL. (It also adds no NOT NULL filters, by which branches over one
    aggregate would come to differ.)"""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond).drop(*[f"_r_{k}" for k in keys])


def month_calendar(seg: DataFrame, group: Sequence[str], period: str) -> DataFrame:
    """(group, period): every month from a group's first to its last."""
    ends = seg.groupBy(*group).agg(F.min(period).alias("_from"), F.max(period).alias("_to"))
    return ends.select(*group, F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias(period))


def change_over_previous(seg: DataFrame, group: Sequence[str], period: str,
                         values: Sequence[str]) -> DataFrame:
    """Difference of each value with the month before in the same group (X3). Months without rows are filled in
    from a calendar, with NULL values, so a gap is shown and never skipped; ``period`` is the first day of a month."""
    keys = [*group, period]
    full = month_calendar(seg, group, period).join(seg, keys, "left")
    w = Window.partitionBy(*group).orderBy(period)
    return full.select(*[F.col(c) for c in seg.columns], *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_change") for v in values])
