"""Exact ``PERCENTILE_CONT`` over a large column by distributed rank selection.

SQL semantics: over the ``n`` non-null values (as DOUBLE) sorted ascending, position
``pos = p * (n - 1)``; with ``lo = floor(pos)``, ``hi = ceil(pos)`` the result is
``v[lo] + (v[hi] - v[lo]) * (pos - lo)``.
All of it in double arithmetic, as PostgreSQL evaluates PERCENTILE_CONT on float8 (checked in
``tests/test_quantile.py``). DuckDB's ``quantile_cont`` gives the same bits when the fraction is
dyadic (the quartiles and the median used by the analyses) and may differ in the last bit
otherwise.

Spark's built-in exact ``percentile`` merges a value->count map of the whole column in one
final task. Here no task ever sees more than a range of the distinct values:

1. equal values become one (value, count) row: counted map-side, shuffled by value, so a value
   that a third of all rows hold is one row a task;
2. those rows, all different, are range-partitioned by value (no key can be hot) and every
   range is reduced to its bounds and its count; the ranges meet as one short array, whose prefix
   sums name, for each probability, the ranges that hold ranks ``lo`` and ``hi`` and how many values lie
   below them;
3. the values between those bounds are counted again (the bounds are one scalar subquery, so the filter is a plain
   predicate on the scan) and a running sum over them, one window partition per probability, picks the two.

The number of ranges is a setting and not a function of the rows or the map tasks. Every size takes this
path. Everything is lazy DataFrame code; the result is one row.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Value ranges at least, so that the range of a rank is a small part of any column.
LEAST_RANGES = 64
_FIELDS = ("pos", "r_lo", "r_hi", "from", "to", "base")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(v, c): the distinct non-null values of ``col`` as DOUBLE with their counts."""
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    return v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))


def value_ranges(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row: ``ranges``, the value ranges in order as structs (low, high, c, base); base counts the values
    below. ranges: how many; as many as shuffle partitions by default, ``LEAST_RANGES`` at least."""
    ranges = ranges or max(LEAST_RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = counts.repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id())
    per_range = ranged.groupBy("part").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("c"))
    one = per_range.agg(F.sort_array(F.collect_list(F.struct("low", "high", "c"))).alias("r"))
    base = lambda i: F.aggregate(F.slice("r", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
    return one.select(F.transform("r", lambda x, i: F.struct(
        x["low"].alias("low"), x["high"].alias("high"), x["c"].alias("c"), base(i).alias("base"))).alias("ranges"))


def _targets(ranges: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """One row: ``targets``, a struct with the position, the ranks and the bounds that hold them of each probability."""
    n = F.coalesce(F.element_at("ranges", -1)["base"] + F.element_at("ranges", -1)["c"], F.lit(0).cast("bigint"))

    def holds(rank):
        return F.filter("ranges", lambda x: (x["base"] <= rank) & (rank < x["base"] + x["c"]))[0]

    fields = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        fields.append(F.struct(
            pos.alias("pos"), low.alias("r_lo"), high.alias("r_hi"), holds(low)["low"].alias("from"),
            holds(high)["high"].alias("to"), holds(low)["base"].alias("base")).alias(name))
    return ranges.where(F.size("ranges") > 0).select("ranges", n.alias("n")).select(F.struct(*fields).alias("targets"))


def exact_percentiles(df: DataFrame, col: str, probs: Mapping[str, float]) -> DataFrame:
    """One row with a DOUBLE column per entry of ``probs`` (name -> probability); NULL without values."""
    targets = _targets(value_ranges(value_counts(df, col)), probs).scalar()
    c = F.col
    inside = {k: c("v").between(c(f"targets.{k}.from"), c(f"targets.{k}.to")) for k in probs}
    near = df.select(c(col).cast("double").alias("v")).withColumn("targets", targets)
    near = near.where(reduce(operator.or_, inside.values())).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    of = F.array_compact(F.array(*[F.when(inside[k], F.struct(F.lit(k).alias("name"), *[c(f"targets.{k}.{x}").alias(x) for x in _FIELDS])) for k in probs]))
    mine = near.withColumn("targets", targets).select("v", "c", F.explode(of).alias("t"))
    w = Window.partitionBy("t.name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = mine.select("t.*", "v", (c("t.base") + F.sum("c").over(w)).alias("upto"))
    aggs = []
    for k in probs:
        own = c("name") == k
        aggs += [F.min(F.when(own & (c("upto") > c("r_lo")), c("v"))).alias(f"{k}__lo"),
                 F.min(F.when(own & (c("upto") > c("r_hi")), c("v"))).alias(f"{k}__hi"),
                 F.max(F.when(own, c("pos") - c("r_lo"))).alias(f"{k}__part")]
    return running.agg(*aggs).select(*[
        (c(f"{k}__lo") + (c(f"{k}__hi") - c(f"{k}__lo")) * c(f"{k}__part")).alias(k) for k in probs])
