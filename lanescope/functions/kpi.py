"""KPI expressions built on additive measures.

Every KPI of the analysis is a ratio of sums (``SUM(cost)/SUM(weight_kg)``), a rate
(``SUM(CASE ...)/COUNT(*)*100``) or an average (``AVG(x)`` = ``SUM(x)/COUNT(x)``). We therefore
aggregate *additive measures* once per segment and derive the rounded KPIs afterwards:

* a segment KPI and the overall benchmark come from the same partial aggregates
  (overall = sum of the segment measures), so the fact table is scanned once;
* numerators and denominators skip NULLs independently, exactly like the SQL aggregates
  (a row with NULL weight still adds its cost to ``cost_per_kg``);
* all arithmetic is DECIMAL, so ``ROUND(x, 2)`` is the exact half-away-from-zero rounding
  of PostgreSQL NUMERIC, not a rounding of a binary double.

The rounded KPIs are cast to narrow decimal types so that later arithmetic on them (deltas,
ratios to a benchmark) keeps plenty of fractional digits under Spark's precision rules.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

from ..sources.schema import DELAYED, DELIVERED, LOST, RETURNED

# Result types of rounded KPIs (2 decimals, as ROUND(x, 2)).
MONEY = DecimalType(14, 2)       # cost per unit, average cost: bounded by the cost column
PER_UNIT = DecimalType(20, 2)    # cost per kg / per mile: small denominators may enlarge it
RATE = DecimalType(5, 2)         # percentages 0..100
DAYS = DecimalType(12, 2)        # average transit days (int days: at most 10 integer digits)

# Decimal used for integer sums that feed a division (keeps PostgreSQL's NUMERIC averages).
_INT_SUM = DecimalType(20, 0)
_COUNT_X100 = DecimalType(22, 0)

# Decimal sums are pinned to these types at every level (segment and roll-up). Without the
# cast a roll-up of sums widens the precision and a later division would keep only 6 decimals.
SUM_COST = DecimalType(26, 2)
SUM_QTY = DecimalType(26, 3)


def per_application(fn):
    """Memoise a builder of ``Column`` objects for the running SparkContext.

    Columns are immutable unresolved expressions, so one object can serve every query; building
    them costs a py4j round trip per function call on the driver, which adds up when dozens of
    KPIs are assembled for each query.
    """
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (id(sc), id(getattr(sc, "_jsc", None)), *args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]
    return wrapper


def ratio(num: Column, den: Column) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of a division-by-zero error."""
    return num / F.nullif(den, F.lit(0))


def round2(c: Column, to: DecimalType) -> Column:
    return F.round(c, 2).cast(to)


# --------------------------------------------------------------------------------------
# Additive measures. Names are stable: they are columns of the measure frames.
# --------------------------------------------------------------------------------------

def _status_is(value: str) -> Column:
    return F.col("status") == F.lit(value)


MEASURE_NAMES = ("n", "n_cost", "sum_cost", "n_kg", "sum_kg", "n_miles", "sum_miles",
                 "n_transit", "sum_transit", "n_delivered", "n_delayed", "n_lost", "n_returned")

_STATUS_COUNT = {"n_delivered": DELIVERED, "n_delayed": DELAYED, "n_lost": LOST, "n_returned": RETURNED}
_COUNT_OF = {"n_cost": "cost", "n_kg": "weight_kg", "n_miles": "distance_miles", "n_transit": "transit_days"}
_SUM_OF = {"sum_cost": ("cost", SUM_COST), "sum_kg": ("weight_kg", SUM_QTY),
           "sum_miles": ("distance_miles", SUM_QTY)}


@per_application
def measure(name: str) -> Column:
    """Aggregate expression of an additive measure over shipment rows."""
    if name == "n":
        return F.count(F.lit(1))
    if name in _COUNT_OF:
        return F.count(_COUNT_OF[name])
    if name in _SUM_OF:
        src, t = _SUM_OF[name]
        return F.sum(src).cast(t)
    if name == "sum_transit":
        return F.sum(F.col("transit_days").cast("bigint"))
    if name in _STATUS_COUNT:
        return F.count_if(_status_is(_STATUS_COUNT[name]))
    raise KeyError(name)


@per_application
def rollup_measure(name: str) -> Column:
    """How a measure rolls up from segment rows to a coarser level (sums of sums / counts)."""
    if name in _SUM_OF:
        return F.sum(name).cast(_SUM_OF[name][1])
    return F.sum(name)


# Which measures each KPI needs (so segments aggregate only what they output).
KPI_NEEDS: dict[str, tuple[str, ...]] = {
    "cost_per_unit": ("n", "sum_cost"),
    "cost_per_kg": ("sum_cost", "sum_kg"),
    "cost_per_mile": ("sum_cost", "sum_miles"),
    "avg_transit_days": ("n_transit", "sum_transit"),
    "avg_kg": ("n_kg", "sum_kg"),
    "avg_kg_per_shipment": ("n", "sum_kg"),
    "avg_cost": ("n_cost", "sum_cost"),
    "avg_miles": ("n_miles", "sum_miles"),
    "delivered_rate": ("n", "n_delivered"),
    "delay_rate": ("n", "n_delayed"),
    "lost_rate": ("n", "n_lost"),
    "returned_rate": ("n", "n_returned"),
    "problem_rate": ("n", "n_lost", "n_returned"),
    "total_cost": ("sum_cost",),
    "shipments": ("n",),
}


def _rate(count_col: str | Column) -> Column:
    # count * 100 / n, multiplied first so the quotient is exact to 16 decimals before ROUND.
    c = F.col(count_col) if isinstance(count_col, str) else count_col
    return round2(ratio((c * 100).cast(_COUNT_X100), F.col("n")), RATE)


@per_application
def kpi(name: str) -> Column:
    """Rounded KPI column computed from measure columns (see ``MEASURES``)."""
    col = F.col
    if name == "cost_per_unit":
        return round2(ratio(col("sum_cost"), col("n")), MONEY)
    if name == "cost_per_kg":
        return round2(ratio(col("sum_cost"), col("sum_kg")), PER_UNIT)
    if name == "cost_per_mile":
        return round2(ratio(col("sum_cost"), col("sum_miles")), PER_UNIT)
    if name == "avg_transit_days":
        return round2(ratio(col("sum_transit").cast(_INT_SUM), col("n_transit")), DAYS)
    if name == "avg_kg":
        return round2(ratio(col("sum_kg"), col("n_kg")), PER_UNIT)
    if name == "avg_kg_per_shipment":        # SUM(weight_kg) / COUNT(shipment_id)
        return round2(ratio(col("sum_kg"), col("n")), PER_UNIT)
    if name == "avg_cost":
        return round2(ratio(col("sum_cost"), col("n_cost")), MONEY)
    if name == "avg_miles":
        return round2(ratio(col("sum_miles"), col("n_miles")), PER_UNIT)
    if name == "delivered_rate":
        return _rate("n_delivered")
    if name == "delay_rate":
        return _rate("n_delayed")
    if name == "lost_rate":
        return _rate("n_lost")
    if name == "returned_rate":
        return _rate("n_returned")
    if name == "problem_rate":               # Lost + Returned
        return _rate(col("n_lost") + col("n_returned"))
    if name == "total_cost":
        return col("sum_cost")
    if name == "shipments":
        return col("n")
    raise KeyError(f"unknown KPI {name!r}")


def needed_measures(kpis) -> list[str]:
    out: list[str] = []
    for k in kpis:
        for m in KPI_NEEDS[k]:
            if m not in out:
                out.append(m)
    return out
