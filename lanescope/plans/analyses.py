"""The named analyses, each a function ``log_data DataFrame (+ parameters) -> DataFrame``.

They compose the operators; nothing here collects or loops over rows. Defaults of the
parameters are the values used by the analysed project (gates, thresholds, labels).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (CARRIER_GATE, CARRIER_MONTH_GATE, COST_BUCKETS, COST_PER_KG_CEILING,
                            COST_RISE_RATIO, CRITICAL, DEFAULT_COST_DRILL, DEFAULT_DELAY_DRILL,
                            DEFAULT_FOCUS, DELAY_RISE_PP, DELIVERED_DROP_PP, DELIVERED_FLOOR,
                            DESTINATION_COST_GATE, DESTINATION_DELAY_GATE, DISTANCE_BUCKETS, EXPENSIVE,
                            FOCUS_CARRIER_GATE, FOCUS_K, FOCUS_LANE_GATE, GOOD, HIGH_RISK, LANE_GATE,
                            LOST_RISE_PP, PROBLEM_CEILING, RECOMMENDATION, RETURN_RISE_PP, SEVERITY,
                            TOP_K, VARIABILITY_GATE, WEIGHT_BUCKETS)
from ..operators.benchmark import (Rule, attach, averages, flag_sum, medians, position_2x2,
                                   ratio_score, versus)
from ..functions.kpi import MEASURE_NAMES, rollup_measure
from ..operators.segment import finalize, key_names, measures, rollup, segment

WH, DEST, CARRIER = "origin_warehouse", "destination", "carrier"

# --------------------------------------------------------------------------------------
# A01 / A01b overview, A03 / A03b overall benchmark
# --------------------------------------------------------------------------------------

OVERALL_KPIS = ("cost_per_unit", "cost_per_kg", "cost_per_mile", "avg_transit_days", "avg_kg",
                "delivered_rate", "delay_rate", "lost_rate", "returned_rate")


def _distinct_roll_up(log: DataFrame, kpis: Sequence, *, names: Sequence[str], bounds: dict[str, tuple[str, str]],
                      extra: Sequence[str] = (), approx_distinct: float | None = None) -> DataFrame:
    """One row: measures of ``kpis`` and ``extra``, distinct counts of warehouse, destination and carrier (``names``) and
    ``bounds`` (name -> min or max, column).

    Two levels: the rows are aggregated by the three keys together (map-side, one row per combination), and the distinct counts
    run over those combinations, so their Expand never copies a shipment. ``approx_distinct=rsd`` counts them by HyperLogLog++
    sketches instead (relative standard deviation ``rsd``), without an Expand."""
    distinct = F.count_distinct if approx_distinct is None else lambda k: F.approx_count_distinct(k, approx_distinct)
    ends = [getattr(F, f)(c).alias(n) for n, (f, c) in bounds.items()]
    m = measures(log, (WH, DEST, CARRIER), kpis, extra=extra, extra_aggs=ends)
    return m.agg(*[rollup_measure(c).alias(c) for c in m.columns if c in MEASURE_NAMES],
                 *[distinct(k).alias(n) for k, n in zip((WH, DEST, CARRIER), names)],
                 *[getattr(F, f)(n).alias(n) for n, (f, _) in bounds.items()])


SHIP_RANGE = {"start_ship_date": ("min", "shipment_date"), "end_ship_date": ("max", "shipment_date")}


def overview(log: DataFrame, approx_distinct: float | None = None) -> DataFrame:
    """Row count, distinct warehouses / destinations / carriers, date range, totals."""
    kp = ["total_cost", "avg_cost", "avg_kg", "avg_transit_days"]
    names = ["total_warehouses", "total_destinations", "total_carriers"]
    m = _distinct_roll_up(log, kp, names=names, bounds=SHIP_RANGE, approx_distinct=approx_distinct)
    out = _counted(finalize(m, (), kp, "total_rows", keep=[*names, *SHIP_RANGE]))
    return out.select("total_rows", *names, *SHIP_RANGE, *kp)


def _counted(one_row: DataFrame) -> DataFrame:
    """Zero rows counted where there are none (a sum of no counts is NULL)."""
    return one_row.withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))


def preview(log: DataFrame, n: int = 5, ordered: bool = False) -> DataFrame:
    """Some rows of the clean table (SRC-4): a plain limit, which stops reading early. ``ordered``
    takes the first rows in a full deterministic order (ids may repeat), which reads the whole
    table and keeps n rows per task before the final merge."""
    return (log.orderBy(*[asc(c) for c in log.columns]) if ordered else log).limit(n)


def overview_wide(log: DataFrame) -> DataFrame:
    """A01 plus delivery-date range, ``COUNT(shipment_id)`` (an id is never NULL here, so the rows) and total kg."""
    kp = ["total_cost", ("avg_cost", "avg_shipment_cost"), "avg_kg", "avg_transit_days"]
    names = ["total_warehouse", "total_destination", "total_carriers"]
    bounds = {"starting_ship_date": ("min", "shipment_date"), "ended_ship_date": ("max", "shipment_date"),
              "starting_del_date": ("min", "delivery_date"), "ended_del_date": ("max", "delivery_date")}
    m = _distinct_roll_up(log, kp, names=names, bounds=bounds, extra=["sum_kg"])
    out = _counted(finalize(m, (), kp, "total_rows", keep=[*names, *bounds, "sum_kg"]))
    return out.select("total_rows", *names, *bounds, "total_cost", F.col("total_rows").alias("total_shipment"), "avg_shipment_cost",
                      F.col("sum_kg").alias("total_kg"), "avg_kg", "avg_transit_days")


def overall_kpi(log: DataFrame) -> DataFrame:
    """Overall KPI benchmark, one row."""
    return finalize(measures(log, (), OVERALL_KPIS), (), OVERALL_KPIS, None)


def overall_kpi_wide(log: DataFrame) -> DataFrame:
    """A03 plus average shipment cost; delivered share named ``delivery_rate``."""
    kp = ["avg_cost", "cost_per_kg", "cost_per_unit", "avg_transit_days", "avg_kg", "cost_per_mile",
          "delivered_rate", "delay_rate", "lost_rate", "returned_rate"]
    out = finalize(measures(log, (), kp), (), kp, None)
    return out.withColumnRenamed("avg_cost", "avg_shipment_cost").withColumnRenamed(
        "delivered_rate", "delivery_rate")


# --------------------------------------------------------------------------------------
# A11 warehouse priority scorecard (final output 1) and its wide variant
# --------------------------------------------------------------------------------------


SCORECARD_KPIS = ("avg_transit_days", "cost_per_unit", "cost_per_kg", "cost_per_mile",
                  "delivered_rate", "delay_rate", "lost_rate", "returned_rate")


def scorecard_rules(with_cost_per_mile_flag: bool = False) -> list[Rule]:
    rules = [
        Rule("delivered_rate", "pp", "d_delivered_pp", "flag_delivery", DELIVERED_DROP_PP, "le"),
        Rule("delay_rate", "pp", "d_delay_pp", "flag_delay", DELAY_RISE_PP),
        Rule("lost_rate", "pp", "d_lost_pp", "flag_lost", LOST_RISE_PP),
        Rule("returned_rate", "pp", "d_return_pp", "flag_return", RETURN_RISE_PP),
        Rule("avg_transit_days", "pp", "d_transit_days"),
        Rule("cost_per_unit", "pct", "d_cost_per_unit_pct", "flag_cost_unit", COST_RISE_RATIO),
        Rule("cost_per_kg", "pct", "d_cost_per_kg_pct", "flag_cost_kg", COST_RISE_RATIO),
        Rule("cost_per_mile", "pct", "d_cost_per_mile_pct",
             "flag_cost_mile" if with_cost_per_mile_flag else None, COST_RISE_RATIO),
    ]
    return rules


def _scorecard_plan(with_cost_per_mile_flag: bool, with_secondary_deltas: bool,
                    extra_kpis: Sequence[str]) -> tuple[list[Rule], list[str]]:
    rules = scorecard_rules(with_cost_per_mile_flag)
    if not (with_secondary_deltas or with_cost_per_mile_flag):
        rules = [r for r in rules if r.flag]
    kp = [r.kpi for r in rules] + [k for k in extra_kpis if k not in {r.kpi for r in rules}]
    return rules, kp


def scorecard_from_measures(m: DataFrame, keys: Sequence[str] = (WH,), *,
                            extra_kpis: Sequence[str] = (), with_cost_per_mile_flag: bool = False,
                            with_secondary_deltas: bool = True,
                            count_name: str = "shipment_count") -> DataFrame:
    """Scorecard from segment measures (see ``warehouse_scorecard_full``)."""
    rules, kp = _scorecard_plan(with_cost_per_mile_flag, with_secondary_deltas, extra_kpis)
    seg = finalize(m, keys, kp, count_name)
    overall = finalize(rollup(m), (), kp, None)
    return versus(seg, overall, rules, flag_count="flag_count",
                  priority=(count_name, "priority_score"))


def warehouse_scorecard_full(log: DataFrame, keys: Sequence[str] = (WH,), *,
                             extra_kpis: Sequence[str] = (),
                             with_cost_per_mile_flag: bool = False,
                             with_secondary_deltas: bool = True,
                             count_name: str = "shipment_count") -> DataFrame:
    """Every segment KPI, delta and flag against the overall benchmark.

    Segment measures are aggregated once; the overall benchmark is their roll-up (sums of
    sums) bound as one scalar subquery over the same aggregate, so Spark reuses the segment
    shuffle for it. ``with_secondary_deltas=False`` drops the transit and cost-per-mile deltas
    (no flag uses them), so the aggregate carries only the measures of the final scorecard.
    """
    _, kp = _scorecard_plan(with_cost_per_mile_flag, with_secondary_deltas, extra_kpis)
    return scorecard_from_measures(measures(log, keys, kp), keys, extra_kpis=extra_kpis,
                                   with_cost_per_mile_flag=with_cost_per_mile_flag,
                                   with_secondary_deltas=with_secondary_deltas, count_name=count_name)


# KPIs (hence measures) the priority ranking needs; fine-grained aggregates include them so the
# ranking can be derived from their roll-up.
PRIORITY_KPIS = tuple(r.kpi for r in scorecard_rules() if r.flag)


def top_priority_from_measures(m: DataFrame, k: int) -> DataFrame:
    """Top-k warehouses of the priority scorecard, from finer measures that include
    ``origin_warehouse`` (rolled up exactly to warehouse level first)."""
    sc = scorecard_from_measures(rollup(m, [WH]), with_secondary_deltas=False)
    return sc.orderBy(desc("priority_score"), desc("shipment_count"), asc(WH)).limit(k).select(WH)


def warehouse_scorecard(log: DataFrame) -> DataFrame:
    """Warehouse priority scorecard (A11): ordered by priority, then volume."""
    full = warehouse_scorecard_full(log, with_secondary_deltas=False)
    return full.select(WH, "shipment_count", "d_delivered_pp", "d_delay_pp", "d_return_pp",
                       "d_cost_per_unit_pct", "d_cost_per_kg_pct", "flag_count", "priority_score"
                       ).orderBy(desc("priority_score"), desc("shipment_count"))


def warehouse_scorecard_wide(log: DataFrame) -> DataFrame:
    """Adds average shipment cost, average kg, cost/mile delta and a 7th flag (cost/mile)."""
    full = warehouse_scorecard_full(log, extra_kpis=("avg_cost", "avg_kg"),
                                    with_cost_per_mile_flag=True)
    return full.select(WH, "shipment_count", F.col("avg_cost").alias("avg_shipment_cost"), "avg_kg",
                       "d_delivered_pp", "d_delay_pp", "d_lost_pp", "d_return_pp", "d_transit_days",
                       "d_cost_per_unit_pct", "d_cost_per_kg_pct", "d_cost_per_mile_pct",
                       "flag_count", "priority_score"
                       ).orderBy(desc("priority_score"), desc("shipment_count"))


# --------------------------------------------------------------------------------------
# A14 carrier 2x2 positioning (final output 2), A29 trade-off feed
# --------------------------------------------------------------------------------------

CARRIER_KPIS = ("cost_per_unit", "avg_transit_days", "delay_rate", "returned_rate", "delivered_rate")


def carrier_positioning(log: DataFrame, min_volume: int = CARRIER_GATE,
                        kpis: Sequence[str] = CARRIER_KPIS) -> DataFrame:
    """Carrier KPIs with the 2x2 label against the medians over gated carriers."""
    ck = segment(log, [CARRIER], kpis, min_volume=min_volume, count_name="shipments")
    # medians of every output KPI (a few values each): the benchmark subquery then aggregates
    # exactly like the main query and Spark reuses the carrier shuffle for it
    ck_b, med = attach(ck, medians(ck, kpis))
    label = position_2x2(F.col("cost_per_unit"), F.col("avg_transit_days"),
                         med["med_cost_per_unit"], med["med_avg_transit_days"])
    return ck_b.select(*ck.columns, label.alias("carrier_position")).orderBy(desc("shipments"))


def carrier_tradeoff(log: DataFrame, min_volume: int = CARRIER_GATE) -> DataFrame:
    """Scatter feed: x = transit days, y = cost per unit, size = shipments, label = carrier."""
    cp = carrier_positioning(log, min_volume, kpis=("cost_per_unit", "avg_transit_days"))
    return cp.select(F.col(CARRIER).alias("label"), F.col("avg_transit_days").alias("x"),
                     F.col("cost_per_unit").alias("y"), F.col("shipments").alias("size"),
                     "carrier_position")


# --------------------------------------------------------------------------------------
# A19 worst lanes (final output 3)
# --------------------------------------------------------------------------------------

LANE_KPIS = ("cost_per_unit", "avg_transit_days", "delay_rate", "returned_rate")
SCORE_KPIS = ("cost_per_unit", "delay_rate", "returned_rate")


def worst_lanes(log: DataFrame, min_volume: int = LANE_GATE, with_lost_rate: bool = False) -> DataFrame:
    """Lanes (origin -> destination) with a badness score: the sum of cost per unit, delay rate
    and return rate, each divided by its unweighted average over the gated lanes (A19, A19b)."""
    kp = list(LANE_KPIS) + (["lost_rate"] if with_lost_rate else [])
    rk = segment(log, [WH, DEST], kp, min_volume=min_volume, count_name="shipments")
    # average every lane KPI (not only the scored ones) so the benchmark subquery aggregates
    # exactly like the main query and Spark reuses the lane shuffle for it
    rk_b, avg = attach(rk, averages(rk, kp))
    score = ratio_score([(F.col(k), avg[f"avg_{k}"]) for k in SCORE_KPIS])
    return (rk_b.select(*rk.columns, score.alias("badness_score"))
            .orderBy(desc("badness_score"), desc("shipments")))


# --------------------------------------------------------------------------------------
# Ordering helpers: the analysed SQL sorts ASC with NULLs last and DESC with NULLs first.
# --------------------------------------------------------------------------------------

def asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_first()


def month_of(c: str = "shipment_date") -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.col(c), "month")


# --------------------------------------------------------------------------------------
# A04 - A09 time trends
# --------------------------------------------------------------------------------------

def avg_daily_shipments(log: DataFrame) -> DataFrame:
    """Average shipments per *active* day for each warehouse (days without shipments do not
    count). Two aggregation levels; both combine map-side before their shuffle (A04)."""
    from ..functions.kpi import DAYS, ratio, round2
    per_day = log.groupBy(WH, "shipment_date").agg(F.count(F.lit(1)).alias("per_day_shipment"))
    return (per_day.groupBy(WH)
            .agg(round2(ratio(F.sum("per_day_shipment").cast("decimal(20,0)"), F.count("per_day_shipment")),
                        DAYS).alias("avg_daily_shipment"))
            .orderBy(desc("avg_daily_shipment")))


def _monthly(log: DataFrame, key: str, kpis) -> DataFrame:
    return segment(log, [month_of().alias(key)], kpis, count_name=None, order=[asc(key)])


def monthly_volume(log: DataFrame) -> DataFrame:
    """Shipments per month."""
    return segment(log, [month_of().alias("ship_month")], [("shipments", "per_month_shipment")],
                   count_name=None, order=[asc("ship_month")])


def monthly_delivered(log: DataFrame) -> DataFrame:
    """Delivered share and average transit days per month."""
    return _monthly(log, "monthly_shipment", [("delivered_rate", "otd_percentage"), "avg_transit_days"])


def monthly_returned(log: DataFrame) -> DataFrame:
    """Returned rate per month."""
    return _monthly(log, "monthly_ship", ["returned_rate"])


def monthly_cost(log: DataFrame) -> DataFrame:
    """Total cost per month."""
    return _monthly(log, "monthly", [("total_cost", "cost_per_month")])


def monthly_transit(log: DataFrame) -> DataFrame:
    """Average transit days per month."""
    return _monthly(log, "monthly_transit", ["avg_transit_days"])


# --------------------------------------------------------------------------------------
# A10 warehouse KPI table, A12 / A17 focus drill-downs, A13 carrier vs its warehouse
# --------------------------------------------------------------------------------------

def warehouse_kpi(log: DataFrame) -> DataFrame:
    """Warehouse segment KPIs ordered by cost per kg (A10). ``avg_kg`` here is
    SUM(weight_kg) / COUNT(shipment_id), as in the analysed query."""
    kp = ["avg_transit_days", "cost_per_kg", "cost_per_unit", ("avg_kg_per_shipment", "avg_kg"),
          "cost_per_mile", "delay_rate", "lost_rate", "returned_rate", ("delivered_rate", "otd_percentage")]
    return segment(log, [WH], kp, count_name="shipment_count", order=[desc("cost_per_kg")])


def top_priority_warehouses(log: DataFrame, k: int = 3) -> DataFrame:
    """The k warehouses first in the priority scorecard order (ties: volume, then name)."""
    return top_priority_from_measures(measures(log, [WH], PRIORITY_KPIS), k)


def _focus(log: DataFrame, warehouses) -> DataFrame:
    """Rows of the focus warehouses: a literal list (pushed down to the Parquet scan) or a
    frame of names, e.g. a top-k report. The semi-join carries no broadcast hint: Spark
    broadcasts the names only when their size estimate (k rows after a limit) is under the
    broadcast threshold, and AQE re-checks the real size; otherwise it shuffle-joins."""
    if isinstance(warehouses, DataFrame):
        return log.join(warehouses.select(WH), WH, "left_semi")
    return log.where(F.col(WH).isin(list(warehouses)))


# The focus list and drill pairs of the analysed project name entities of its own data; they
# are the defaults here, and the registry derives the same choices from the data instead.


def _whole(m: DataFrame) -> DataFrame:
    """``m`` with all its measures needed wherever it is read.

    The ranking and the rows of a drill-down are two branches over one aggregate. Each would prune the measures that it does
    not use, the exchanges would differ and the fact table be read twice. The predicate names every measure and holds for every
    group (a group has at least ``n`` rows), so both branches plan the same exchange and AQE reuses it."""
    whole = [F.col(c).cast("double") for c in m.columns if c in MEASURE_NAMES]
    return m.where(F.greatest(*whole) >= F.col("n").cast("double"))


def _chosen(m: DataFrame, names: DataFrame, key: Column) -> DataFrame:
    """Rows of the aggregate ``m`` whose ``key`` is among ``names`` (few rows of one column, bound as one array-valued scalar
    subquery). The key is read through a measure, so the predicate stays above the aggregate and does not change its input."""
    few = names.agg(F.collect_list(names.columns[0]).alias("names")).scalar()
    return m.where(F.array_contains(few, F.when(F.col("n") > 0, key)))


def focused_segment(log: DataFrame, keys: Sequence, kpis: Sequence, warehouses, *,
                    min_volume: int | None = None, count_name: str = "shipments",
                    order: Sequence[Column] | None = None) -> DataFrame:
    """Segment KPIs restricted to focus warehouses.

    ``warehouses`` is a list of names (filter pushed into the scan), a frame of names, or an
    int k: the top-k of the priority scorecard. For k the measures are aggregated once at the
    segment grain (which includes the warehouse); the scorecard is their exact roll-up and its k names are
    bound to the aggregated rows, so the fact table is scanned once and no job runs before the query.
    """
    if isinstance(warehouses, int):
        m = _whole(measures(log, keys, list(kpis) + [k for k in PRIORITY_KPIS if k not in kpis]))
        m = _chosen(m, top_priority_from_measures(m, warehouses), F.col(WH))
    else:
        m = measures(_focus(log, warehouses), keys, kpis)
    if min_volume is not None:
        m = m.where(F.col("n") >= F.lit(min_volume))
    out = finalize(m, key_names(log, keys), kpis, count_name)
    return out.orderBy(*order) if order else out


def focus_warehouse_carrier(log: DataFrame, warehouses=DEFAULT_FOCUS,
                            min_volume: int = FOCUS_CARRIER_GATE) -> DataFrame:
    """Warehouse x carrier KPIs for the focus warehouses."""
    kp = ["avg_transit_days", "cost_per_unit", "cost_per_kg", "delay_rate", "returned_rate", "delivered_rate"]
    return focused_segment(log, [WH, CARRIER], kp, warehouses, min_volume=min_volume,
                           order=[asc(WH), desc("shipments")])


def focus_lanes(log: DataFrame, warehouses=DEFAULT_FOCUS, min_volume: int = FOCUS_LANE_GATE) -> DataFrame:
    """Lanes of the focus warehouses."""
    kp = ["cost_per_unit", "cost_per_kg", "avg_kg", "avg_transit_days", "delay_rate", "returned_rate"]
    return focused_segment(log, [WH, DEST], kp, warehouses, min_volume=min_volume,
                           order=[asc(WH), desc("shipments")])


def carrier_vs_warehouse(log: DataFrame, warehouses=None) -> DataFrame:
    """Each carrier inside a warehouse against that warehouse's own KPIs (A13, repaired).

    Carrier rows (not the benchmark rows) are emitted; priority = shipments x flag_count with
    all five flags. Generalised from one benchmark warehouse to every warehouse: the benchmark
    is the roll-up of the same (warehouse, carrier) measures, equi-joined on the warehouse.
    """
    src = log if warehouses is None else _focus(log, warehouses)
    kp = ["avg_transit_days", "cost_per_unit", "cost_per_kg", "delay_rate", "returned_rate", "delivered_rate"]
    m = measures(src, [WH, CARRIER], kp)
    carriers = finalize(m, [WH, CARRIER], kp, "shipments")
    wh = finalize(rollup(m, [WH]), [WH], kp, None)
    rules = [
        Rule("delay_rate", "pp", "d_delay_pp", "flag_delay", DELAY_RISE_PP),
        Rule("returned_rate", "pp", "d_return_pp", "flag_return", RETURN_RISE_PP),
        Rule("delivered_rate", "pp", "d_delivered_rate_pp", "flag_delivered", DELIVERED_DROP_PP, "le"),
        Rule("cost_per_kg", "pct", "d_cost_per_kg_pct", "flag_cost_per_kg", COST_RISE_RATIO),
        Rule("cost_per_unit", "pct", "d_cost_per_unit_pct", "flag_cost_per_unit", COST_RISE_RATIO),
        Rule("avg_transit_days", "pp", "d_avg_transit_days"),
    ]
    out = versus(carriers, wh, rules, on=[WH])
    flags = flag_sum(["flag_cost_per_kg", "flag_cost_per_unit", "flag_delay", "flag_return", "flag_delivered"])
    return (out.select(WH, CARRIER, "shipments", "d_delay_pp", "d_return_pp", "d_delivered_rate_pp",
                       "d_cost_per_kg_pct", "d_cost_per_unit_pct", "d_avg_transit_days",
                       flags.alias("flag_count"))
            .withColumn("priority_score", (F.col("shipments") * F.col("flag_count")).cast("bigint"))
            .orderBy(desc("priority_score"), desc("shipments")))


DRILL_GATE = FOCUS_CARRIER_GATE   # carriers considered for a drill pair: the A12 volume gate


def _drill_from_measures(m: DataFrame, kpi_name: str, gate: int = DRILL_GATE) -> DataFrame:
    """(warehouse, carrier) from measures at a grain containing both: the top-priority
    warehouse and, inside it, the carrier with the highest ``kpi_name`` (ties: volume, name)."""
    wc = _chosen(rollup(m, [WH, CARRIER]), top_priority_from_measures(m, 1), F.col(WH))
    wc = finalize(wc.where(F.col("n") >= gate), [WH, CARRIER], [kpi_name], "shipments")
    return wc.orderBy(desc(kpi_name), desc("shipments"), asc(CARRIER)).limit(1).select(WH, CARRIER)


def drill_pair(log: DataFrame, kpi_name: str, min_volume: int = DRILL_GATE) -> DataFrame:
    """One row (warehouse, carrier): see ``_drill_from_measures``."""
    m = _whole(measures(log, [WH, CARRIER], [kpi_name, *PRIORITY_KPIS]))
    return _drill_from_measures(m, kpi_name, min_volume)


def _pair(log: DataFrame, pair) -> DataFrame:
    if isinstance(pair, DataFrame):
        return log.join(pair.select(WH, CARRIER), [WH, CARRIER], "left_semi")
    wh, carrier = pair
    return log.where((F.col(WH) == wh) & (F.col(CARRIER) == carrier))


def _destination_drill(log: DataFrame, pair, kpis: Sequence[str], min_volume: int,
                       order: Sequence[Column]) -> DataFrame:
    """Destinations of one (warehouse, carrier). ``pair`` is a tuple (filter pushed into the
    scan), a one-row frame, or the name of the KPI that picks the carrier inside the
    top-priority warehouse; then one aggregate at (warehouse, carrier, destination) grain
    feeds the priority ranking, the carrier choice and the destination KPIs (one scan)."""
    if isinstance(pair, str):
        m = _whole(measures(log, [WH, CARRIER, DEST], [*kpis, pair, *PRIORITY_KPIS]))
        best = _drill_from_measures(m, pair).select(F.struct(WH, CARRIER))
        m = rollup(_chosen(m, best, F.struct(WH, CARRIER)), [DEST])
    else:
        m = measures(_pair(log, pair), [DEST], kpis)
    m = m.where(F.col("n") >= F.lit(min_volume))
    return finalize(m, [DEST], kpis, "shipments").orderBy(*order)


def destination_cost_drill(log: DataFrame, pair=DEFAULT_COST_DRILL,
                           min_volume: int = DESTINATION_COST_GATE) -> DataFrame:
    """Destinations of one (warehouse, carrier): volume, average kg and miles, cost per unit."""
    return _destination_drill(log, pair, ["avg_kg", "avg_miles", "cost_per_unit"], min_volume,
                              [desc("cost_per_unit")])


def destination_delay_drill(log: DataFrame, pair=DEFAULT_DELAY_DRILL,
                            min_volume: int = DESTINATION_DELAY_GATE) -> DataFrame:
    """Destinations of one (warehouse, carrier): transit days and delay rate."""
    return _destination_drill(log, pair, ["avg_transit_days", "delay_rate"], min_volume,
                              [desc("delay_rate"), desc("shipments")])


def lane_delivered(log: DataFrame, min_volume: int = LANE_GATE) -> DataFrame:
    """Delivered share per lane, best first."""
    return segment(log, [WH, DEST], [("delivered_rate", "otd_percentage"), "avg_transit_days"],
                   min_volume=min_volume, count_name="shipment_count", order=[desc("otd_percentage")])


# --------------------------------------------------------------------------------------
# A20 - A22 buckets
# --------------------------------------------------------------------------------------

# Bucket edges are lower-inclusive; there is no NULL arm, so a NULL value falls into the last
# bucket (edges and labels in ``fixed_values``).


def bucket(c: str, edges) -> Column:
    expr = None
    for upper, label in edges:
        if upper is None:
            return expr.otherwise(F.lit(label))
        cond = F.col(c) < F.lit(upper)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def weight_buckets(log: DataFrame) -> DataFrame:
    """Does weight drive delays?"""
    return segment(log, [bucket("weight_kg", WEIGHT_BUCKETS).alias("weight_category")],
                   ["avg_transit_days", "delay_rate", "delivered_rate"],
                   count_name="shipment_count", order=[desc("avg_transit_days")])


def cost_buckets(log: DataFrame) -> DataFrame:
    """Are cheap shipments delayed more?"""
    return segment(log, [bucket("cost", COST_BUCKETS).alias("cost_category")],
                   ["avg_transit_days", "delay_rate", "delivered_rate", "lost_rate"],
                   count_name="shipment_count", order=[desc("delay_rate")])


def distance_buckets(log: DataFrame) -> DataFrame:
    """How does cost change with distance?"""
    return segment(log, [bucket("distance_miles", DISTANCE_BUCKETS).alias("distance_category")],
                   ["avg_cost", "avg_transit_days", "cost_per_mile", "delivered_rate"],
                   count_name="shipment_count", order=[desc("shipment_count")])


# --------------------------------------------------------------------------------------
# A23 / A24 monthly trends by segment, A25 variability, A26 decision scorecard
# --------------------------------------------------------------------------------------

def warehouse_monthly(log: DataFrame, warehouses=DEFAULT_FOCUS) -> DataFrame:
    """Monthly delay / delivered share / transit for the focus warehouses."""
    return focused_segment(log, [month_of().alias("month"), WH],
                           ["delay_rate", "delivered_rate", "avg_transit_days"], warehouses,
                           count_name="shipment_count", order=[asc(WH), asc("month")])


def carrier_monthly(log: DataFrame, min_volume: int = CARRIER_MONTH_GATE) -> DataFrame:
    """Monthly transit / delivered share / delay per carrier."""
    return segment(log.where(F.col(CARRIER).isNotNull()), [month_of().alias("month"), CARRIER],
                   ["avg_transit_days", "delivered_rate", "delay_rate"], min_volume=min_volume,
                   count_name="shipment_count", order=[asc(CARRIER), asc("month")])


def stddev_exact(x: Column, scale: int = 0) -> Column:
    """Sample standard deviation from exact integer sums, the same arithmetic for groups of any size.

    ``x`` must be integral after multiplying by ``10**scale`` (cents for money). With q the floor of
    the mean and r the rest of the sum, A = S2 - q*S1 - q*r is the exact sum of (x - q)^2, and the variance is
    (n*A - r*r) / (n*(n-1)): no product of n and S2, so the size of the values does not count. Sums beyond
    DECIMAL(38,0) raise an error.
    """
    xi = (x * F.lit(10 ** scale)).cast("decimal(38,0)") if scale else x.cast("decimal(38,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    count = F.count(xi)
    n, s1, s2 = whole(count), whole(F.sum(xi)), whole(F.sum(xi * xi))
    r = whole(F.pmod(s1, n))
    q = whole((s1 - r) / F.nullif(n, F.lit(0)))
    around = whole(s2 - q * s1 - q * r)
    num = whole(n * around - r * r)
    num = F.when(num.isNull() & (count > 0), F.raise_error(F.lit("standard deviation: sums beyond DECIMAL(38,0)"))).otherwise(num)
    spread = F.sqrt(num.cast("double") / F.nullif(whole(n * (n - 1)).cast("double"), F.lit(0.0)))
    return spread / F.lit(float(10 ** scale)) if scale else spread


def variability(log: DataFrame, min_volume: int = VARIABILITY_GATE) -> DataFrame:
    """Which warehouse x carrier is erratic? Cost / transit spread and problem rate.
    One aggregation computes the KPI measures and the exact spread sums together."""
    src = log.where(F.col(CARRIER).isNotNull())
    kp = ["avg_cost", "avg_transit_days", "problem_rate"]
    m = measures(src, [WH, CARRIER], kp, extra_aggs=[
        stddev_exact(F.col("cost"), 2).alias("cost_stddev"),
        stddev_exact(F.col("transit_days")).alias("transit_stddev")])
    m = m.where(F.col("n") >= min_volume)
    out = finalize(m, [WH, CARRIER], kp, "shipment_count", keep=["cost_stddev", "transit_stddev"])
    return out.select(WH, CARRIER, "shipment_count", "avg_cost", "avg_transit_days", "cost_stddev",
                      "transit_stddev", "problem_rate").orderBy(desc("problem_rate"), desc("cost_stddev"))




def decision_scorecard(log: DataFrame) -> DataFrame:
    """Status label and recommendation per warehouse; first matching rule wins."""
    kp = ["avg_cost", "cost_per_kg", ("delivered_rate", "otd_pct"), "problem_rate", "avg_transit_days"]
    seg = segment(log, [WH], kp, count_name="total_shipments")
    label = (F.when(F.col("otd_pct") < DELIVERED_FLOOR, F.lit(CRITICAL))
             .when(F.col("problem_rate") > PROBLEM_CEILING, F.lit(HIGH_RISK))
             .when(F.col("cost_per_kg") > COST_PER_KG_CEILING, F.lit(EXPENSIVE))
             .otherwise(F.lit(GOOD)))
    out = seg.withColumn("status_flag", label)
    rec = F.lit(RECOMMENDATION[GOOD])
    sev = F.lit(SEVERITY[GOOD])
    for lab in (EXPENSIVE, HIGH_RISK, CRITICAL):
        rec = F.when(F.col("status_flag") == lab, F.lit(RECOMMENDATION[lab])).otherwise(rec)
        sev = F.when(F.col("status_flag") == lab, F.lit(SEVERITY[lab])).otherwise(sev)
    return (out.withColumn("recommendation", rec)
            .orderBy(sev.asc(), desc("problem_rate"), desc("cost_per_kg")))


# --------------------------------------------------------------------------------------
# A27 / A28 top-k reports
# --------------------------------------------------------------------------------------

def top_warehouses(log: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k of the priority scorecard (ties broken by volume, then name)."""
    return warehouse_scorecard(log).orderBy(desc("priority_score"), desc("shipment_count"), asc(WH)).limit(k)


def top_lanes(log: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k worst lanes with the label ``origin → destination`` (A28). Lanes without a score
    sort last, as in a descending sort of a chart feed."""
    from ..operators.rank import lane_label
    wl = worst_lanes(log)
    return (wl.orderBy(F.col("badness_score").desc_nulls_last(), desc("shipments"), asc(WH), asc(DEST))
            .limit(k).select(lane_label().alias("lane"), *wl.columns))


def _by_name() -> dict:
    """Analyses that take only the clean table, by report name; data-driven choices where the analysed project names its own
    warehouses and carriers."""
    from ..operators import clean, quality

    own = (overview, overview_wide, overall_kpi, overall_kpi_wide, avg_daily_shipments, monthly_volume, monthly_delivered, monthly_returned,
           monthly_cost, monthly_transit, warehouse_kpi, warehouse_scorecard, warehouse_scorecard_wide, carrier_vs_warehouse,
           carrier_positioning, carrier_tradeoff, lane_delivered, worst_lanes, weight_buckets, cost_buckets, distance_buckets,
           carrier_monthly, variability, decision_scorecard, top_warehouses, top_lanes)
    return {f.__name__: f for f in own} | {
        "worst_lanes_wide": lambda log: worst_lanes(log, with_lost_rate=True),
        "focus_warehouse_carrier": lambda log: focus_warehouse_carrier(log, FOCUS_K), "focus_lanes": lambda log: focus_lanes(log, FOCUS_K),
        "warehouse_monthly": lambda log: warehouse_monthly(log, FOCUS_K),
        "destination_cost_drill": lambda log: destination_cost_drill(log, "cost_per_unit"),
        "destination_delay_drill": lambda log: destination_delay_drill(log, "delay_rate"),
        "preview": preview, "data_issues": clean.data_issues, "duplicate_ids": clean.duplicate_ids,
        "iqr_outliers": quality.iqr_outliers, "outlier_sources": quality.outlier_sources,
    }


LOG_ANALYSES = _by_name()
