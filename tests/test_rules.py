"""One test per semantic rule, on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import D, ship, staging
from lanescope.operators import clean as C
from lanescope.operators.benchmark import Rule, attach, versus
from lanescope.operators.quality import iqr_outliers
from lanescope.operators.segment import finalize, measures, segment
from lanescope.plans import analyses as A


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_null_weight_keeps_cost_in_cost_per_kg(spark):
    df = ship(spark, [dict(weight_kg=None, cost="10.00"), dict(weight_kg="5.000", cost="10.00")])
    r = one(finalize(measures(df, (), ["cost_per_kg"]), (), ["cost_per_kg"], None))
    assert r.cost_per_kg == Decimal("4.00")          # 20 / 5, not 10 / 5


def test_all_weights_missing_gives_null_cost_per_kg_and_no_flag(spark):
    df = ship(spark, [dict(origin_warehouse="A", weight_kg=None), dict(origin_warehouse="B", weight_kg="1.000")])
    sc = A.warehouse_scorecard_full(df)
    a = sc.where("origin_warehouse = 'A'").first()
    assert a.cost_per_kg is None and a.d_cost_per_kg_pct is None and a.flag_cost_kg == 0


@pytest.mark.parametrize("col,edges,value,label", [
    ("weight_kg", A.WEIGHT_BUCKETS, None, "Very Heavy (100kg+)"),
    ("weight_kg", A.WEIGHT_BUCKETS, "10", "Medium (10-50kg)"),
    ("weight_kg", A.WEIGHT_BUCKETS, "50", "Heavy (50-100kg)"),
    ("weight_kg", A.WEIGHT_BUCKETS, "100", "Very Heavy (100kg+)"),
    ("cost", A.COST_BUCKETS, "50", "Standard ($50-100)"),
    ("cost", A.COST_BUCKETS, "100", "Premium ($100-200)"),
    ("cost", A.COST_BUCKETS, "200", "Expensive (200+)"),
    ("distance_miles", A.DISTANCE_BUCKETS, None, "Very Long (1000mi+)"),
    ("distance_miles", A.DISTANCE_BUCKETS, "100", "Medium (100-500mi)"),
    ("distance_miles", A.DISTANCE_BUCKETS, "500", "Long (500-1000mi)"),
    ("distance_miles", A.DISTANCE_BUCKETS, "1000", "Very Long (1000mi+)"),
    ("distance_miles", A.DISTANCE_BUCKETS, "99.999", "Short (< 100mi)"),
])
def test_bucket_edges_and_null_arm(spark, col, edges, value, label):
    df = ship(spark, [{col: value}])
    assert one(df.select(A.bucket(col, edges).alias("b"))).b == label


def _bench_rows(spark, w, o):
    return (spark.createDataFrame([(Decimal(w),)], "k decimal(14,2)"),
            spark.createDataFrame([(Decimal(o),)], "k decimal(14,2)"))


@pytest.mark.parametrize("kind,w,o,threshold,direction,expected", [
    ("pp", "80.00", "82.00", -2.00, "le", 1),      # delivered drop exactly -2.00
    ("pp", "80.01", "82.00", -2.00, "le", 0),
    ("pp", "12.00", "10.00", 2.00, "ge", 1),       # delay rise exactly +2.00
    ("pp", "2.70", "2.00", 0.70, "ge", 1),         # return / lost rise exactly +0.70
    ("pp", "2.69", "2.00", 0.70, "ge", 0),
    ("pct", "110.00", "100.00", 0.10, "ge", 1),    # cost ratio exactly 0.10
    ("pct", "109.99", "100.00", 0.10, "ge", 0),
    ("pct", "5.00", "0.00", 0.10, "ge", 0),        # zero benchmark: NULL ratio, flag 0
])
def test_flag_thresholds_are_inclusive(spark, kind, w, o, threshold, direction, expected):
    seg, bench = _bench_rows(spark, w, o)
    out = versus(seg, bench, [Rule("k", kind, "d", "f", threshold, direction)])
    assert one(out).f == expected


def test_pct_delta_rounds_half_away_from_zero(spark):
    seg, bench = _bench_rows(spark, "100.00", "800.00")    # -87.5 %
    assert one(versus(seg, bench, [Rule("k", "pct", "d")])).d == Decimal("-87.50")
    seg, bench = _bench_rows(spark, "1.00", "3.00")        # -66.666.. %
    assert one(versus(seg, bench, [Rule("k", "pct", "d")])).d == Decimal("-66.67")


def test_carrier_at_both_medians_is_slow_but_cheap(spark):
    rows = []
    for i, (cpu, days) in enumerate([("10.00", 2), ("20.00", 3), ("30.00", 4)]):
        rows += [dict(carrier=f"C{i}", cost=cpu, delivery_date=None, transit_days=days)] * 30
    out = {r.carrier: r.carrier_position for r in A.carrier_positioning(ship(spark, rows)).collect()}
    assert out["C1"] == "SLOW but CHEAP"
    assert out["C0"] == "FAST and CHEAP (best)" and out["C2"] == "SLOW and EXPENSIVE (worst)"


@pytest.mark.parametrize("gate,n,kept", [(30, 30, True), (30, 29, False), (20, 20, True), (20, 19, False)])
def test_volume_gate(spark, gate, n, kept):
    df = ship(spark, [dict()] * n)
    assert (segment(df, ["carrier"], ["cost_per_unit"], min_volume=gate).count() == 1) == kept


def test_decision_labels_use_strict_comparisons(spark):
    # 85.00 % delivered, 2.00 % problem, cost per kg 10.00 -> GOOD
    rows = [dict(status="Delivered")] * 85 + [dict(status="Lost")] * 2 + [dict(status="Delayed")] * 13
    rows = [{**r, "cost": "100.00", "weight_kg": "10.000"} for r in rows]
    assert one(A.decision_scorecard(ship(spark, rows))).status_flag == A.GOOD
    rows2 = [dict(status="Delivered")] * 84 + [dict(status="Delayed")] * 16
    assert one(A.decision_scorecard(ship(spark, rows2))).status_flag == A.CRITICAL


def test_idle_days_do_not_lower_daily_average(spark):
    rows = [dict(shipment_date=dt.date(2024, 1, 1))] * 4 + [dict(shipment_date=dt.date(2024, 1, 10))] * 2
    assert one(A.avg_daily_shipments(ship(spark, rows))).avg_daily_shipment == Decimal("3.00")


def test_cost_on_the_iqr_fence_is_not_an_outlier(spark):
    # costs 1..4 -> q1 1.75, q3 3.25, step 2.25: fences -0.5 and 5.5; 5.5 stays, 5.51 is out
    rows = [dict(cost=c) for c in ("1.00", "2.00", "3.00", "4.00")]
    base = ship(spark, rows)
    assert iqr_outliers(base).count() == 0
    r = iqr_outliers(ship(spark, rows + [dict(cost="100.00")])).collect()
    assert [x.cost for x in r] == [Decimal("100.00")]


def test_cleaning_forms(spark):
    st = staging(spark, [
        dict(shipment_id=" a1 ", origin_warehouse="  Warehouse_HOU ", destination="", carrier="UPS",
             shipment_date=" 2024-01-01 ", delivery_date="2024-01-05", weight_kg="1,234.5678",
             cost="1,203.065", status="", distance_miles="1,000", transit_days="9"),
        dict(shipment_id="a2", origin_warehouse="W", destination="D", carrier="C",
             shipment_date="2024-01-01", delivery_date="", weight_kg="", cost=" ",
             status="delivered", distance_miles="", transit_days="3"),
    ])
    rows = {r.shipment_id: r for r in C.log_data(st).collect()}
    a1, a2 = rows["a1"], rows["a2"]
    assert (a1.origin_warehouse, a1.destination, a1.status) == ("Warehouse_HOU", "UNKNOWN", "UNKNOWN")
    assert a1.weight_kg == Decimal("1234.568") and a1.cost == Decimal("1203.07")
    assert a1.distance_miles == Decimal("1000.000") and a1.transit_days == 4      # dates win
    assert a2.cost == Decimal("1203.07") and a2.transit_days == 3                  # mean of known costs
    assert C.data_issues(C.log_data(st)).select("shipment_id").collect()[0][0] == "a2"
    # the lower-case status is not counted as delivered; UNKNOWN stays in the denominator
    k = one(finalize(measures(C.log_data(st), (), ["delivered_rate"]), (), ["delivered_rate"], None))
    assert k.delivered_rate == Decimal("0.00")


def test_quarantine_and_strict_modes(spark):
    st = staging(spark, [
        dict(shipment_id="ok", shipment_date="2024-01-01", cost="1"),
        dict(shipment_id="noship", shipment_date="  ", cost="1"),
        dict(shipment_id="badcost", shipment_date="2024-01-01", cost="12abc"),
    ])
    q = {r.shipment_id: r.reject_reason for r in C.quarantine_rows(st).collect()}
    assert q == {"noship": "shipment_date missing", "badcost": "cost unparseable"}
    assert [r.shipment_id for r in C.clean_shipments(st).collect()] == ["ok"]
    with pytest.raises(Exception):
        C.clean_shipments(st.where("shipment_id = 'noship'"), mode="strict").collect()
    with pytest.raises(Exception):
        C.clean_shipments(st.where("shipment_id = 'badcost'"), mode="strict").collect()


def test_duplicate_ids_reported(spark):
    st = staging(spark, [dict(shipment_id="", shipment_date="2024-01-01"),
                         dict(shipment_id=" ", shipment_date="2024-01-01"),
                         dict(shipment_id="x", shipment_date="2024-01-01")])
    assert [tuple(r) for r in C.duplicate_ids(C.clean_shipments(st)).collect()] == [("UNKNOWN", 2)]


def test_overall_benchmark_from_rollup_equals_global_aggregate(spark):
    import random
    rnd = random.Random(7)
    rows = [dict(origin_warehouse=f"W{rnd.randrange(5)}", cost=f"{rnd.randrange(1, 99999) / 100:.2f}",
                 weight_kg=None if rnd.random() < 0.1 else f"{rnd.randrange(1, 9999) / 1000:.3f}",
                 status=rnd.choice(["Delivered", "Delayed", "Lost", "Returned", "UNKNOWN"]))
            for _ in range(300)]
    df = ship(spark, rows)
    kp = list(A.SCORECARD_KPIS)
    from lanescope.operators.segment import rollup
    via_rollup = one(finalize(rollup(measures(df, ["origin_warehouse"], kp)), (), kp, None))
    direct = one(finalize(measures(df, (), kp), (), kp, None))
    assert via_rollup == direct


def test_group_benchmarks_are_taken_after_the_gate(spark):
    # a tiny, very expensive carrier below the gate must not move the medians
    rows = []
    for i, (cpu, days) in enumerate([("10.00", 2), ("20.00", 3), ("30.00", 4)]):
        rows += [dict(carrier=f"C{i}", cost=cpu, delivery_date=None, transit_days=days)] * 30
    base = {r.carrier: r.carrier_position for r in A.carrier_positioning(ship(spark, rows)).collect()}
    rows += [dict(carrier="TINY", cost="9999.00", delivery_date=None, transit_days=1)] * 29
    with_tiny = {r.carrier: r.carrier_position for r in A.carrier_positioning(ship(spark, rows)).collect()}
    assert "TINY" not in with_tiny and with_tiny == base


def test_null_scores_sort_first_in_descending_order(spark):
    # no returns anywhere -> every badness score is NULL; the sort still works, NULLs first
    rows = [dict(origin_warehouse=w, destination="X", status="Delivered") for w in ("A", "B") for _ in range(20)]
    out = A.worst_lanes(ship(spark, rows)).collect()
    assert [r.badness_score for r in out] == [None, None]
    rows += [dict(origin_warehouse="C", destination="X", status=s) for s in ("Returned", "Delayed")] * 10
    out = A.worst_lanes(ship(spark, rows)).collect()
    got = [(r.origin_warehouse, r.badness_score) for r in out]
    assert got[0] == ("C", Decimal("7.00"))
    assert sorted(got[1:]) == [("A", Decimal("1.00")), ("B", Decimal("1.00"))]


def test_month_partitioned_layout_prunes_partitions(spark):
    import contextlib
    import io
    import os
    import tempfile

    from lanescope.sources.store import write_clean_table
    rows = [dict(shipment_date=dt.date(2024, m, 5), delivery_date=None) for m in (1, 2, 3) for _ in range(3)]
    path = os.path.join(tempfile.mkdtemp(prefix="lanescope-layout-"), "t")
    write_clean_table(ship(spark, rows), path, partition_by_month=True)
    df = spark.read.parquet(path).where(F.col("ship_month") == dt.date(2024, 2, 1))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    assert "PartitionFilters: [isnotnull(ship_month" in buf.getvalue()
    assert df.count() == 3


def test_cluster_conf_scales_partitions():
    from lanescope.session import cluster_conf
    small = cluster_conf(64)
    big = cluster_conf(8000)
    join = cluster_conf(8000, shuffle_bytes=10 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    assert int(big["spark.sql.shuffle.partitions"]) == 4000
    assert int(join["spark.sql.shuffle.partitions"]) == (10 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.enabled"] == "true"


def test_approximate_options_stay_close(spark):
    from lanescope.plans.registry import log_data_for
    log = log_data_for(spark, "/root/testdata/sf0.001")
    exact, approx = A.overview(log).first(), A.overview(log, approx_distinct=0.01).first()
    assert (approx.total_warehouses, approx.total_carriers) == (exact.total_warehouses, exact.total_carriers)
    n_exact = iqr_outliers(log).count()
    n_approx = iqr_outliers(log, approx_accuracy=10_000).count()
    assert abs(n_exact - n_approx) <= max(2, n_exact // 10)


def test_every_analysis_runs_on_an_empty_table(spark):
    from lanescope.operators.quality import outlier_sources
    empty = ship(spark, [dict()]).where("1 = 0")
    for name, fn in A.LOG_ANALYSES.items():
        rows = fn(empty).collect()
        if name in ("overview", "overview_wide", "overall_kpi", "overall_kpi_wide"):
            assert len(rows) == 1, name          # global aggregate: one row, NULL KPIs
        else:
            assert rows == [], name
    assert iqr_outliers(empty).collect() == [] and outlier_sources(empty).collect() == []
    assert A.focus_warehouse_carrier(empty, 3).collect() == []
    assert A.destination_cost_drill(empty, "cost_per_unit").collect() == []


def test_strict_mode_fails_without_ansi_too(spark):
    st = staging(spark, [dict(shipment_id="ok", shipment_date="2024-01-01", cost="1"),
                         dict(shipment_id="bad", shipment_date="2024-01-01", cost="12abc")])
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        with pytest.raises(Exception, match="cost unparseable"):
            C.clean_shipments(st, mode="strict").collect()
        assert [r.shipment_id for r in C.clean_shipments(st.where("shipment_id = 'ok'"), mode="strict")
                .collect()] == ["ok"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_stddev_is_the_same_arithmetic_at_every_size(spark):
    """Large values in large groups: n * S2 would not fit DECIMAL(38,0)."""
    import math

    from pyspark.sql import functions as F

    from lanescope.plans.analyses import stddev_exact
    for n in (50_000, 400_000):
        x = ((F.lit(99_999_999_999_000).cast("decimal(38,0)") + F.col("id") % 7) / 100).cast("decimal(18,2)")
        mean = sum(i % 7 for i in range(n)) / n
        want = math.sqrt(sum((i % 7 - mean) ** 2 for i in range(n)) / (n - 1)) / 100
        got = spark.range(n).select(x.alias("x")).agg(stddev_exact(F.col("x"), 2)).first()[0]
        assert abs(got - want) < 1e-12
    assert spark.range(1).agg(stddev_exact(F.col("id"))).first()[0] is None


def test_checkpoint_root_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lanescope.session import checkpoint_root
    context = SimpleNamespace(master="spark://host:7077", applicationId="a", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=context))
