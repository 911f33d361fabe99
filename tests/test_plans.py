"""Physical-plan properties that matter at scale."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from lanescope.plans import analyses as A
from lanescope.plans.registry import QUERIES, log_data_for

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas", "MapInArrow", "FlatMapGroupsInArrow")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PYTHON_NODES), name
    assert "CartesianProduct" not in p, name
    assert "BroadcastNestedLoopJoin" not in p, name


def test_literal_focus_filter_reaches_the_scan(spark):
    log = log_data_for(spark, SF_SMALL)
    p = plan(A.focus_warehouse_carrier(log, ["NATION_1", "NATION_2"]))
    pushed = [line for line in p.splitlines() if line.startswith("PushedFilters")]
    assert any("In(origin_warehouse" in line for line in pushed), pushed


def test_columns_are_pruned(spark):
    p = plan(A.overall_kpi(log_data_for(spark, SF_SMALL)))
    schema = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert schema and all("shipment_id" not in s and "destination" not in s for s in schema)


def test_scorecard_benchmark_is_a_single_subquery(spark):
    p = plan(A.warehouse_scorecard(log_data_for(spark, SF_SMALL)))
    assert p.count("Subquery:") == 1
    assert "Join" not in p


@pytest.mark.parametrize("name", ["warehouse_scorecard", "warehouse_scorecard_wide", "carrier_positioning",
                                  "worst_lanes"])
def test_one_row_benchmark_reuses_the_segment_shuffle(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in executed, name


@pytest.mark.parametrize("name", ["delay_pareto", "monthly_delay_change", "iqr_outliers", "outlier_sources"])
def test_windows_are_partitioned(spark, name):
    """No window runs over the whole input in one task: each has a partition key."""
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString()
    windows = [ln for ln in executed.splitlines() if ln.strip().lstrip("+-: ").startswith("Window [")]
    assert windows, name
    for ln in windows:
        # windowspecdefinition(<partition keys>, <order keys>, <frame>): without a partition key
        # the first element is an order key (ASC/DESC) or the frame itself
        for spec in ln.split("windowspecdefinition(")[1:]:
            first = spec.split(", ")[0]
            assert not (" ASC" in first or " DESC" in first or first.startswith("specifiedwindowframe")), ln


def fact_scans(df) -> int:
    """File scans of the plan that ran, reused exchanges and subqueries counted once."""
    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind.startswith("Reused"):
            return 0
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        below = [seq.apply(i) for seq in (node.children(), node.subqueries()) for i in range(seq.size())]
        return (kind == "FileSourceScanExec") + sum(map(walk, below))
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["focus_warehouse_carrier", "focus_lanes", "warehouse_monthly",
                                  "destination_cost_drill", "destination_delay_drill"])
def test_drill_downs_scan_the_facts_once_and_run_nothing_before(spark, name):
    """Ranking and rows are branches over one aggregate whose exchange is reused; no job runs while the query is built."""
    log_data_for(spark, SF_SMALL)
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    df = E.queries()[name](spark, SF_SMALL)
    assert list(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) == []
    sc.setJobGroup(f"run-{name}", name)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    assert fact_scans(df) <= 1          # none where AQE found the result empty


@pytest.mark.parametrize("name", ["overview", "overview_wide"])
def test_distinct_counts_expand_combinations_not_rows(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(p) if "Expand" in line)
    assert any("Aggregate [origin_warehouse" in line for line in p[at:]), "the rows are aggregated below the Expand"
    assert fact_scans(df) == 1


def test_pareto_windows_hold_no_whole_carrier_of_lanes(spark):
    """Rows of lanes are ordered inside (carrier, value, warehouse); the windows per carrier run over its distinct values."""
    df = E.queries()["delay_pareto"](spark, SF_SMALL)
    windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert len(windows) == 3
    keys = [line.rsplit("], [", 2)[-2].count("#") for line in windows]
    assert sorted(keys) == [1, 2, 3], windows
    df.collect()
    assert fact_scans(df) == 1


def test_only_rows_with_repeated_ids_are_shuffled_for_the_key(spark):
    p = plan(E.queries()["unique_shipments"](spark, SF_SMALL))
    exchanges = [line for line in p.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert exchanges and all("hashpartitioning(shipment_id" in x or "hashpartitioning(_id" in x for x in exchanges), exchanges
    assert "BroadcastHashJoin LeftOuter" in p


def test_repeated_ids_are_broadcast_by_their_counted_rows(spark):
    """Not by the planner's guess: a sort-merge join would shuffle every row of the table."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(E.queries()["unique_shipments"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin LeftOuter" in p and "SortMergeJoin" not in p


def test_staging_text_is_written_from_the_stored_join(spark):
    """Join and text in one stage make a generated method beyond the 8,000 bytes that the JVM compiles."""
    from lanescope.plans.registry import staged
    buf = io.StringIO()
    with staged(spark, SF_SMALL) as st, contextlib.redirect_stdout(buf):
        st.explain("codegen")
    assert "Join" not in buf.getvalue()
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", buf.getvalue())]
    assert sizes and max(sizes) < 8000


#: Last ORDER BY of the oracle's SQL, by which both results must come in the same order of these keys.
ORDERED = {n: re.search(r"ORDER BY ([a-z_, A-Z]+?)(?: LIMIT \d+)?$", sql.strip()) for n, sql in E.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(n for n, m in ORDERED.items() if m and n in QUERIES and n != "csv_round_trip"))
def test_rows_come_in_the_stated_order(spark, name):
    import duckdb

    from lanescope.sources.tpch_adapter import DRIVER_TABLES
    keys = [k.split()[0] for k in ORDERED[name][1].split(",")]
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    found = con.execute(E.oracle_sql()[name])
    at = [d[0] for d in found.description]
    want = [tuple(r[at.index(k)] for k in keys) for r in found.fetchall()]
    got = [tuple(r[k] for k in keys) for r in E.queries()[name](spark, SF_SMALL).collect()]
    assert got == want and len(set(want)) > 1


def test_decisions_come_by_severity(spark):
    """Ordered by a CASE over the label, then by problem rate and cost per kg, largest first."""
    from lanescope.fixed_values import SEVERITY
    rows = E.queries()["decision_scorecard"](spark, SF_SMALL).collect()
    keys = [(SEVERITY[r.status_flag], -r.problem_rate, -r.cost_per_kg) for r in rows]
    assert keys == sorted(keys) and len({k[0] for k in keys}) > 1
