"""Exact PERCENTILE_CONT by distributed rank selection, against the SQL float8 computation and
DuckDB's quantile_cont (for dyadic fractions, where the two agree bit for bit)."""

import math
import random

import duckdb
import pandas as pd
import pytest

from lanescope.operators.quantile import exact_percentiles


def _duck(values, p):
    df = pd.DataFrame({"v": values})
    return duckdb.sql(f"SELECT quantile_cont(v, {p}) FROM df").fetchall()[0][0]


@pytest.mark.parametrize("seed,n,hot", [(1, 1, 0.0), (2, 2, 0.0), (3, 999, 0.0), (4, 5000, 0.34), (5, 20000, 0.9)])
def test_matches_duckdb(spark, seed, n, hot):
    rnd = random.Random(seed)
    vals = [1234.56 if rnd.random() < hot else round(rnd.lognormvariate(5, 1.2), 2) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p0": 0.0, "p1": 1.0}
    got = exact_percentiles(df, "v", probs).first()
    for k, p in probs.items():
        assert got[k] == _duck(vals, p), (k, p)


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402


def _sql_percentile_cont(values, p):
    """PERCENTILE_CONT on float8 as PostgreSQL computes it: position p*(n-1) in double, rows
    floor/ceil of it, then lo + (hi - lo) * (position - floor)."""
    s = sorted(values)
    pos = p * (len(s) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return s[lo] if lo == hi else s[lo] + (s[hi] - s[lo]) * (pos - lo)


DYADIC = {0.0, 0.25, 0.5, 0.75, 1.0}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), n=st.integers(1, 400),
       probs=st.lists(st.sampled_from([0.0, 0.01, 0.1, 0.25, 0.333, 0.5, 0.75, 0.9, 0.99, 1.0]),
                      min_size=1, max_size=4, unique=True))
def test_random_sizes_and_probabilities(spark, seed, n, probs):
    rnd = random.Random(seed)
    pool = [round(rnd.uniform(0, 50), 2) for _ in range(max(1, n // 5))]     # many duplicates
    vals = [rnd.choice(pool) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    named = {f"p{i}": p for i, p in enumerate(probs)}
    got = exact_percentiles(df, "v", named).first()
    for k, p in named.items():
        assert got[k] == _sql_percentile_cont(vals, p), (k, p, n)
        if p in DYADIC:           # DuckDB agrees exactly whenever the fraction is dyadic
            assert got[k] == _duck(vals, p), (k, p, n)


def test_values_of_any_shape(spark):
    """Many ranges, two probabilities in one range, ranks in neighbouring ranges, no values at all."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in conf}
    rnd = random.Random(9)
    shapes = [[2.0 ** e for e in range(-500, 500, 7)], [1.0] * 500, [rnd.lognormvariate(3, 4) for _ in range(3000)],
              [-1e308, 0.0, 1e308], [float(i % 14) for i in range(1400)]]
    probs = {"a": 0.0, "b": 0.25, "c": 0.26, "d": 0.5, "e": 0.75, "f": 0.999, "g": 1.0}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for vals in shapes:
            got = exact_percentiles(spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double").repartition(5), "v", probs).first()
            for k, p in probs.items():
                assert got[k] == _sql_percentile_cont(vals, p), (k, vals[:3])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    nothing = exact_percentiles(spark.createDataFrame([(None,)], "v double"), "v", probs).collect()
    assert [set(r) for r in nothing] == [{None}]


def test_bytes_into_one_task_do_not_grow_with_map_tasks(tmp_path):
    """Event log of the same column read by 4 and by 32 tasks: the largest shuffle read of a stage with one
    task (the ranges' array, the final row) is the same."""
    import json
    import subprocess
    import sys

    script = """
import sys
from lanescope.session import local_session
from lanescope.operators.quantile import exact_percentiles
spark = local_session(4, 8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + sys.argv[1],
    "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
df = spark.range(0, 400000, 1, int(sys.argv[2])).selectExpr("cast((id * 7919) % 50021 as double) / 100 as v")
print(exact_percentiles(df, "v", {"q1": 0.25, "q3": 0.75}).first())
spark.stop()
"""
    found = {}
    for tasks in (4, 32):
        folder = tmp_path / str(tasks)
        folder.mkdir()
        subprocess.run([sys.executable, "-c", script, str(folder), str(tasks)], check=True, timeout=300,
                       cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True)
        stages: dict = {}
        for line in next(folder.iterdir()).open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd":
                read = event["Task Metrics"]["Shuffle Read Metrics"]
                stages.setdefault(event["Stage ID"], []).append(read["Local Bytes Read"] + read["Remote Bytes Read"])
        found[tasks] = max(x[0] for x in stages.values() if len(x) == 1)
    assert found[32] <= 1.2 * found[4] + 2000, found
