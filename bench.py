"""Benchmark: time every registered query on the driver tables.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3). Prints ONE JSON line:

  {"metric": "sum_query_sec", "value": <sum of per-query medians>, "unit": "sec",
   "queries": {name: median_sec, ...}, "load_clean_sec": <store build>,
   "stream_sec": {name: sec}, "sf": ...}

Streaming queries (an ingest job: landing files -> micro-batches -> state -> snapshot) are timed
once each and reported under ``stream_sec``, apart from the analytic queries, like the store
build under ``load_clean_sec``.

Phases: (1) build the parsed and clean tables from the driver tables (timed once, fresh key);
(2) one warm-up run of every query; (3) BENCH_REPEAT timed runs per query, each fully
executed into Spark's ``noop`` sink; the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))

    from lanescope.session import local_session
    from lanescope.sources import store
    spark = local_session(cpus, cpus, app="lanescope-bench")

    from lanescope.plans import registry as R

    store.NAMESPACE = f"bench-{uuid.uuid4().hex[:8]}"
    t0 = time.perf_counter()
    R.log_data_for(spark, sf_dir).count()
    load_sec = time.perf_counter() - t0

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def yardstick() -> float:
        """Seconds of a fixed Spark job that uses nothing of this package: tells the host's speed from the code's."""
        samples = []
        for _ in range(repeat + 1):
            t = time.perf_counter()
            run(spark.range(0, 4_000_000, 1, cpus).selectExpr("id % 1000 AS k", "id * 7919 % 1000003 AS v").groupBy("k").agg({"v": "sum"}).orderBy("k"))
            samples.append(time.perf_counter() - t)
        return round(statistics.median(samples[1:]), 4)

    streams = {n: f for n, f in R.QUERIES.items() if n.startswith("stream_")}
    analytic = {n: f for n, f in R.QUERIES.items() if n not in streams}
    for name, fn in analytic.items():        # warm-up (JIT, file listing, code generation)
        run(fn(spark, sf_dir))

    stream_times: dict[str, float] = {}
    for name, fn in streams.items():
        t = time.perf_counter()
        run(fn(spark, sf_dir))
        stream_times[name] = round(time.perf_counter() - t, 3)

    times: dict[str, float] = {}
    for name, fn in analytic.items():
        samples = []
        for _ in range(repeat):
            t = time.perf_counter()
            run(fn(spark, sf_dir))
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 4)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "load_clean_sec": round(load_sec, 3),
        "stream_sec": stream_times,
        "yardstick_sec": yardstick(),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
