"""lanescope — shipment KPI analytics as Spark DataFrame / SQL jobs.

Layers:

* ``sources``   — staging schema, CSV/Parquet readers and writers, the clean-table store,
                  and the adapter that derives staging rows from the driver's TPC-H-like tables.
* ``functions`` — column-expression builders (parsing, exact ratios, rounding, buckets, labels).
* ``operators`` — DataFrame -> DataFrame operators (clean, impute, KPI measures, segment,
                  benchmark/versus, exact quantiles, top-k, data quality).
* ``plans``     — the named analyses (warehouse scorecard, carrier positioning, worst lanes, ...)
                  and the registry used by ``__spark_entry__``.
* ``streaming`` — incremental ingest of staging CSV files with Structured Streaming.
"""

__version__ = "0.1.0"
