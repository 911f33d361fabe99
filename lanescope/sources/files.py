"""CSV / Parquet sources and sinks.

* ``read_staging_csv``: header CSV -> 11 text columns with the fixed staging schema (nothing is
  inferred; the file may live on any Hadoop-compatible store the cluster can read). A quote inside
  a quoted field is doubled, on reading and on writing.
* ``read_result_csv``: read an exported result back with an explicit schema.
* ``export_csv``: write a result with a header line. Results are small aggregates; ``single_file``
  coalesces to one part file only for those (never for a table that grows with the data).
* ``publish_views``: register the clean table and the data-issue view for Spark SQL users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .schema import STAGING_SCHEMA


#: Quotes inside quoted fields are doubled, not escaped by a backslash.
QUOTES = {"quote": '"', "escape": '"'}


#: Column of a staging frame with the raw record of a row that has too few or too many fields, else NULL.
MALFORMED = "malformed_record"


def read_staging_csv(spark: SparkSession, path: str, strict: bool = False, multi_line: bool = False,
                     **options) -> DataFrame:
    """Header CSV with the staging columns, every field as text (``\\copy ... CSV HEADER``).

    A row with too few or too many fields keeps its raw record in the column ``malformed_record``, so that
    cleaning sets it aside with that record; ``strict`` stops the load there instead and has no such column.
    ``multi_line`` allows line breaks inside quoted fields: the files' lines are written once to the shared folder and
    put together from there (``quoted_csv``), so large files are still read by many tasks.
    """
    options = {**QUOTES, **options}
    if multi_line:
        from . import quoted_csv, store
        lines = quoted_csv.line_table(spark, path, store.scratch(spark, "csv-lines"))
        return quoted_csv.parsed(quoted_csv.records(lines), STAGING_SCHEMA.names, MALFORMED, options, strict)
    # a pruned read would not count the fields of a row
    reader = (spark.read.option("header", True).options(**options).option("enforceSchema", False).option("columnPruning", False))
    if strict:
        return reader.schema(STAGING_SCHEMA).option("mode", "FAILFAST").csv(path)
    return (reader.schema(StructType([*STAGING_SCHEMA.fields, StructField(MALFORMED, StringType())])).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", MALFORMED).csv(path))


def read_result_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).options(**QUOTES).csv(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write ``df`` as header CSV (``\\copy (query) TO file CSV HEADER``)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).options(**QUOTES).csv(path)


def publish_views(spark: SparkSession, log_data: DataFrame, prefix: str = "",
                  analyses: bool = False) -> list[str]:
    """Temp views ``log_data`` and ``v_data_issues`` over the clean table; with ``analyses``
    also one view per named analysis (``warehouse_scorecard``, ``worst_lanes``, ...), so SQL
    users can select from them. Views are lazy: nothing runs until a query reads one."""
    from ..operators.clean import data_issues
    names = [f"{prefix}log_data", f"{prefix}v_data_issues"]
    log_data.createOrReplaceTempView(names[0])
    data_issues(log_data).createOrReplaceTempView(names[1])
    if analyses:
        from ..plans.registry import REPORTS
        for name, fn in REPORTS.items():
            if f"{prefix}{name}" in names:
                continue
            fn(log_data).createOrReplaceTempView(f"{prefix}{name}")
            names.append(f"{prefix}{name}")
    return names
