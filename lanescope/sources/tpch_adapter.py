"""Derive dirty shipment staging rows from the driver's TPC-H-like tables.

The shipment CSV of the analysed project is not available, so every query of this package runs
on staging rows that Spark derives from ``lineitem ⋈ orders ⋈ customer ⋈ supplier ⋈ nation``.
One lineitem is one shipment:

* origin warehouse = the supplier's nation, destination = the customer's nation,
  carrier = ``CARRIER_<l_linenumber>`` (7 carriers);
* a deterministic mixer ``m`` in [0, 1000) of the lineitem keys decides status, missing fields
  and dirty spellings, with status shares that depend on the supplier's nation and the line
  number so that segments really differ.

Only integer arithmetic is used, so the same rules written in DuckDB SQL (the oracle) give the
same text byte for byte. Every branch of the cleaning step is reached: padded and blank labels,
blank and lower-case status, missing dates, thousands separators, extra decimals that round,
blank costs for the mean imputation and cost outliers for the IQR check.

Scale notes: lineitem and orders are joined on ``orderkey`` (shuffle join at scale);
supplier, customer and nation are joined by key and Spark broadcasts them automatically when
their statistics are under ``spark.sql.autoBroadcastJoinThreshold`` (a checked size), else it
falls back to a sort-merge join. Only the needed columns are read from Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schema import STAGING_COLUMNS

DRIVER_TABLES = ("lineitem", "orders", "customer", "supplier", "nation")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _int(c: Column) -> Column:
    return c.cast("bigint")


def _txt(c: Column) -> Column:
    return c.cast("string")


def _thousands(v: Column) -> Column:
    """Integer 0 <= v < 1e6 written with a thousands separator when v >= 1000."""
    return F.when(v >= 1000, F.concat(_txt(F.floor(v / 1000)), F.lit(","),
                                      F.lpad(_txt(v % 1000), 3, "0"))).otherwise(_txt(v))


def shipment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed join of the driver tables with the helper columns of the adapter."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sup = (read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
           .join(nation.withColumnRenamed("n_nationkey", "s_nationkey")
                 .withColumnRenamed("n_name", "s_nation"), "s_nationkey"))
    cust = (read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(nation.withColumnRenamed("n_nationkey", "c_nationkey")
                  .withColumnRenamed("n_name", "c_nation"), "c_nationkey"))
    orders = (read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "c_nationkey", "c_nation"))
    j = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    c = F.col
    m = (c("l_orderkey") * 31 + c("l_linenumber") * 17 + c("l_partkey") * 7 + c("l_suppkey")) % 1000
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_nation", "c_nation",
        c("l_shipdate").cast("date").alias("ship_d"),
        _int(m).alias("m"),
        _int(F.abs(c("s_nationkey") - c("c_nationkey")) * 120 + 10 + c("l_partkey") % 90).alias("dist"),
        _int(c("s_nationkey") % 4 * 15 + 5).alias("lost_t"),
        _int(c("s_nationkey") % 3 * 8 + 10).alias("ret_w"),
        _int(c("s_nationkey") % 5 * 25 + 60 + c("l_linenumber") * 6).alias("delay_w"),
        # price in cents (l_extendedprice has two decimals) times a nation/line cost factor
        F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) "
               "* (80 + 15 * (s_nationkey % 6) + 5 * l_linenumber) div 20000").alias("cents"),
        _int(F.round(c("l_quantity"))).alias("qty"),
    )


def staging_from_facts(f: DataFrame, *, short_ids: bool = False,
                       blank_ship_every: int | None = 500) -> DataFrame:
    """Staging text columns (all STRING) from ``shipment_facts``.

    Ids are ``orderkey-linenumber-partkey-suppkey``, except blank ones (``m % 499 == 0``) and short
    ``orderkey-linenumber`` ones (``m % 9 == 4``) that repeat: both reach the duplicate check.
    ``short_ids`` uses the short id for every row;
    ``blank_ship_every=k`` blanks the ship date when ``m % k == 11``: such rows violate NOT NULL
    and are quarantined by the cleaning step (``None`` turns it off).
    """
    c = F.col
    m = c("m")
    ship_txt = _txt(c("ship_d"))
    if blank_ship_every:
        ship_txt = F.when(m % blank_ship_every == 11, F.lit(" ")).otherwise(ship_txt)
    short = F.concat_ws("-", "l_orderkey", "l_linenumber")
    if short_ids:
        sid = short
    else:
        # mostly unique ids; some blank (they all become UNKNOWN) and some short ones that collide
        sid = (F.when(m % 499 == 0, F.lit(" ")).when(m % 9 == 4, short)
               .otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    cost_cents = c("cents") * F.when(m % 333 == 5, 8).otherwise(1)
    dollars, cents = F.floor(cost_cents / 100), cost_cents % 100
    cost_txt = (F.when(m % 200 == 3, F.lit(" "))
                .when((m % 7 == 0) | (m % 333 == 5),          # outliers are large: separators
                      F.concat(_thousands(dollars), F.lit("."), F.lpad(_txt(cents), 2, "0")))
                .when(m % 11 == 0, F.concat(_txt(dollars), F.lit("."), F.lpad(_txt(cents), 2, "0"), F.lit("5")))
                .otherwise(F.concat(_txt(dollars), F.lit("."), F.lpad(_txt(cents), 2, "0"))))
    kg = c("qty") * (m % 3 + 1)
    weight_txt = (F.when(m % 250 == 1, F.lit(""))
                  .when(m % 13 == 0, F.concat(_txt(kg), F.lit(".2505")))
                  .otherwise(_txt(kg)))
    lost_t, ret_end = c("lost_t"), c("lost_t") + c("ret_w")
    status = (F.when(m % 500 == 19, F.lit(""))
              .when(m < lost_t, F.lit("Lost"))
              .when(m < ret_end, F.lit("Returned"))
              .when(m < ret_end + c("delay_w"), F.lit("Delayed"))
              .when(m % 250 == 17, F.lit(" delivered "))
              .otherwise(F.lit("Delivered")))
    delivery = (F.when((m < lost_t) | (m % 200 == 7) | (m % 250 == 17), F.lit(""))
                .otherwise(_txt(F.date_add(c("ship_d"), _int((m + c("l_linenumber")) % 5 + 2).cast("int")))))
    origin = (F.when(m == 999, F.lit("  "))
              .when(m % 2 == 0, F.concat(F.lit("  "), c("s_nation"), F.lit(" ")))
              .otherwise(c("s_nation")))
    out = {
        "shipment_id": sid,
        "origin_warehouse": origin,
        "destination": c("c_nation"),
        "carrier": F.concat(F.lit("CARRIER_"), _txt(c("l_linenumber"))),
        "shipment_date": ship_txt,
        "delivery_date": delivery,
        "weight_kg": weight_txt,
        "cost": cost_txt,
        "status": status,
        "distance_miles": _thousands(c("dist")),
        "transit_days": _txt(m % 5 + 2),
    }
    return f.select(*[out[name].alias(name) for name in STAGING_COLUMNS])


def staging_from_tpch(spark: SparkSession, sf_dir: str, **variant) -> DataFrame:
    return staging_from_facts(shipment_facts(spark, sf_dir), **variant)
