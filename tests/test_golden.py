"""Stage-2 checks on the published result tables: recompute labels / scores / priorities from
the other columns of each golden row and compare exactly."""

from decimal import Decimal

from pyspark.sql import functions as F, types as T

from lanescope.operators.benchmark import attach, averages, medians, position_2x2, ratio_score

# Golden rows of the analysed project's result files (fixed values).
CARRIERS = [
    ("LaserShip", 303, "203.06", "4.04", "FAST and CHEAP (best)"),
    ("OnTrac", 299, "182.13", "4.12", "FAST and CHEAP (best)"),
    ("FedEx", 295, "217.23", "4.30", "SLOW and EXPENSIVE (worst)"),
    ("USPS", 292, "175.78", "4.05", "FAST and CHEAP (best)"),
    ("DHL", 281, "217.39", "4.27", "SLOW and EXPENSIVE (worst)"),
    ("Amazon Logistics", 274, "188.96", "4.32", "SLOW but CHEAP"),
    ("UPS", 256, "225.23", "4.20", "SLOW and EXPENSIVE (worst)"),
]
LANES = [
    ("Warehouse_LA", "New York", 22, "200.75", "9.09", "4.55", "7.16"),
    ("Warehouse_MIA", "Detroit", 23, "193.34", "13.04", "0.00", "2.62"),
    ("Warehouse_LA", "Chicago", 21, "193.63", "9.52", "0.00", "2.18"),
    ("Warehouse_LA", "Dallas", 24, "228.49", "4.17", "0.00", "1.69"),
    ("Warehouse_CHI", "Denver", 25, "164.53", "4.00", "0.00", "1.34"),
]
WAREHOUSES = [("HOU", 212, 4, 848), ("SF", 215, 3, 645), ("MIA", 201, 3, 603), ("ATL", 207, 2, 414),
              ("SEA", 190, 2, 380), ("LA", 220, 1, 220), ("BOS", 192, 1, 192), ("CHI", 197, 0, 0),
              ("DEN", 196, 0, 0), ("NYC", 170, 0, 0)]

DEC = T.DecimalType(14, 2)


def test_carrier_positions_from_medians(spark):
    df = spark.createDataFrame(
        [(c, n, Decimal(cpu), Decimal(d)) for c, n, cpu, d, _ in CARRIERS],
        T.StructType([T.StructField("carrier", T.StringType()), T.StructField("shipments", T.LongType()),
                      T.StructField("cost_per_unit", DEC), T.StructField("avg_transit_days", DEC)]))
    med = medians(df, ["cost_per_unit", "avg_transit_days"]).first()
    assert (med["med_cost_per_unit"], med["med_avg_transit_days"]) == (203.06, 4.20)
    wide, m = attach(df, medians(df, ["cost_per_unit", "avg_transit_days"]))
    got = dict(wide.select("carrier", position_2x2(F.col("cost_per_unit"), F.col("avg_transit_days"),
                                                   m["med_cost_per_unit"], m["med_avg_transit_days"])
                           .alias("p")).collect())
    assert got == {c: label for c, _, _, _, label in CARRIERS}


def test_lane_badness_from_averages(spark):
    df = spark.createDataFrame(
        [(o, d, n, Decimal(c), Decimal(dl), Decimal(r)) for o, d, n, c, dl, r, _ in LANES],
        "origin_warehouse string, destination string, shipments bigint, cost_per_unit decimal(14,2), "
        "delay_rate decimal(5,2), returned_rate decimal(5,2)")
    keys = ["cost_per_unit", "delay_rate", "returned_rate"]
    avg = averages(df, keys).first()
    assert [round(float(avg[f"avg_{k}"]), 3) for k in keys] == [196.148, 7.964, 0.91]
    wide, a = attach(df, averages(df, keys))
    got = {(r[0], r[1]): r[2] for r in wide.select(
        "origin_warehouse", "destination",
        ratio_score([(F.col(k), a[f"avg_{k}"]) for k in keys]).alias("s")).collect()}
    assert got == {(o, d): Decimal(s) for o, d, _, _, _, _, s in LANES}


def test_no_returns_anywhere_makes_every_score_null(spark):
    df = spark.createDataFrame([(Decimal("10.00"), Decimal("0.00")), (Decimal("12.00"), Decimal("0.00"))],
                               "cost_per_unit decimal(14,2), returned_rate decimal(5,2)")
    keys = ["cost_per_unit", "returned_rate"]
    wide, a = attach(df, averages(df, keys))
    assert [r[0] for r in wide.select(ratio_score([(F.col(k), a[f"avg_{k}"]) for k in keys])).collect()] == [None, None]


def test_priority_is_volume_times_flags(spark):
    df = spark.createDataFrame([(w, n, f) for w, n, f, _ in WAREHOUSES],
                               "origin_warehouse string, shipment_count bigint, flag_count int")
    got = dict(df.select("origin_warehouse", (F.col("shipment_count") * F.col("flag_count")).alias("p")).collect())
    assert got == {w: p for w, _, _, p in WAREHOUSES}


# Visible deltas of the published warehouse scorecard (fixed values):
# warehouse, delivered pp, delay pp, return pp, cost/unit %, cost/kg %, flag_count
WAREHOUSE_DELTAS = [
    ("HOU", "-2.68", "1.84", "1.23", "13.03", "26.58", 4),
    ("SF", "-3.80", "1.21", "1.66", "-1.29", "11.41", 3),
    ("MIA", "-4.29", "1.49", "-0.11", "0.33", "19.22", 3),
    ("ATL", "-3.66", "0.68", "-0.15", "-2.68", "-4.20", 2),
    ("SEA", "2.34", "-0.48", "1.03", "2.74", "24.62", 2),
    ("LA", "0.33", "0.50", "-0.69", "12.16", "1.20", 1),
    ("BOS", "1.45", "-1.10", "-1.08", "-0.62", "-42.19", 1),
    ("CHI", "3.39", "0.71", "-0.58", "-10.09", "-5.86", 0),
    ("DEN", "2.29", "-1.79", "-0.58", "-9.27", "5.56", 0),
    ("NYC", "6.42", "-4.07", "-1.01", "-7.48", "2.10", 0),
]
LOST_FLAG_IMPLIED = {"MIA", "ATL", "BOS"}     # their visible flags are one short of flag_count


def test_flag_counts_from_published_deltas(spark):
    from lanescope.operators.benchmark import Rule, versus
    from lanescope.plans.analyses import scorecard_rules

    rules = {r.kpi: r for r in scorecard_rules() if r.flag}
    # segment value = benchmark + delta (points), or 100 * (1 + pct/100) against 100 (ratios)
    rows = [(w, Decimal(d), Decimal(dl), Decimal(r), Decimal("100") + Decimal(cu), Decimal("100") + Decimal(ck))
            for w, d, dl, r, cu, ck, _ in WAREHOUSE_DELTAS]
    seg = spark.createDataFrame(rows, "w string, delivered_rate decimal(10,2), delay_rate decimal(10,2), "
                                      "returned_rate decimal(10,2), cost_per_unit decimal(10,2), "
                                      "cost_per_kg decimal(10,2)")
    bench = spark.createDataFrame([(Decimal(0), Decimal(0), Decimal(0), Decimal(100), Decimal(100))],
                                  "delivered_rate decimal(10,2), delay_rate decimal(10,2), "
                                  "returned_rate decimal(10,2), cost_per_unit decimal(10,2), "
                                  "cost_per_kg decimal(10,2)")
    used = [rules[k] for k in ("delivered_rate", "delay_rate", "returned_rate", "cost_per_unit", "cost_per_kg")]
    out = {r.w: r.n for r in versus(seg, bench, used, flag_count="n").collect()}
    expected = {w: n - (1 if w in LOST_FLAG_IMPLIED else 0) for w, *_, n in WAREHOUSE_DELTAS}
    assert out == expected
