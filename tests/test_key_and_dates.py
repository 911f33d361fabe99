"""Enforced key, strict dates, month calendar, Pareto by steps."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import staging
from lanescope.operators import clean as C
from lanescope.operators import quality as Q
from lanescope.sources import store

ROW = dict(origin_warehouse="W", destination="D", carrier="C", shipment_date="2024-01-05", cost="1")


def kept_and_away(spark, rows, mode="quarantine"):
    parsed = store.cut(C.parse_staging(staging(spark, rows).repartition(3), keep_raw=True), "parsed")
    out = C.enforce_key(parsed, mode).collect()
    return sorted((r.shipment_id, str(r.shipment_date), str(r.cost)) for r in out if r.reject_reason is None), sorted(
        (r.raw_shipment_id or "", r.reject_reason) for r in out if r.reject_reason)


def test_one_row_of_each_id_stays(spark):
    rows = [{**ROW, "shipment_id": "a", "cost": "3"}, {**ROW, "shipment_id": " a "}, {**ROW, "shipment_id": "a", "shipment_date": "2024-01-06"},
            {**ROW, "shipment_id": "b"}, {**ROW, "shipment_id": "c"}, {**ROW, "shipment_id": "c"}, {**ROW, "shipment_id": ""}, {**ROW, "shipment_id": " "},
            {**ROW, "shipment_id": "d", "shipment_date": ""}, {**ROW, "shipment_id": "d"}]
    kept, away = kept_and_away(spark, rows)
    assert kept == [("a", "2024-01-05", "1.00"), ("b", "2024-01-05", "1.00"), ("c", "2024-01-05", "1.00"), ("d", "2024-01-05", "1.00")]
    assert away == [("", C.MISSING_ID), ("", C.MISSING_ID), ("", C.REPEATED_ID), ("", C.REPEATED_ID), ("", C.REPEATED_ID),
                    ("d", "shipment_date missing")]
    with pytest.raises(Exception, match="broken key"):
        kept_and_away(spark, rows, "strict")
    assert kept_and_away(spark, rows[3:4], "strict") == ([("b", "2024-01-05", "1.00")], [])
    assert kept_and_away(spark, []) == ([], [])


def test_a_hot_id_and_many_missing_ids(spark):
    rnd = random.Random(1)
    rows = [{**ROW, "shipment_id": rnd.choice(["hot", "", f"x{i}", f"y{i % 40}"]), "cost": str(rnd.randint(1, 9))} for i in range(2000)]
    kept, away = kept_and_away(spark, rows)
    first = {}
    for r in rows:
        if r["shipment_id"]:
            first[r["shipment_id"]] = min(first.get(r["shipment_id"], "9"), r["cost"])
    assert kept == sorted((k, "2024-01-05", f"{v}.00") for k, v in first.items())
    assert len(kept) + len(away) == len(rows)


@pytest.mark.parametrize("text,date", [("2024-01-05", (2024, 1, 5)), (" 2024-1-5 ", (2024, 1, 5)), ("2024-01-05 10:30", (2024, 1, 5)),
                                       ("2024-01-05T10:30:11.5", (2024, 1, 5)), ("2024", None), ("2024-1", None), ("2024-01-", None),
                                       ("2024-02-30", None), ("05.01.2024", None), ("2024-01-05x", None), ("20240105", None)])
def test_dates_are_whole(spark, text, date):
    st = staging(spark, [{**ROW, "shipment_id": "a", "shipment_date": text}, {**ROW, "shipment_id": "b", "delivery_date": text}])
    rows = {r.shipment_id: r for r in C.parse_staging(st).collect()}
    if date:
        assert rows["a"].shipment_date == rows["b"].delivery_date == dt.date(*date)
        assert rows["a"].reject_reason is rows["b"].reject_reason is None
    else:
        assert (rows["a"].reject_reason, rows["b"].reject_reason) == ("shipment_date unparseable", "delivery_date unparseable")


def test_dates_by_a_stated_pattern(spark):
    st = staging(spark, [{**ROW, "shipment_id": "a", "shipment_date": "05.01.2024"}, {**ROW, "shipment_id": "b"}])
    rows = {r.shipment_id: (r.shipment_date, r.reject_reason) for r in C.parse_staging(st, date_format="dd.MM.yyyy").collect()}
    assert rows == {"a": (dt.date(2024, 1, 5), None), "b": (None, "shipment_date unparseable")}


def test_a_month_without_rows_is_no_neighbour(spark):
    seg = spark.createDataFrame([("A", dt.date(2023, m, 1), 10 * m) for m in (11, 12)] + [("A", dt.date(2024, m, 1), m) for m in (1, 4, 5)]
                                + [("B", dt.date(2024, 2, 1), 7)], "wh string, month date, x int")
    got = [(r.wh, r.month.month, r.x, r.x_change) for r in Q.change_over_previous(seg, ["wh"], "month", ["x"]).orderBy("wh", "month").collect()]
    assert got == [("A", 11, 110, None), ("A", 12, 120, 10), ("A", 1, 1, -119), ("A", 2, None, None), ("A", 3, None, None), ("A", 4, 4, None),
                   ("A", 5, 5, 1), ("B", 2, 7, None)]


def test_pareto_by_steps_equals_one_window(spark):
    rnd = random.Random(4)
    seg = spark.createDataFrame([(g, f"w{i % 9}", f"d{i}", rnd.choice([1, 1, 1, 2, 3, rnd.randint(1, 99)])) for g in "abc" for i in range(300)] + [("z", "w", "d", 0), (None, "w", None, 2), (None, None, "d", 2)],
                                "g string, wh string, dest string, x bigint")
    w = Window.partitionBy("g").orderBy(F.desc("x"), "wh", "dest")
    total = F.nullif(F.sum("x").over(Window.partitionBy("g")), F.lit(0))
    want = seg.select("g", "wh", "dest", "x", F.row_number().over(w).alias("rank"), F.round(
        (F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100).cast("decimal(22,0)") / total, 2).cast("decimal(5,2)").alias("cum_share_pct"))
    got = Q.pareto(seg, ["g"], ["wh", "dest"], "x")
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
