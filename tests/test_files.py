"""CSV round trip: staging CSV -> clean table -> result CSV -> read back; views for SQL users."""

import os
import random
import tempfile

import pytest

from lanescope.operators import clean as C
from lanescope.plans import analyses as A
from lanescope.plans.registry import edge
from lanescope.sources import files, quoted_csv


def test_csv_round_trip_and_views(spark):
    d = tempfile.mkdtemp(prefix="lanescope-files-", dir=os.environ.get("TMPDIR", "/tmp"))
    src = os.path.join(d, "shipments.csv")
    with open(src, "w") as fh:
        fh.write("shipment_id,origin_warehouse,destination,carrier,shipment_date,delivery_date,"
                 "weight_kg,cost,status,distance_miles,transit_days\n")
        fh.write('a,Warehouse_HOU,Dallas,UPS,2024-01-01,2024-01-03,"1,234.5",203.06,Delivered,"1,000",2\n')
        fh.write("b,Warehouse_HOU,Austin,UPS,2024-01-02,,12.5,,Lost,99.999,\n")
        fh.write("c,Warehouse_SF,Austin,DHL,2024-02-02,2024-02-09,3,100.5,Delayed,100,1\n")
    st = files.read_staging_csv(spark, src)
    assert st.count() == 3 and all(t == "string" for _, t in st.dtypes)
    log = C.log_data(st)
    files.publish_views(spark, log)
    assert spark.sql("SELECT count(*) FROM log_data").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM v_data_issues").first()[0] == 0
    out = os.path.join(d, "kpi")
    files.export_csv(edge(A.warehouse_kpi(log)), out, single_file=True)
    back = files.read_result_csv(spark, out, "origin_warehouse string, shipment_count long, "
                                             "avg_transit_days double, cost_per_kg double")
    rows = {r.origin_warehouse: r for r in back.collect()}
    assert rows["Warehouse_HOU"].shipment_count == 2 and rows["Warehouse_SF"].avg_transit_days == 7.0


HEADER = ("shipment_id,origin_warehouse,destination,carrier,shipment_date,delivery_date,"
          "weight_kg,cost,status,distance_miles,transit_days\n")
FIELDS = "2024-01-01,2024-01-03,1,2,Delivered,3,2\n"


def _csv(rows: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="lanescope-csv-"), "in.csv")
    with open(path, "w") as fh:
        fh.write(HEADER + rows)
    return path


def test_doubled_quotes_survive_the_round_trip(spark):
    st = files.read_staging_csv(spark, _csv('a,W,"New ""York"", NY",UPS,' + FIELDS))
    assert [(r.destination, r.carrier, r.transit_days) for r in st.collect()] == [('New "York", NY', "UPS", "2")]
    out = tempfile.mkdtemp(prefix="lanescope-csv-")
    files.export_csv(st.select("destination", "carrier"), out)
    assert [tuple(r) for r in files.read_result_csv(spark, out, "destination string, carrier string").collect()] \
        == [('New "York", NY', "UPS")]


def test_quoted_line_break_is_one_row(spark):
    st = files.read_staging_csv(spark, _csv('a,W,"New\nYork",UPS,' + FIELDS), multi_line=True)
    assert [r.destination for r in st.collect()] == ["New\nYork"]


def _random_field(rnd):
    kind = rnd.random()
    if kind < 0.5:
        return rnd.choice(["a", "12", " x ", "", "é漢"])
    inner = "".join(rnd.choice(["a", " ", ",", '""', "\n", "\r\n", "\n\n", "é"]) for _ in range(rnd.randint(0, 8)))
    return f'"{inner}"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_equal_the_whole_file_reader(spark, end):
    """Random quoted text in two files of many byte ranges: the same rows as from Spark's one-task reader."""
    rnd, folder = random.Random(len(end)), tempfile.mkdtemp(prefix="lanescope-csv-")
    for name in "ab":
        rows = [",".join(_random_field(rnd) for _ in range(11)) for _ in range(400)]
        rows[50] = ",".join(["q", '"' + "long\n" * 900 + '"', *["z"] * 9])       # spans several ranges
        rows[60] = ""
        with open(f"{folder}/{name}.csv", "w", newline="", encoding="utf-8") as fh:
            fh.write(HEADER.strip() + end + end.join(rows) + (end if name == "a" else ""))
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = files.read_staging_csv(spark, folder, multi_line=True)
        lines = quoted_csv.line_table(spark, folder, f"{tempfile.mkdtemp(prefix='lanescope-csv-')}/lines")
        assert lines.select("file", "start").distinct().count() > 20
        rows = got.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = (spark.read.schema(got.drop(files.MALFORMED).schema).option("header", True).options(**files.QUOTES)
             .option("multiLine", True).csv(folder))
    want = sorted(map(tuple, whole.collect()), key=str)
    assert len(want) == 798
    if end == "\r\n":         # Spark's reader turns the file's line ends into line feeds inside quotes too, ours keeps them
        rows = [tuple(x and x.replace(end, "\n") for x in r) for r in rows]
    assert sorted((tuple(r)[:-1] for r in rows), key=str) == want
    assert {r[-1] for r in rows} == {None}


@pytest.mark.parametrize("multi_line", [False, True])
def test_wrong_field_counts_are_quarantined_with_their_record(spark, multi_line):
    bad = ["b,W,D,UPS,x," + FIELDS.strip(), "c,W,D,UPS,2024-01-01"]
    if multi_line:
        bad.append('d,"W\nX",D')
    path = _csv("a,W,D,UPS," + FIELDS + "".join(r + "\n" for r in bad))
    st = files.read_staging_csv(spark, path, multi_line=multi_line)
    assert [r.shipment_id for r in C.clean_shipments(st).collect()] == ["a"]
    away = C.quarantine_rows(st).collect()
    assert sorted((r.record, r.reject_reason) for r in away) == sorted((r, "wrong number of fields") for r in bad)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_staging_csv(spark, path, strict=True, multi_line=multi_line).select("carrier").collect()


def test_another_header_stops_the_range_reader(spark):
    path = _csv("a,W,D,UPS," + FIELDS)
    text = open(path).read().replace("carrier", "haulier")
    open(path, "w").write(text)
    with pytest.raises(Exception, match="header"):
        files.read_staging_csv(spark, path, multi_line=True).collect()


@pytest.mark.parametrize("row", ["a,W,D,UPS,x," + FIELDS, "a,W,D,UPS,2024-01-01\n"])
def test_wrong_field_count_stops_a_strict_load(spark, row):
    path = _csv("a,W,D,UPS," + FIELDS + row)
    assert files.read_staging_csv(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_staging_csv(spark, path, strict=True).select("carrier").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_staging_csv(spark, path, strict=True).agg({"cost": "max"}).collect()


def test_cli_report_writes_the_final_outputs(spark):
    import glob

    from lanescope.__main__ import main
    out = tempfile.mkdtemp(prefix="lanescope-report-")
    assert main(["report", "--tpch", "/root/testdata/sf0.001", "--out", out]) == 0
    for name in ("warehouse_scorecard", "carrier_scorecard", "destination_scorecard"):
        parts = glob.glob(f"{out}/{name}/part-*.csv")
        assert len(parts) == 1
        header = open(parts[0]).readline().strip().split(",")
        assert header[0] in ("origin_warehouse", "carrier")


def test_views_for_sql_users(spark):
    from lanescope.plans.registry import log_data_for
    names = files.publish_views(spark, log_data_for(spark, "/root/testdata/sf0.001"), prefix="t_",
                                analyses=True)
    assert "t_warehouse_scorecard" in names
    top = spark.sql("SELECT origin_warehouse FROM t_warehouse_scorecard "
                    "ORDER BY priority_score DESC, shipment_count DESC LIMIT 1").first()[0]
    assert top.startswith("NATION_")


def test_library_path_equals_store_path(spark):
    from lanescope.plans.registry import log_data_for, staging_for
    sf = "/root/testdata/sf0.001"
    direct = C.log_data(staging_for(spark, sf))
    stored = log_data_for(spark, sf)
    assert sorted(direct.collect()) == sorted(stored.collect())


def test_cli_report_from_staging_csv(spark):
    import glob

    from lanescope.__main__ import main
    from lanescope.plans.registry import staging_for
    from lanescope.streaming.ingest import write_staging_files
    d = tempfile.mkdtemp(prefix="lanescope-cli-")
    write_staging_files(staging_for(spark, "/root/testdata/sf0.001"), f"{d}/landing")
    assert main(["report", "--staging", f"{d}/landing/*.csv", "--out", f"{d}/out", "--all"]) == 0
    written = {p.split("/")[-2] for p in glob.glob(f"{d}/out/*/part-*.csv")}
    assert {"warehouse_scorecard", "carrier_scorecard", "destination_scorecard", "decision_scorecard"} <= written
    back = files.read_result_csv(spark, f"{d}/out/warehouse_scorecard",
                                 "origin_warehouse string, shipment_count long")
    ref = edge(A.warehouse_scorecard(C.log_data(staging_for(spark, "/root/testdata/sf0.001"))))
    assert sorted((r[0], r[1]) for r in back.collect()) == sorted((r[0], r[1]) for r in ref.collect())
