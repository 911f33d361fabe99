"""The versioned store: keys, publishing, damaged and half-written tables, skipping by file and by id."""

import glob
import json
import os
import re
import subprocess
import sys

import pytest

from lanescope.plans.registry import log_data_from_csv
from lanescope.sources import store

HEADER = ("shipment_id,origin_warehouse,destination,carrier,shipment_date,delivery_date,"
          "weight_kg,cost,status,distance_miles,transit_days\n")


def rows(spark, n=10, tag="x"):
    return spark.range(n).selectExpr(f"concat('{tag}', id) as shipment_id", "cast(id as int) as transit_days")


def test_key_follows_appends_into_partitions(spark, tmp_path):
    table = f"{tmp_path}/in"
    rows(spark).selectExpr("*", "transit_days % 2 as p").write.partitionBy("p").parquet(table)
    key = store.fingerprint(spark, [table], "t")
    assert store.fingerprint(spark, [table], "t") == key
    rows(spark, 3).coalesce(1).write.mode("append").parquet(f"{table}/p=1")
    assert store.fingerprint(spark, [table], "t") != key
    assert store.fingerprint(spark, [f"{tmp_path}/absent"], "t") != key


def test_first_of_two_writers_wins(spark, tmp_path):
    path = f"{tmp_path}/t"
    one, two = (store.write_run(spark, rows(spark, 5, tag), path, sort_keys=()) for tag in "ab")
    assert store.publish(spark, path, two) and not store.publish(spark, path, one)
    assert {r.shipment_id[0] for r in store.open_table(spark, path).collect()} == {"b"}
    assert store.open_table(spark, path).dtypes == rows(spark).dtypes


def test_a_writer_that_dies_half_way_leaves_nothing_to_read(spark):
    built = []

    def build():
        built.append(1)
        return rows(spark, 4) if len(built) > 1 else rows(spark, 4).selectExpr(
            "shipment_id", "if(transit_days = 3, raise_error('killed'), transit_days) as transit_days")

    with pytest.raises(Exception, match="killed"):
        store.materialize(spark, build, "dies", "k1", sort_keys=())
    # and one that wrote its files, but never came to publish
    path = f"{store.checkpoint_root(spark)}/lanescope/dies-k1"
    store.write_run(spark, rows(spark, 99, "lost"), path, sort_keys=())
    assert not store.path_exists(spark, f"{path}/{store.POINTER}")
    assert store.materialize(spark, build, "dies", "k1", sort_keys=()).count() == 4
    assert len(built) == 2 and store.materialize(spark, build, "dies", "k1").count() == 4 and len(built) == 2


def test_only_the_files_of_the_manifest_are_read_and_their_lengths_checked(spark, tmp_path):
    path = f"{tmp_path}/t"
    run = store.write_run(spark, rows(spark, 100).repartition(3), path, sort_keys=())
    store.publish(spark, path, run)
    rows(spark, 7).coalesce(1).write.mode("append").parquet(f"{path}/{run}")
    assert store.open_table(spark, path).count() == 100
    part = f"{path}/{run}/{sorted(json.load(open(f'{path}/{run}/{store.MANIFEST}'))['files'])[0]}"
    with open(part, "ab") as f:
        f.write(b"x")
    with pytest.raises(RuntimeError, match="another length"):
        store.open_table(spark, path)


def test_csv_is_loaded_once_per_state_of_its_files(spark, tmp_path):
    line = "{},W,D,UPS,2024-01-01,2024-01-03,1,2,Delivered,3,2\n"
    with open(f"{tmp_path}/a.csv", "w") as f:
        f.write(HEADER + line.format("a"))
    log = log_data_from_csv(spark, f"{tmp_path}/*.csv")
    assert log.count() == 1 and "csv-" in log.inputFiles()[0] and not any(x.endswith(".csv") for x in log.inputFiles())
    assert log_data_from_csv(spark, f"{tmp_path}/*.csv").inputFiles() == log.inputFiles()
    with open(f"{tmp_path}/b.csv", "w") as f:
        f.write(HEADER + line.format("b"))
    assert log_data_from_csv(spark, f"{tmp_path}/*.csv").count() == 2


def test_one_stored_copy_of_the_rows(spark, monkeypatch):
    from lanescope.plans.registry import log_data_for
    monkeypatch.setattr(store, "NAMESPACE", store.run_id())
    before = set(glob.glob(f"{store.checkpoint_root(spark)}/lanescope/*"))
    log_data_for(spark, "/root/testdata/sf0.001").count()
    made = set(glob.glob(f"{store.checkpoint_root(spark)}/lanescope/*")) - before
    assert sorted(re.sub("-[0-9a-f]{16}$", "", os.path.basename(p)) for p in made) == ["cost_mean", "parsed"]


SKIPPING = """
import sys
from lanescope.session import local_session
from lanescope.sources import store
spark = local_session(4, 8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + sys.argv[1], "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1g"})
df = spark.range(80000).selectExpr("concat('id', id * 7919 % 1000003) as shipment_id", "concat('W', id % 16) as origin_warehouse", "concat('C', id % 5) as carrier",
    "date_add(date'2024-01-01', cast(id % 300 as int)) as shipment_date", "cast(id as decimal(14,2)) as cost")
store.write_clean_table(df, sys.argv[2])
table = spark.read.parquet(sys.argv[2])
for name, rows in (("all", table), ("warehouse", table.where("origin_warehouse = 'W3'")), ("id", table.where("shipment_id = 'id7919'")), ("none", table.where("shipment_id = 'id5x'"))):
    spark.sparkContext.setJobDescription(name)
    print(name, rows.select("shipment_id", "cost").toArrow().num_rows)
spark.stop()
"""


def test_filters_read_fewer_files_and_row_groups(tmp_path):
    """Event log: rows that the scans gave to the filters."""
    (tmp_path / "log").mkdir()
    subprocess.run([sys.executable, "-c", SKIPPING, f"{tmp_path}/log", f"{tmp_path}/t"], check=True, timeout=300,
                   cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True)
    said, of, records = {}, {}, {}
    for line in next((tmp_path / "log").iterdir()).open():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart" and "spark.job.description" in e["Properties"]:
            of.update({s["Stage ID"]: e["Properties"]["spark.job.description"] for s in e["Stage Infos"]})
        elif e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in of:
            name = of[e["Stage ID"]]
            records[name] = records.get(name, 0) + e["Task Metrics"]["Input Metrics"]["Records Read"]
    assert len(glob.glob(f"{tmp_path}/t/part-*")) == 8
    assert records["all"] == 80000, records
    assert records["warehouse"] <= 20000, records      # one or two of eight files
    assert records["id"] <= 20000 and records["none"] == 0, records
