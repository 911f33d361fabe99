"""The driver-table adapter reaches every cleaning branch (so the oracle comparison covers them)."""

from pyspark.sql import functions as F

from conftest import SF_MID
from lanescope.operators import clean as C
from lanescope.plans.registry import log_data_for, parsed_for, staging_for


def test_every_dirty_form_occurs(spark):
    st = staging_for(spark, SF_MID)
    c = F.col
    checks = {
        "padded warehouse": c("origin_warehouse").startswith(" "),
        "blank warehouse": F.trim(c("origin_warehouse")) == "",
        "blank id": F.trim(c("shipment_id")) == "",
        "blank ship date": F.trim(c("shipment_date")) == "",
        "blank delivery date": F.trim(c("delivery_date")) == "",
        "blank weight": F.trim(c("weight_kg")) == "",
        "weight with 4 decimals": c("weight_kg").endswith(".2505"),
        "blank cost": F.trim(c("cost")) == "",
        "cost with separator": c("cost").contains(","),
        "cost with 3 decimals": c("cost").rlike(r"\.\d{3}$"),
        "distance with separator": c("distance_miles").contains(","),
        "blank status": F.trim(c("status")) == "",
        "lower-case status": F.trim(c("status")) == "delivered",
    }
    counts = st.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()]).first().asDict()
    assert all(v > 0 for v in counts.values()), counts


def test_clean_table_properties(spark):
    log = log_data_for(spark, SF_MID)
    parsed = parsed_for(spark, SF_MID)
    assert C.rejected(parsed).count() > 0                       # quarantined rows exist
    assert log.where(F.col("cost").isNull()).count() == 0       # every cost filled
    assert C.duplicate_ids(log).count() > 1                     # blank and short ids collide
    assert log.agg(F.count_distinct("status")).first()[0] == 6  # 4 statuses, UNKNOWN, 'delivered'
    assert log.where(F.col("transit_days").isNull()).count() == 0
