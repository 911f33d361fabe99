"""Fixed schemas of the staging (all text) and clean shipment tables."""

from pyspark.sql import types as T

from ..fixed_values import DELAYED, DELIVERED, LOST, RETURNED, UNKNOWN  # noqa: F401  (re-exported)

# Staging columns, in file order. Every field is read as text; nothing is inferred.
STAGING_COLUMNS = (
    "shipment_id", "origin_warehouse", "destination", "carrier",
    "shipment_date", "delivery_date",
    "weight_kg", "cost", "status", "distance_miles", "transit_days",
)

STAGING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in STAGING_COLUMNS])

# Clean types. Decimal scales are part of the semantics: the casts round to them.
WEIGHT_TYPE = T.DecimalType(12, 3)
COST_TYPE = T.DecimalType(14, 2)
DISTANCE_TYPE = T.DecimalType(14, 3)

CLEAN_SCHEMA = T.StructType([
    T.StructField("shipment_id", T.StringType(), False),
    T.StructField("origin_warehouse", T.StringType(), False),
    T.StructField("destination", T.StringType(), False),
    T.StructField("carrier", T.StringType(), False),
    T.StructField("shipment_date", T.DateType(), False),
    T.StructField("delivery_date", T.DateType(), True),
    T.StructField("weight_kg", WEIGHT_TYPE, True),
    T.StructField("cost", COST_TYPE, True),
    T.StructField("status", T.StringType(), False),
    T.StructField("distance_miles", DISTANCE_TYPE, True),
    T.StructField("transit_days", T.IntegerType(), True),
])

CLEAN_COLUMNS = tuple(f.name for f in CLEAN_SCHEMA.fields)

