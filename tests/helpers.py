"""Small builders for hand-made shipment rows (clean schema)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from lanescope.sources.schema import CLEAN_SCHEMA, STAGING_SCHEMA


def D(x):
    return None if x is None else Decimal(str(x))


def ship(spark, rows):
    """rows: dicts with any clean columns; defaults fill the rest."""
    base = dict(shipment_id="S", origin_warehouse="W1", destination="X", carrier="C1",
                shipment_date=dt.date(2024, 1, 1), delivery_date=dt.date(2024, 1, 3),
                weight_kg=D("10.000"), cost=D("100.00"), status="Delivered",
                distance_miles=D("100.000"), transit_days=2)
    out = []
    for i, r in enumerate(rows):
        row = {**base, "shipment_id": f"S{i}", **r}
        for k in ("weight_kg", "cost", "distance_miles"):
            row[k] = D(row[k]) if row[k] is not None and not isinstance(row[k], Decimal) else row[k]
        out.append(tuple(row[f.name] for f in CLEAN_SCHEMA.fields))
    return spark.createDataFrame(out, CLEAN_SCHEMA)


def staging(spark, rows):
    """rows: dicts of staging text fields (missing ones are blank)."""
    return spark.createDataFrame([tuple(r.get(f.name, "") for f in STAGING_SCHEMA.fields) for r in rows],
                                 STAGING_SCHEMA)
