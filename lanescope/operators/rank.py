"""Top-k reports and chart feeds.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps its own k best
rows and only those reach the final merge, so the cost is one pass and k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import LANE_ARROW


def top_k(df: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(k)


def lane_label(origin: str = "origin_warehouse", destination: str = "destination") -> Column:
    return F.concat_ws(LANE_ARROW, F.col(origin).cast("string"), F.col(destination).cast("string"))
