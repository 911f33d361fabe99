"""Reading vector columns inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, no null and only finite components."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & numbers & F.exists(vector, lambda x: x != 0), F.lit(False))
