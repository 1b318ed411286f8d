"""Number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """The number, or null for NaN and infinities."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
