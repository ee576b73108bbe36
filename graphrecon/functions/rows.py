"""One-row results used beside other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(rows: DataFrame, *singles: DataFrame) -> DataFrame:
    """Add the columns of one-row tables. They are scalar subqueries: nothing is joined."""
    for single in singles:
        values = single.select(F.struct(*single.columns)).scalar()
        rows = rows.select("*", *[values.getField(c).alias(c) for c in single.columns])
    return rows
