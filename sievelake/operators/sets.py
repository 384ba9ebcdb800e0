"""Set operations on rows that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that ``left`` has more often than ``right``, and how many more: counts are combined map-side, so a hot row is one."""
    cols = left.columns
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    return signed.groupBy(*cols).agg(F.sum("_n").alias("surplus")).where("surplus > 0")
