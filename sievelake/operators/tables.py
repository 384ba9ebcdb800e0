"""Comparison of tables cell by cell, and tables' risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(matrices: DataFrame) -> DataFrame:
    """(doc_id, table_no, row, column, value) of (doc_id, matrices); row 0 is the header, all numbers from 1 otherwise."""
    t = matrices.select("doc_id", F.posexplode("matrices").alias("t", "m"))
    rows = F.concat(F.array("m.headers"), "m.rows")
    r = t.select("doc_id", (F.col("t") + 1).alias("table_no"), F.posexplode(rows).alias("row", "r"))
    return r.select("doc_id", "table_no", "row", F.posexplode("r").alias("c", "value")).select("doc_id", "table_no", "row", (F.col("c") + 1).alias("column"), "value")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of ``left`` that ``right`` has not or has otherwise, tables paired by their place in the document."""
    key = ["doc_id", "table_no", "row", "column"]
    j = cells(left).withColumnRenamed("value", "expected").join(cells(right).withColumnRenamed("value", "actual"), key, "left")
    code = F.when(F.col("row") == 0, "header_value_mismatch").otherwise("cell_value_mismatch")
    return j.where(~F.col("expected").eqNullSafe(F.col("actual"))).select(*key, code.alias("code"))


def dimensions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, table_no, dimension_mismatch) of tables on either side."""
    size = lambda d, s: d.select("doc_id", F.posexplode("matrices").alias("t", "m")).select("doc_id", (F.col("t") + 1).alias("table_no"), F.size("m.headers").alias(f"c{s}"), F.size("m.rows").alias(f"r{s}"))
    j = size(left, 1).join(size(right, 2), ["doc_id", "table_no"], "full")
    return j.select("doc_id", "table_no", ~(F.col("c1").eqNullSafe(F.col("c2")) & F.col("r1").eqNullSafe(F.col("r2"))).alias("dimension_mismatch"))
