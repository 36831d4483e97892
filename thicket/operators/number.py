"""Numbering rows in order without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.scratch import stored


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: 1, 2, ... within each group in an order that leaves no ties.

    Rows are range-sorted by group and order and written once, so that a group
    with most of all rows is numbered in many tasks; only counts for each part
    and group, a row each, go through a window.
    """
    cut = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = stored(cut.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = at.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    out = at.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return out.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias(name))
