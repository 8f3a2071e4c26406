"""Running totals over groups of any size: totals of cells first, then within cells, so no group is one task. A rank is the running total of ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

CELLS = 4096


def running_total(df: DataFrame, group: list[str], cell: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in its group. ``cell`` must not fall along ``order``; there are few cells, of bounded size."""
    df = df.withColumns({"_cell": cell, "_v": value})
    totals = df.groupBy(*group, "_cell").agg(F.sum("_v").alias("_t"))
    before = W.Window.partitionBy(*group).orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_cell", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = W.Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(totals, [*group, "_cell"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_cell", "_v", "_in", "_base")
