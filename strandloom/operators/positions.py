"""Exact global row numbers without gathering rows: sorted ranges and prefix sums of their counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut

SHIFT = 33  # bits of the row within its partition in monotonically_increasing_id


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` plus ``name``: 1 for the first row in ``order``, and so on.

    ``order`` should be total, else equal rows are numbered in any order.  Only
    the ranges' counts (a row a partition) are summed in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    base = cut(ranged.withColumn("_m", F.monotonically_increasing_id()), "positions").withColumn("_p", F.shiftright("_m", SHIFT))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = base.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_b"))
    out = base.join(F.broadcast(before), "_p")  # a row a partition
    return out.withColumn(name, F.col("_b") + (F.col("_m") - F.shiftleft("_p", SHIFT)) + 1).drop("_m", "_p", "_b")


def group_positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` plus ``name``: 1 for the first row of its group in ``order``, and so on.

    Groups are cut by sorted ranges, so a group of any size is spread over tasks;
    what is summed up is a row for each group of a range.  Null groups count as
    one.
    """
    keys = [F.col(f"`{g}`") for g in group]
    base = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()), "positions").withColumn("_p", F.shiftright("_m", SHIFT))
    w = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = base.groupBy("_p", *[k.alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = per.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumnRenamed("_p", "_q").drop("_n")
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"_g{i}"))
    out = base.join(starts, on)
    return out.withColumn(name, F.col("_b") + F.col("_m") - F.col("_first") + 1).drop("_m", "_p", "_q", "_b", "_first", *[f"_g{i}" for i in range(len(group))])
