"""Joins and groups whose keys may hold a large share of all rows."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 256


def hot_hashes(df: DataFrame, key: list[str], least: int = 100_000, share: float = HOT_SHARE) -> tuple[list[int], int]:
    """Hashes of the keys with more than ``share`` of all rows (at least ``least``), and the row count.

    Counted over all rows with partial sums; fewer than 1 / share hashes come back, whatever the data.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= max(least, (total or 0) * share):
        return [], total or 0
    hot = counts.filter(F.col("n") > max(least, total * share)).select(F.xxhash64(*key).alias("h")).collect()
    return [r["h"] for r in hot], total


def skew_join(many: DataFrame, one: DataFrame, key: list[str], by: str, how: str = "inner", least: int = 100_000, rows_per_task: int = 500_000) -> DataFrame:
    """Join ``many`` to ``one`` (few rows a key) on ``key`` with the hot keys of ``many`` spread by a hash of ``by``."""
    hot, total = hot_hashes(many, key, least)
    if not hot:
        return many.join(one, key, how)
    salts = max(2, min(1024, math.ceil(total / rows_per_task)))
    is_hot = F.xxhash64(*key).isin(hot)
    left = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*key, "_salt"], how).drop("_salt")
