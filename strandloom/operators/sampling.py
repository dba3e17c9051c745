"""Deterministic samples: the order is a digest of seed and id, the same in every engine."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.positions import group_positions


def ticket(seed: int, ident: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")))


def uniform(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by ticket order: a limit that sorts only n rows a task."""
    return df.withColumn("_t", ticket(seed, ident)).orderBy("_t", ident).limit(n).drop("_t")


def stratified(df: DataFrame, ident: str, label: str, n: int, seed: int) -> DataFrame:
    """A pool of at most ``n`` whole; else per class max(1, half-even rounding of its share), at most the class.

    The result may be slightly above or below ``n``, by the rounding.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    pool = df.agg(F.count(F.lit(1))).scalar()
    take = F.when(pool <= n, F.col("_size")).otherwise(F.least(F.greatest(F.lit(1), F.bround(F.col("_size") * n / pool).cast("long")), F.col("_size")))
    quota = sizes.select(F.col(label).alias("_label"), take.alias("_take"))
    # Positions within the class by ticket, from sorted ranges, so that no class is sorted in one task; then the class's own quota.
    ranked = group_positions(df.withColumn("_t", ticket(seed, ident)), [label], [F.col("_t"), F.col(ident)], "_r")
    return ranked.join(quota, F.col(label).eqNullSafe(F.col("_label"))).filter(F.col("_r") <= F.col("_take")).drop("_t", "_r", "_label", "_take")
