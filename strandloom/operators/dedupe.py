"""Order-defined deduplication: the order is a column, never the row order of a scan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: list[str], order: list[Column], last: bool) -> DataFrame:
    """One row per key by a single aggregation: partial sums cut every key to one row before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)])
    best = (F.max if last else F.min)(ranked).alias("_b")
    out = df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(best)
    return out.select(*[F.col(f"`{k}`") for k in key], *[F.col(f"_b._c{i}").alias(c) for i, c in enumerate(rest)])


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (ties: the smallest row)."""
    return _pick(df, key, order, last=False)


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order``: an upsert."""
    return _pick(df, key, order, last=True)
