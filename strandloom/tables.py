"""Readers of the project tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_TOKENS = ("na", "n/a", "nan", "none")  # fixed values


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column whose name may hold dots and blanks."""
    return F.col(f"`{name}`")


WHITE = r"^[\s ]+|[\s ]+$"


def squeeze(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, WHITE, "")


def is_missing(c: Column) -> Column:
    """Null, blank, or a missing-token in any case."""
    t = F.lower(squeeze(c))
    return c.isNull() | (t == "") | t.isin(*MISSING_TOKENS)
