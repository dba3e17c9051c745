"""All queries of the library outside its optional part, by name."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import analytic, core_problems, embedding, parity, relational

PARTS = [core_problems, relational, analytic, embedding, parity]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return embedding.topk_annotated(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
