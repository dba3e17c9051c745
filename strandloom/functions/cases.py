"""Named CASE expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flight_status(c: Column) -> Column:
    """Space Flight, Ground or Unknown; the order of the tests matters."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(t.isin("", "nan", "none", "na", "n/a", "unknown"), "Unknown")
        .when(t.contains("flight") & ~t.contains("control"), "Space Flight")
        .when(t.rlike("control|basal|vivarium|ground|cohort"), "Ground")
        .otherwise("Unknown")
    )


def species_label(c: Column) -> Column:
    return F.when(c == 0, "Homo sapiens").otherwise("Mus musculus")


def species_code(c: Column) -> Column:
    """0 for human*, 1 for mouse*, else null."""
    t = F.lower(F.trim(c))
    return F.when(t.startswith("human"), 0).when(t.startswith("mouse"), 1)


def blank_sentinels(c: Column) -> Column:
    return F.when(c.isNull() | c.isin("nan", "None", "<NA>"), "").otherwise(c)


def number_or_zero(c: Column) -> Column:
    """The number a text is, 0 where it is none."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double")).otherwise(0.0)


def sample_tier(has_vector: Column, condition: Column, path: Column, has_column: Column) -> Column:
    """cached, subprocess or unavailable."""
    def missing(c: Column) -> Column:
        return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none", "na", "n/a")

    return F.when(has_vector, "cached").when(missing(condition) | missing(path), "unavailable").when(has_column, "subprocess").otherwise("unavailable")
