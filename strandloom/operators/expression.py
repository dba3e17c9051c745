"""Counts to normalised expression: ortholog map, sum of duplicates, alignment, TPM, log1p."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: genes that one list may hold
MOST_GENES = 200_000


def unpivot(wide: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    """One row per id and sample column; null counts are left out."""
    return wide.unpivot(ids, [F.col(s).cast("double").alias(s) for s in samples], "sample", "count").filter(F.col("count").isNotNull())


def map_symbols(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts by gene to counts by symbol; unmapped genes are dropped, of a gene's several symbols the last one counts.

    mapping: gene, symbol, line.  It is joined without a hint: its size decides.
    """
    last = mapping.filter("gene is not null and symbol is not null").groupBy("gene").agg(F.max_by("symbol", "line").alias("symbol"))
    return counts.join(last, "gene")


def collapse(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample", "symbol").agg(F.sum("count").alias("count"))


def align(collapsed: DataFrame, genes: DataFrame) -> DataFrame:
    """Every listed gene for every sample, 0 where it was not counted; genes off the list are dropped.

    The list repeats inside each sample by ``explode`` of one array.  It is a
    fixed vocabulary, so MOST_GENES bounds it, whatever the number of samples; a
    longer one raises.
    """
    n = genes.select("symbol").distinct().count()
    if n > MOST_GENES:
        raise ValueError(f"{n} genes; a list holds at most {MOST_GENES}")
    listed = genes.select("symbol").distinct().agg(F.sort_array(F.collect_list("symbol"))).scalar()
    grid = collapsed.select("sample").distinct().select("sample", F.explode(listed).alias("symbol"))
    return grid.join(collapsed, ["sample", "symbol"], "left").select("sample", "symbol", F.coalesce("count", F.lit(0.0)).alias("count"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds tpm; a gene without a positive length has 0 and no share of the sum, a sample whose sum is not positive has all 0."""
    rate = F.when(F.col("length") > 0, F.col("count") / (F.col("length") / 1000.0)).otherwise(0.0)
    rated = counts.join(lengths, "symbol", "left").withColumn("rate", rate)
    # A sample has at most one row a symbol, so the window's groups are bounded by the list; a join to sums would compute all of the above twice.
    return rated.withColumn("total", F.sum("rate").over(Window.partitionBy("sample"))).withColumn("tpm", F.when(F.col("total") > 0, F.col("rate") / F.col("total") * 1e6).otherwise(0.0)).drop("rate", "total")


def log1p(c: str):
    return F.log1p(F.greatest(F.col(c), F.lit(0.0)))


def first_positive(rows: DataFrame, key: str, value: str, line: str) -> DataFrame:
    """Per key the first positive value by line."""
    return rows.filter(F.col(value) > 0).groupBy(key).agg(F.min_by(value, line).alias(value))


def prefix_sums(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running sums forward and backward within each key."""
    w = Window.partitionBy(key).orderBy(order)
    ahead, back = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("prefix", F.sum(value).over(ahead)).withColumn("suffix", F.sum(value).over(back))
