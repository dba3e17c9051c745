"""The retrieval path: stored vector, precomputed vector or model, always with the same columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.knn import knn


def search(queries: DataFrame, index: DataFrame, k: int, dim: int, precomputed: DataFrame | None = None, encoded: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank, mode for all queries at once.

    Each query uses its own vector (cached), else the precomputed one, else the
    encoded one; queries without any give no rows.  ``k`` is clamped to 1..n by
    the search itself.  All inputs have vec_id and embedding.
    """
    sources = [(queries, "cached"), (precomputed, "precomputed"), (encoded, "model")]
    best = None
    for df, mode in sources:
        if df is None:
            continue
        part = df.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding", F.lit(mode).alias("mode"))
        best = part if best is None else best.unionByName(part.join(best.select("vec_id"), "vec_id", "left_anti"))
    hits = knn(best, "vec_id", "embedding", index, "vec_id", "embedding", dim, max(1, k))
    return hits.join(best.select(F.col("vec_id").alias("qid"), "mode").distinct(), "qid")


def one(samples: DataFrame, sample_id: int, index: DataFrame, k: int, dim: int) -> DataFrame:
    """Search for a single sample; an unknown one raises."""
    row = samples.filter(F.col("vec_id") == sample_id)
    if row.isEmpty():
        raise ValueError(f"unknown sample {sample_id}")
    return search(row, index, k, dim)
