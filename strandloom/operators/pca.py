"""Exact principal components from one pass of second moments."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.knn import matrix
from strandloom.session import spread


def moments(df: DataFrame, vec: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and second moment in double precision; each task sends one d x d block, summed two at a time on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            keep, m = matrix(b.column(0), dim)
            n, s, g = n + len(keep), s + m.sum(0), g + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([s, g.ravel()]).tobytes()], pa.binary())], names=["n", "m"])

    parts = spread(df.select(vec).filter(F.col(vec).isNotNull())).mapInArrow(run, "n long, m binary")
    width = dim * (dim + 1)

    def merge(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], (np.frombuffer(a[1]) + np.frombuffer(b[1])).tobytes()

    zero = (0, np.zeros(width).tobytes())
    n, m = parts.rdd.map(tuple).treeAggregate(zero, merge, merge, depth=2)
    flat = np.frombuffer(m)
    return int(n), flat[:dim].copy(), flat[dim:].reshape(dim, dim).copy()


def fit(n: int, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, components (rows, by falling variance, largest entry positive) and the whole spectrum of explained shares."""
    mean = s / n
    cov = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    val, v = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(val)[::-1]
    val, comp = np.clip(val[order], 0, None), v[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return mean, comp, val / val.sum() if val.sum() > 0 else val


def transform(df: DataFrame, keep: list[str], vec: str, mean: np.ndarray, comp: np.ndarray) -> DataFrame:
    """``keep`` columns and x, y, ...: coordinates on the given components, JVM-side."""
    v = F.col(vec).cast("array<double>")
    names = "xyzw"
    out = []
    for j, c in enumerate(comp):
        shift = float(mean @ c)
        w = F.array(*[F.lit(float(x)) for x in c])
        out.append((F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - shift).alias(names[j]))
    return df.select(*keep, *out)
