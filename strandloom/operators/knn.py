"""Exact nearest neighbours: a stated query set against all rows, in blocks.

Query vectors travel in blocks of bounded size; the index stays where it is.
Each task keeps its own best k per query, and a final cut merges them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut, spread

#: query values (rows times dimensions) in one block
BLOCK = 4_000_000


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, int), np.empty((0, dim))
    ok = np.flatnonzero(col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    m = col.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), dim)
    good = np.isfinite(m).all(1)
    return ok[good], m[good]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 0, m / np.where(n > 0, n, 1), m)


def _searcher(qids: np.ndarray, q: np.ndarray, dim: int, k: int | None, metric: str, exclude_self: bool):
    qq = _unit(q) if metric == "cosine" else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_i = np.full((len(qids), 0), 0.0), np.empty((len(qids), 0), np.int64)
        for b in batches:
            keep, m = matrix(b.column(1), dim)
            if not len(keep):
                continue
            ids = b.column(0).take(pa.array(keep)).to_numpy()
            x = _unit(m) if metric == "cosine" else m
            if metric == "euclidean":
                s = -np.maximum((qq**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * qq @ x.T, 0)
            else:
                s = qq @ x.T
            if exclude_self:
                s = np.where(qids[:, None] == ids[None, :], -np.inf, s)
            if k is None:
                real = np.isfinite(s).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, len(ids))[real]), pa.array(np.tile(ids, len(qids))[real]), pa.array(s.ravel()[real])], names=["qid", "id", "score"])
                continue
            best_s = np.concatenate([best_s, s], 1)
            best_i = np.concatenate([best_i, np.broadcast_to(ids, s.shape)], 1)
            if best_s.shape[1] > k:
                # highest score, then smallest id; scores are compared to twelve digits
                order = np.lexsort((best_i, -np.round(best_s, 12)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        if best_s.shape[1]:
            n = best_s.shape[1]
            flat = best_s.ravel()
            real = np.isfinite(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)[real]), pa.array(best_i.ravel()[real]), pa.array(flat[real])], names=["qid", "id", "score"])

    return run


def scores(queries: DataFrame, qid: str, qvec: str, index: DataFrame, iid: str, ivec: str, dim: int, k: int | None, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """qid, id, score: of every task its best ``k`` of each query, or with None the scores of all rows, which pass through batch by batch."""
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    spark = index.sparkSession
    rows = spread(index.select(F.col(iid).cast("long").alias("id"), F.col(ivec).alias("v")).filter("id is not null and v is not null"))
    asked = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("v")).filter("qid is not null and v is not null").distinct()
    blocks = max(1, -(-asked.count() * dim // BLOCK))
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()  # BLOCK values on average
        keep, q = matrix(part.column("v"), dim)
        if not len(keep):
            continue
        ids = part.column("qid").take(pa.array(keep)).to_numpy()
        found = rows.mapInArrow(_searcher(ids, q, dim, k, metric, exclude_self), "qid long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "qid long, id long, score double") if out is None else out


def knn(queries: DataFrame, qid: str, qvec: str, index: DataFrame, iid: str, ivec: str, dim: int, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """qid, id, score, rank: exact ``k`` nearest by cosine, dot or euclidean (score = -distance squared).

    Ties go to the smaller id.  Vectors that are null, of another length or not
    finite take no part.  ``k`` beyond the index gives all of it; empty tables
    give no rows.
    """
    out = scores(queries, qid, qvec, index, iid, ivec, dim, k, metric, exclude_self)
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearer(pairs: DataFrame, index: DataFrame, iid: str, ivec: str, dim: int) -> DataFrame:
    """qid, id, n: for each of ``pairs`` (qid, id, q, v) how many index vectors are strictly nearer to q than v is, by squared distance.

    Pairs travel in blocks like queries do; each task counts its own rows, and the
    counts are summed.  Unusable vectors (see :func:`knn`) take no part.
    """
    rows = spread(index.select(F.col(iid).cast("long").alias("id"), F.col(ivec).alias("v")).filter("id is not null and v is not null"))
    held = cut(pairs.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id"), "q", "v"), "pairs")
    blocks = max(1, -(-held.count() * 2 * dim // BLOCK))
    out = None
    for b in range(blocks):
        part = held.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        kq, q = matrix(part.column("q"), dim)
        kv, v = matrix(part.column("v"), dim)
        both, iq, iv = np.intersect1d(kq, kv, return_indices=True)
        if not len(both):
            continue
        qids, ids = (part.column(c).take(pa.array(both)).to_numpy() for c in ("qid", "id"))
        order = np.argsort(qids, kind="stable")
        found = rows.mapInArrow(_counter(qids[order], ids[order], q[iq][order], v[iv][order]), "qid long, id long, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.sparkSession.createDataFrame([], "qid long, id long, n long")
    return out.groupBy("qid", "id").agg(F.sum("n").alias("n"))


def _squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances, summed in one fixed order so that equal points have equal ones."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - q[j]) ** 2
    return total


def _counter(qids: np.ndarray, ids: np.ndarray, q: np.ndarray, v: np.ndarray):
    start = np.flatnonzero(np.r_[True, qids[1:] != qids[:-1]])
    end = np.r_[start[1:], len(qids)]
    limits = [_squared(v[a:b], q[a]) for a, b in zip(start, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(qids), np.int64)
        for batch in batches:
            _, x = matrix(batch.column(1), q.shape[1])
            for a, b, limit in zip(start, end, limits):
                n[a:b] += np.searchsorted(np.sort(_squared(x, q[a])), limit, side="left")
        yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids), pa.array(n)], names=["qid", "id", "n"])

    return run
