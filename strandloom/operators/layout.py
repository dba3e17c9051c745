"""Neighbour graphs and their layouts.

Edge weights and affinities are made over tables; the layouts themselves run on
the driver in numpy and take at most CAP points, as their cost is not linear.  A
larger table is laid out by landmarks: a stated sample of CAP points gets its
layout, and every other point is placed among its nearest landmarks, in one pass
over the table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP = 20_000


def fuzzy_weights(edges: DataFrame) -> DataFrame:
    """qid, id, weight: smooth memberships of each point's neighbours, joined by a + b - ab."""

    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.maximum(1.0 - pdf["score"].to_numpy(), 0)
        rho, target = d.min(), np.log2(max(len(d), 2))
        lo, hi, sigma = 0.0, np.inf, 1.0
        for _ in range(64):
            s = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(s - target) < 1e-5:
                break
            lo, hi = (lo, sigma) if s > target else (sigma, hi)
            sigma = (lo + hi) / 2 if np.isfinite(hi) else sigma * 2
        return pdf[["qid", "id"]].assign(weight=np.exp(-np.maximum(d - rho, 0) / max(sigma, 1e-12)))

    one = edges.select("qid", "id", "score").groupBy("qid").applyInPandas(calibrate, "qid long, id long, weight double")
    both = one.unionByName(one.select(F.col("id").alias("qid"), F.col("qid").alias("id"), "weight"))
    return both.groupBy("qid", "id").agg((F.sum("weight") - F.when(F.count("weight") > 1, F.product("weight")).otherwise(0.0)).alias("weight"))


def affinities(edges: DataFrame, perplexity: float) -> DataFrame:
    """qid, id, p: Gaussian affinities at the perplexity, symmetrised; they sum to 1 over all."""

    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.maximum(2 - 2 * pdf["score"].to_numpy(), 0)
        lo, hi, beta, want = 0.0, np.inf, 1.0, np.log(min(perplexity, len(d)))
        for _ in range(100):
            p = np.exp(-(d - d.min()) * beta)
            p /= p.sum()
            h = -(p * np.log(np.maximum(p, 1e-300))).sum()
            if abs(h - want) < 1e-6:
                break
            lo, hi = (beta, hi) if h > want else (lo, beta)
            beta = (lo + hi) / 2 if np.isfinite(hi) else beta * 2
        return pdf[["qid", "id"]].assign(p=p)

    one = edges.select("qid", "id", "score").groupBy("qid").applyInPandas(calibrate, "qid long, id long, p double")
    both = one.unionByName(one.select(F.col("id").alias("qid"), F.col("qid").alias("id"), "p"))
    n = edges.agg(F.countDistinct("qid")).scalar()
    return both.groupBy("qid", "id").agg(F.sum("p").alias("p")).select("qid", "id", (F.col("p") / (2 * n)).alias("p"))


def edge_arrays(edges: DataFrame, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = edges.select("qid").distinct().count()
    if n > CAP:
        raise ValueError(f"{n} points; a layout takes at most {CAP}: lay out a stated sample and place the rest by their neighbours")
    t = edges.select("qid", "id", weight).toPandas().sort_values(["qid", "id"])
    ids = np.unique(np.concatenate([t["qid"], t["id"]]))
    return ids, np.searchsorted(ids, t["qid"]), np.searchsorted(ids, t["id"]), t[weight].to_numpy()


def landmarks(df: DataFrame, ident: str, count: int, seed: int = 42) -> DataFrame:
    """At most ``count`` rows, drawn by a digest of seed and id; a smaller table is taken whole."""
    from strandloom.operators.sampling import uniform

    return uniform(df, ident, count, seed)


def place(df: DataFrame, ident: str, vec: str, dim: int, ids: np.ndarray, vectors: np.ndarray, y: np.ndarray, k: int = 15) -> DataFrame:
    """ident and x, y[, z] of every row: a landmark's own place, else the mean of its ``k`` nearest landmarks by weight.

    Weights fall off exponentially with cosine distance, beyond the nearest one.
    The landmarks (CAP at most) travel to the tasks; the rows stay where they
    are.  Rows without a usable vector are left out.
    """
    import pyarrow as pa

    from strandloom.operators.knn import _unit, matrix
    from strandloom.session import spread

    u, at = _unit(np.asarray(vectors, float)), {int(i): n for n, i in enumerate(ids)}
    names = "xyz"[: y.shape[1]]
    k = min(k, len(ids))

    def run(batches):
        for b in batches:
            keep, m = matrix(b.column(1), dim)
            if not len(keep):
                continue
            own = b.column(0).take(pa.array(keep)).to_numpy()
            s = _unit(m) @ u.T
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            d = 1 - np.take_along_axis(s, near, 1)
            w = np.exp(-(d - d.min(1, keepdims=True)) / np.maximum(d.mean(1, keepdims=True) - d.min(1, keepdims=True), 1e-9))
            out = (w[:, :, None] * y[near]).sum(1) / w.sum(1, keepdims=True)
            for r, i in enumerate(own.tolist()):
                if i in at:
                    out[r] = y[at[i]]
            yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(out[:, c]) for c in range(out.shape[1])]], names=[ident, *names])

    rows = spread(df.select(F.col(ident).cast("long").alias(ident), F.col(vec).alias("v")).filter(f"`{ident}` is not null and v is not null"))
    return rows.mapInArrow(run, f"`{ident}` long, " + ", ".join(f"{c} double" for c in names))


def spectral(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, dims: int) -> np.ndarray:
    """Leading eigenvectors of the normalised graph without the trivial one, scaled to 10; orthogonal iteration over the edges, so nothing n x n is made."""
    deg = np.maximum(np.bincount(i, w, n), 1e-12)
    s = w / np.sqrt(deg[i] * deg[j])
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(n, dims + 1)))[0]
    q[:, 0] = np.sqrt(deg / deg.sum())
    for _ in range(300):
        z = np.stack([np.bincount(i, s * q[j, c], n) for c in range(dims + 1)], 1) + q
        z[:, 0] = np.sqrt(deg / deg.sum())
        q = np.linalg.qr(z)[0]
    out = q[:, 1:]
    return out * (10 / np.abs(out).max()) * np.sign(out[np.abs(out).argmax(0), range(dims)])


def init_from_pca(xy: np.ndarray, seed: int = 42) -> np.ndarray:
    """Start of a layout: components scaled so that the largest entry is 10, with a small jitter that parts equal points."""
    top = np.abs(xy).max()
    if not np.isfinite(top) or top == 0:
        raise ValueError("components without spread are no start")
    return xy * (10 / top) + np.random.default_rng(seed).normal(0, 1e-4, xy.shape)


def umap(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, dims: int = 2, epochs: int = 200, negatives: int = 5, seed: int = 42) -> np.ndarray:
    """Attraction along edges and repulsion of random points (curve for a minimal distance of 0.1)."""
    a, b = 1.577, 0.895
    rng = np.random.default_rng(seed)
    y = spectral(n, i, j, w, dims) + rng.normal(0, 1e-4, (n, dims))
    keep = w >= w.max() / epochs
    i, j, w = i[keep], j[keep], w[keep] / w.max()
    for e in range(epochs):
        alpha = 1 - e / epochs
        on = rng.random(len(w)) < w
        h, t = i[on], j[on]
        d = y[h] - y[t]
        d2 = (d**2).sum(1, keepdims=True)
        g = np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b + 1e-12) * d, -4, 4) if len(d) else d
        g = np.nan_to_num(g)
        step = np.zeros_like(y)
        np.add.at(step, h, g)
        np.add.at(step, t, -g)
        for _ in range(negatives):
            o = rng.integers(0, n, len(h))
            d = y[h] - y[o]
            d2 = (d**2).sum(1, keepdims=True)
            np.add.at(step, h, np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * d, -4, 4) * (o != h)[:, None])
        y += alpha * np.clip(step, -4, 4)
    return y


def tsne(n: int, i: np.ndarray, j: np.ndarray, p: np.ndarray, init: np.ndarray, early: int = 250, late: int = 500) -> np.ndarray:
    """Exaggerated, then plain gradient descent with momentum; repulsion exact, in blocks."""
    y = init / init[:, 0].std() * 1e-4
    move, rate = np.zeros_like(y), max(200.0, n / 12)
    for e in range(early + late):
        pe = p * (12 if e < early else 1)
        d = y[i] - y[j]
        att = np.zeros_like(y)
        np.add.at(att, i, (pe / (1 + (d**2).sum(1)))[:, None] * d)
        rep, z = np.zeros_like(y), 0.0
        for s in range(0, n, 1024):
            diff = y[s: s + 1024, None] - y[None]
            q = 1 / (1 + (diff**2).sum(2))
            z += q.sum() - len(q)
            rep[s: s + 1024] = ((q**2)[:, :, None] * diff).sum(1)
        grad = 4 * (att - rep / max(z, 1e-12))
        move = (0.5 if e < early else 0.8) * move - rate * grad
        y = y + move
        y -= y.mean(0)
    return y
