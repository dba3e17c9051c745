"""Similarity clusters of vectors: MinHash banding over sets of near pivots.

A vector's set is its nearest pivots.  Bands of MinHashes over these sets bring
similar vectors into common buckets; the exact Jaccard similarity of the sets
and then the exact cosine verify them.  Inside a bucket verified links are
followed breadth first, each member being reached once, so a bucket yields fewer
links than it has members and never all of its pairs.  Links are joined to
connected components.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.vectors import fit_pivots, pack, pivot_count, pivot_order, sample_matrix, to_matrix, unit, unpack
from strandloom.operators.graph import connected_components
from strandloom.operators.skew import skew_join
from strandloom.session import cut

TOKENS = 6  # pivots in a vector's set
BANDS = 10  # bands of one MinHash each
JACCARD = 0.2  # sets that share two pivots of six; the cosine decides beyond it
FIRST = 64  # leading values that decide between several vectors of a key
CHUNK = 8_000  # members of one bucket that one task holds, twice


def minhashes(tokens: np.ndarray, pivots: int, bands: int) -> np.ndarray:
    """Per band the token that comes first in the band's order of all pivots."""
    out = np.empty((len(tokens), bands), np.int32)
    rng = np.random.default_rng(11)
    for b in range(bands):
        rank = rng.permutation(pivots)
        out[:, b] = tokens[np.arange(len(tokens)), rank[tokens].argmin(1)]
    return out


def links(u: np.ndarray, tokens: np.ndarray, least: float, jaccard: float, pivots: int, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows: sets with Jaccard >= ``jaccard`` and cosine >= ``least``.

    First a few leaders gather what is linked to them; then only rows of
    different components are compared, block by block.  A dense bucket thus
    costs a few passes, and no bucket ever yields more links than members.
    """
    n, m = tokens.shape
    sets = np.zeros((n, pivots), np.float32)
    np.put_along_axis(sets, tokens.astype(np.int64), 1.0, 1)
    shared = 2 * m * jaccard / (1 + jaccard) - 1e-6  # of two sets of m, at that similarity
    f = u.astype(np.float32)
    root, out = np.arange(n), []

    def linked(rows: np.ndarray, a: int, order: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = x[rows] @ x[a:].T
        ok = (s >= least) & (y[rows] @ y[a:].T >= shared)
        close = np.argwhere(np.abs(s - least) < 2e-5)  # single precision cannot tell these
        if len(close):
            p, q = order[rows[close[:, 0]]], order[a + close[:, 1]]
            ok[close[:, 0], close[:, 1]] = (np.einsum("ij,ij->i", u[p], u[q]) >= least) & ((sets[p] * sets[q]).sum(1) >= shared)
        return ok

    def top(nodes: np.ndarray) -> np.ndarray:
        r = root[nodes]
        while (r != root[r]).any():
            r = root[r]
        root[nodes] = r
        return r

    def join(row: int, hits: np.ndarray) -> None:
        tops = np.unique(np.append(top(hits), top(np.array([row]))))
        for t in tops[1:]:
            root[t] = tops[0]
            out.append((int(tops[0]), int(t)))

    every, free = np.arange(n), np.ones(n, bool)
    for _ in range(32):
        if not free.any():
            break
        lead = int(free.argmax())
        hits = np.flatnonzero(linked(np.array([lead]), 0, every, f, sets)[0])
        new = int(free[hits].sum())
        free[hits] = free[lead] = False
        join(lead, hits)
        if new < 4:
            break
    t = top(every)
    size = np.bincount(t, minlength=n)
    order = np.lexsort((t, -size[t]))
    x, y, t = f[order], sets[order], t[order]
    end = np.searchsorted(-size[t] * n + t, -size[t] * n + t, side="right")  # where each row's component ends
    a = 0
    while a < n:
        b = min(a + block, n) if size[t[a]] == 1 else min(a + block, int(end[a]))
        after = a if size[t[a]] == 1 else int(end[a])
        if after < n:
            ok = linked(np.arange(a, b), after, order, x, y)
            for r in np.flatnonzero(ok.any(1)):
                join(int(order[a + r]), order[after + np.flatnonzero(ok[r])])
        a = b
    return out


def ordered(m: np.ndarray) -> list[bytes]:
    """Bytes that compare as the rows' values do."""
    bits = (m.astype(np.float32) + np.float32(0)).view(np.uint32)
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return [r.tobytes() for r in bits.astype(">u4")]


def usable(df: DataFrame, key: str, vec: str, dim: int, piv: np.ndarray) -> DataFrame:
    """key, vec (packed), ord (its set): one row per key that has a usable vector; of several the smallest by its first FIRST values, then by its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, m = to_matrix(b.column(1), dim)
            if len(keep):
                order = pivot_order(unit(m), piv, TOKENS)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(ordered(m[:, :FIRST]), pa.binary()), pa.array(pack(m), pa.binary()), pa.array([o.tobytes() for o in order], pa.binary())], names=["key", "low", "vec", "ord"])

    src = df.select(F.col(key).cast("string").alias("key"), F.col(vec).alias("v")).filter("key is not null and v is not null")
    one = src.mapInArrow(run, "key string, low binary, vec binary, ord binary").groupBy("key").agg(F.min(F.struct("low", "vec", "ord")).alias("x"))
    return one.select("key", "x.vec", "x.ord")


def cluster(df: DataFrame, key: str, vec: str, dim: int, least: float = 0.90, smallest: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members: key, cluster_key; clusters: cluster_key, size, typical_key).

    Two keys are in one cluster if links of cosine >= ``least`` lead from one to
    the other; cluster_key is the smallest key, typical_key the member with the
    highest mean cosine to the others (equal to nine digits: the smaller key).
    Clusters below ``smallest`` members are left out.  Each key counts once;
    unusable vectors and null keys take no part; an empty table gives no rows.
    """
    spark = df.sparkSession
    sample, n = sample_matrix(df, key, vec, dim)
    if not n:
        none = spark.createDataFrame([], "key string, cluster_key string")
        return none, spark.createDataFrame([], "cluster_key string, size long, typical_key string")
    piv = fit_pivots(sample, pivot_count(n))
    count, m = len(piv), min(TOKENS, len(piv))
    base = cut(usable(df, key, vec, dim, piv), "usable")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hashes = minhashes(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int16).reshape(-1, m), count, BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
                rows = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(hashes.ravel()), *[b.column(i).take(rows) for i in range(b.num_columns)]], names=["band", "token", *b.schema.names])

    # At most BANDS * MAX_PIVOTS counts.
    sizes = base.select("ord").mapInArrow(buckets, "band int, token int, ord binary").groupBy("band", "token").count().collect()
    parts = {(r["band"], r["token"]): -(-r["count"] // CHUNK) for r in sizes}
    big = {k: v for k, v in parts.items() if v > 1}
    posted = base.select("ord", "key", "vec").mapInArrow(buckets, "band int, token int, ord binary, key string, vec binary")
    if big:
        # A bucket too large for one task is cut into parts, and each pair of parts is a task: all of its links, in bounded memory.
        many = F.broadcast(spark.createDataFrame([(int(a), int(b), int(v)) for (a, b), v in big.items()], "band int, token int, k int"))  # BANDS * MAX_PIVOTS rows at most
        posted = posted.join(many, ["band", "token"], "left")
        k = F.coalesce("k", F.lit(1))
        own = F.pmod(F.xxhash64("key"), k).cast("int")
        posted = posted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
        posted = posted.withColumn("pa", F.least("own", "other")).withColumn("pb", F.greatest("own", "other")).drop("own", "other", "k")
    else:
        posted = posted.withColumn("pa", F.lit(0)).withColumn("pb", F.lit(0))

    def link(t: pa.Table) -> pa.Table:
        u = unit(unpack(t.column("vec").to_pylist(), dim).astype(np.float64))
        tokens = np.frombuffer(b"".join(t.column("ord").to_pylist()), np.int16).reshape(-1, m)
        keys = t.column("key").to_pylist()
        found = links(u, tokens, least - 1e-9, JACCARD, count)
        return pa.table({"u": pa.array([keys[a] for a, _ in found], pa.string()), "v": pa.array([keys[b] for _, b in found], pa.string())})

    edges = posted.groupBy("band", "token", "pa", "pb").applyInArrow(link, "u string, v string")
    comp = connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("cluster_key"))
    large = comp.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= smallest)
    members = cut(skew_join(comp, large, ["cluster_key"], "key").join(base.select("key", "vec"), "key"), "members")
    return members.select("key", "cluster_key"), typical(members, dim)


def typical(members: DataFrame, dim: int) -> DataFrame:
    """cluster_key, size, typical_key: the member with the highest mean cosine to the others (equal to nine digits: the smaller key).

    ``members`` has cluster_key, key, vec and size.  First summed where the rows
    stand, so a cluster sends a few partial sums, not its members.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["cluster_key", "total"])

        for b in batches:
            if not b.num_rows:
                continue
            u = unit(unpack(b.column(1).to_pylist(), dim).astype(np.float64))
            code = b.column(0).dictionary_encode()
            total = np.zeros((len(code.dictionary), dim))
            np.add.at(total, code.indices.to_numpy(), u)
            for c, v in zip(code.dictionary.to_pylist(), total):
                held[c] = held[c] + v if c in held else v
            if len(held) > 4096:
                yield out()
                held.clear()
        if held:
            yield out()

    def merged(t: pa.Table) -> pa.Table:
        total = np.array([np.frombuffer(x, np.float64) for x in t.column("total").to_pylist()]).sum(0)
        return pa.table({"cluster_key": pa.array([t.column("cluster_key")[0].as_py()], pa.string()), "total": pa.array([total.tobytes()], pa.binary())})

    partial = members.select("cluster_key", "vec").mapInArrow(sums, "cluster_key string, total binary")
    totals = partial.groupBy("cluster_key").applyInArrow(merged, "cluster_key string, total binary")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(unpack(b.column(2).to_pylist(), dim).astype(np.float64))
                total = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(-1, dim)
                size = b.column(4).to_numpy()
                mean = (np.einsum("ij,ij->i", u, total) - 1.0) / np.maximum(size - 1, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(-np.round(mean, 9)), b.column(4)], names=["cluster_key", "key", "far", "size"])

    scored = skew_join(members, totals, ["cluster_key"], "key").select("cluster_key", "key", "vec", "total", "size").mapInArrow(means, "cluster_key string, key string, far double, size long")
    return scored.groupBy("cluster_key").agg(F.max("size").alias("size"), F.min(F.struct("far", "key"))["key"].alias("typical_key"))


def medoid_parts(u: np.ndarray, keys: list[str], least: float) -> list[tuple[int, int]]:
    """(member, medoid) of each row: the member of highest degree takes all rows linked to it, then the same among those left.

    The degree is the sum of cosines to the members left, so it costs one product
    with their sum; equal degrees (to nine digits) go to the smaller key.
    """
    left = np.array(sorted(range(len(keys)), key=lambda i: keys[i]))
    out = []
    while len(left):
        degree = np.round((u[left] @ u[left].sum(0) - 1.0) / max(1, len(left) - 1), 9)
        top = left[int(degree.argmax())]
        near = u[left] @ u[top] >= least - 1e-9
        near[left == top] = True
        out += [(int(i), int(top)) for i in left[near]]
        left = left[~near]
    return out


def split_loose(df: DataFrame, key: str, vec: str, dim: int, members: DataFrame, least: float = 0.90) -> DataFrame:
    """key, cluster_key, medoid_key: clusters joined through others, split around their members of highest degree.

    In each part every member has cosine >= ``least`` to its medoid; a tight
    cluster stays whole.  ``members`` (key, cluster_key) is the result of
    :func:`cluster`.  Clusters of up to CHUNK members are split in one task each;
    a larger one gives off one part a round, from sums, until the rest fits.
    """
    spark = df.sparkSession
    kind = "key string, cluster_key string, medoid_key string"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, m = to_matrix(b.column(1), dim)
            if len(keep):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(ordered(m[:, :FIRST]), pa.binary()), pa.array(pack(m), pa.binary())], names=["key", "low", "vec"])

    src = df.select(F.col(key).cast("string").alias("key"), F.col(vec).alias("v")).filter("key is not null and v is not null").mapInArrow(packed, "key string, low binary, vec binary")
    one = src.groupBy("key").agg(F.min(F.struct("low", "vec"))["vec"].alias("vec"))
    sizes = members.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"))
    rest = cut(skew_join(members.select("key", "cluster_key"), sizes, ["cluster_key"], "key").join(one, "key"), "loose")

    def split(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_pylist()
        u = unit(unpack(t.column("vec").to_pylist(), dim).astype(np.float64))
        found = medoid_parts(u, keys, least)
        return pa.table({"key": pa.array([keys[i] for i, _ in found], pa.string()), "cluster_key": pa.array([t.column("cluster_key")[0].as_py()] * len(found), pa.string()), "medoid_key": pa.array([keys[j] for _, j in found], pa.string())})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unit(unpack(b.column(i).to_pylist(), dim).astype(np.float64)) for i in (2, 4))
                ok = np.einsum("ij,ij->i", x, y) >= least - 1e-9
                same = np.array([a == c for a, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist())])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(ok | same)], names=["key", "cluster_key", "vec", "medoid_key", "linked"])

    out = rest.filter(F.col("size") <= CHUNK).groupBy("cluster_key").applyInArrow(split, kind)
    rest = rest.filter(F.col("size") > CHUNK)
    while not rest.isEmpty():
        heads = typical(rest, dim).select("cluster_key", F.col("typical_key").alias("medoid_key"))
        vecs = heads.join(rest.select(F.col("key").alias("medoid_key"), F.col("vec").alias("head")), "medoid_key")
        marked = cut(skew_join(rest.select("key", "cluster_key", "vec"), vecs, ["cluster_key"], "key").select("key", "cluster_key", "vec", "medoid_key", "head").mapInArrow(near, "key string, cluster_key string, vec binary, medoid_key string, linked boolean"), "marked")
        out = out.unionByName(marked.filter("linked").select("key", "cluster_key", "medoid_key"))
        left = marked.filter("not linked").select("key", "cluster_key", "vec")
        rest = cut(skew_join(left, left.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size")), ["cluster_key"], "key"), "loose")
        out = out.unionByName(rest.filter(F.col("size") <= CHUNK).groupBy("cluster_key").applyInArrow(split, kind))
        rest = rest.filter(F.col("size") > CHUNK)
    return out
