"""Permutation index: vectors as the order of their nearest pivots.

Each index vector is posted in the inverted file of its nearest pivot; a query
visits the files of its few nearest ones.  There the postings
are ranked by the footrule distance of the two orders and compared by exact
cosine, best first.  Pivots are fitted on a bounded sample; every row is indexed.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: vectors at most that the pivots are fitted on (about, by a hash of id and vector; twice as many is a hard limit)
SAMPLE = 8192
MAX_PIVOTS = 2048
#: nearest pivots in a vector's order
ORDER = 48
#: files a query visits
VISITS = 6
#: postings of a query that are compared at a time
RERANK = 32
#: vectors of one file that one task holds
CHUNK = 20_000
#: share of a file's postings, nearest by footrule, that each query is compared with in any case
FIRST = 0.12


def to_matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a usable vector, their unit-free float32 matrix).  Null, zero, wrongly long and not finite vectors, and those with a null element, are not usable."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) if len(col) else np.empty(0, int)
    ok = np.flatnonzero(lengths == dim)
    if not len(ok):
        return ok, np.empty((0, dim), np.float32)
    m = col.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ok), dim)
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    return ok[good], m[good]


def pack(m: np.ndarray) -> list[bytes]:
    """Half precision where that loses nothing, else single."""
    half = m.astype(np.float16)
    exact = (half.astype(np.float32) == m).all(1)
    return [h.tobytes() if e else v.tobytes() for h, v, e in zip(half, m, exact)]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    if rows and all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), np.float16).reshape(-1, dim).astype(np.float32)
    return np.array([np.frombuffer(r, np.float16 if len(r) == 2 * dim else np.float32) for r in rows], np.float32).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def sample_matrix(df: DataFrame, ident: str, vec: str, dim: int, size: int = SAMPLE) -> tuple[np.ndarray, int]:
    """About ``size`` unit vectors picked by a hash of id and vector, and the count of rows that have an id and a usable vector.

    Repeated rows are picked once.  The sample is empty only if that count is 0.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(to_matrix(b.column(1), dim)[0]) for b in batches)], pa.int64())], names=["n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, m = to_matrix(b.column(1), dim)
            if len(keep):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(pack(m), pa.binary())], names=["h", "v"])

    src = df.filter(F.col(ident).isNotNull() & F.col(vec).isNotNull()).select(F.xxhash64(ident, vec).alias("h"), vec)
    n = src.mapInArrow(counts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return np.empty((0, dim), np.float32), 0

    def pick(rows: DataFrame, most: int) -> np.ndarray:
        return unpack(rows.mapInArrow(packed, "h long, v binary").dropDuplicates(["h"]).orderBy("h").limit(most).toArrow().column("v").to_pylist(), dim)

    part = min(1.0, size / n)
    m = pick(src.filter(F.pmod("h", F.lit(1_000_000)) < int(math.ceil(part * 1_000_000))), 2 * size)
    if not len(m):  # few different rows that are repeated often
        m = pick(src, size)
    return unit(m), n


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Spherical means of the sample's different vectors; starts are drawn with a fixed seed.

    No two pivots nearly agree: copies of one vector would else be posted now
    under one and now under the other.
    """
    rng = np.random.default_rng(7)
    sample = sample[np.sort(np.unique(np.round(sample, 4), axis=0, return_index=True)[1])]
    piv = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ piv.T).argmax(1)
        total = np.zeros_like(piv)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        piv = total[norm > 0] / norm[norm > 0, None]
    close = np.triu(piv @ piv.T > 0.999, 1).any(0)
    return piv[~close]


def pivot_count(n: int) -> int:
    return int(min(MAX_PIVOTS, max(16, 2 ** round(math.log2(max(16.0, math.sqrt(n)))))))


def file_pivots(n: int) -> int:
    """Pivots of an index: one to some thirty rows, so that orders differ inside groups of similar vectors too."""
    return int(min(MAX_PIVOTS, max(16, 2 ** round(math.log2(max(16.0, n / 30))))))


def pivot_order(u: np.ndarray, piv: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` nearest pivots of each unit vector, nearest first."""
    m = min(m, len(piv))
    s = u @ piv.T
    near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(piv) else np.tile(np.arange(len(piv)), (len(u), 1))
    rank = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, rank, 1).astype(np.int16)


def footrule(q: np.ndarray, x: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distances of two sets of pivot orders; a pivot missing from one stands at the place after its last."""
    m = q.shape[1]
    place = np.full((pivots, len(x)), m, np.int16)
    for j in range(m):
        place[x[:, j], np.arange(len(x))] = j
    gone = m * (m + 1) // 2  # what all of x's pivots cost if q has none of them
    dist = np.full((len(q), len(x)), gone, np.int16)
    for j in range(m):
        at = place[q[:, j]]
        # shared: |j - at| instead of (m - j) alone, and x's own share (m - at) is no longer owed; absent: at == m
        dist += np.abs(j - at) - (m - at)
    return dist


class Parts:
    """Into how many parts each file is split: an upper bound of its size, from its share of the sample, over ``chunk``.  Only files of more than one are held."""

    def __init__(self, found: np.ndarray, n: int, chunk: int):
        key, k = np.unique(found.ravel(), return_counts=True)
        k = k.astype(float)
        bound = (k + 3 * np.sqrt(k + 1) + 3) * max(1.0, n / max(len(found), 1))
        parts = np.maximum(1, np.ceil(np.minimum(bound, n * found.shape[1]) / chunk)).astype(np.int32)
        self.key, self.parts = key[parts > 1], parts[parts > 1]
        # a file that no sampled row lies in
        self.other = max(1, math.ceil(6 * max(1.0, n / max(len(found), 1)) / chunk))

    def __call__(self, cell: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(cell), self.other, np.int32)
        at = np.minimum(np.searchsorted(self.key, cell), len(self.key) - 1)
        return np.where(self.key[at] == cell, self.parts[at], self.other).astype(np.int32)


_POST = "cell int, ipart int, qpart int, q string, i long, ord binary, vec binary"


def _postings(df: DataFrame, ident: str, vec: str, dim: int, piv: np.ndarray, visits: int, own: Parts, other: Parts, query: bool) -> DataFrame:
    """One row per file and part; each side's rows are spread over its own parts and repeated for each of the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, m = to_matrix(b.column(1), dim)
            if not len(keep):
                continue
            order = pivot_order(unit(m), piv, ORDER)
            packed, ids = np.array(pack(m), object), b.column(0).take(pa.array(keep)).to_pylist()
            h = b.column(2).take(pa.array(keep)).to_numpy()
            rows, files, mine, theirs = [], [], [], []
            for c in order[:, :visits].T.astype(np.int32):
                k = other(c)
                for t in range(int(k.max())):
                    r = np.flatnonzero(k > t)
                    rows.append(r), files.append(c[r]), mine.append((h[r] % own(c[r])).astype(np.int32)), theirs.append(np.full(len(r), t, np.int32))
            r = np.concatenate(rows)
            mine, theirs = pa.array(np.concatenate(mine)), pa.array(np.concatenate(theirs))
            key = [ids[k] for k in r]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(files)), theirs if query else mine, mine if query else theirs,
                pa.array(key if query else [None] * len(r), pa.string()), pa.array([None] * len(r) if query else key, pa.int64()),
                pa.array([order[k].tobytes() for k in r], pa.binary()), pa.array(packed[r].tolist(), pa.binary()),
            ], names=["cell", "ipart", "qpart", "q", "i", "ord", "vec"])

    src = df.select(F.col(ident).cast("string" if query else "long"), vec, F.pmod(F.xxhash64(ident), F.lit(1 << 30)).alias("h")).filter(F.col(ident).isNotNull() & F.col(vec).isNotNull())
    return src.mapInArrow(run, _POST)


def ranked_rerank(qo: np.ndarray, xo: np.ndarray, qv: np.ndarray, xv: np.ndarray, pivots: int, least: float, first: float, block: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, posting, cosine) of the pairs with cosine >= ``least``, and how many pairs were compared exactly.

    For each query the postings are ranked by footrule distance.  The nearest
    share ``first`` of them (``block`` at least) is compared, then block after
    block, best first, as long as the last one held a similar vector.
    """
    qs, xs, cs, compared = [], [], [], 0
    step = max(1, min(1024, 4_000_000 // max(1, len(xo))))
    n = len(xo)
    for a in range(0, len(qo), step):
        rank = np.argsort(footrule(qo[a: a + step], xo, pivots), axis=1, kind="stable")
        active, at, size = np.arange(len(rank)), 0, max(block, math.ceil(first * n))
        while len(active) and at < n:
            cols = rank[active, at: at + size]
            found = np.zeros(len(rank), bool)
            compared += cols.size
            for b in range(0, len(active), max(1, 200_000 // cols.shape[1])):  # bounded memory
                some = active[b: b + max(1, 200_000 // cols.shape[1])]
                c = cols[b: b + len(some)]
                rough = np.matmul(xv[c], qv[a + some][:, :, None])[:, :, 0]
                q, x = np.nonzero(rough >= least - 1e-4)
                q, x = some[q], c[q, x]
                cos = np.einsum("ij,ij->i", unit(qv[a + q].astype(np.float64)), unit(xv[x].astype(np.float64))) if len(q) else np.empty(0)
                hit = cos >= least - 1e-9
                qs.append(a + q[hit]), xs.append(x[hit]), cs.append(cos[hit])
                found[q[hit]] = True
            active, at, size = active[found[active]], at + size, block
    if not qs:
        return np.empty(0, int), np.empty(0, int), np.empty(0), compared
    return np.concatenate(qs), np.concatenate(xs), np.concatenate(cs), compared


def similar(queries: DataFrame, qid: str, qvec: str, index: DataFrame, iid: str, ivec: str, dim: int, k: int = 10, least: float = 0.90, visits: int = VISITS, first: float = FIRST) -> DataFrame:
    """q, i, cosine: up to ``k`` index vectors with cosine >= ``least`` for each query vector, best first, then smaller id.

    Unusable vectors (see :func:`to_matrix`) and null ids take no part; repeated
    query rows count once; empty tables give no rows.  Equal cosines (to nine
    digits) are ties.  Files of any size are split into parts of about CHUNK
    rows on both sides, and each pair of parts is a task of bounded size.
    """
    spark = queries.sparkSession
    isample, n = sample_matrix(index, iid, ivec, dim)
    qsample, nq = sample_matrix(queries, qid, qvec, dim)
    if not n or not nq:
        return spark.createDataFrame([], "q string, i long, cosine double")
    piv = fit_pivots(isample, file_pivots(n))
    count = len(piv)
    iparts = Parts(pivot_order(isample, piv, 1), n, CHUNK)
    qparts = Parts(pivot_order(qsample, piv, visits), nq, CHUNK)
    posts = _postings(index, iid, ivec, dim, piv, 1, iparts, qparts, False).unionByName(_postings(queries, qid, qvec, dim, piv, visits, qparts, iparts, True))
    m = min(ORDER, count)

    def search(t: pa.Table) -> pa.Table:
        is_q = np.array(t.column("q").is_valid().to_pylist(), bool)
        empty = pa.table({"q": pa.array([], pa.string()), "qh": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if is_q.all() or not is_q.any():
            return empty
        qt, it = t.filter(pa.array(is_q)), t.filter(pa.array(~is_q))
        # Copies of one vector are compared once; of equal cosines the smaller ids count, so k of each are all that can be among the best.
        ids = it.column("i").to_numpy()
        code = it.column("vec").combine_chunks().dictionary_encode()
        which = code.indices.to_numpy()
        by = np.lexsort((ids, which))
        begin = np.flatnonzero(np.r_[True, np.diff(which[by]) > 0])
        nth = np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)]))
        first_of, copies = by[begin], np.minimum(np.diff(np.r_[begin, len(by)]), k)
        kept = ids[by[nth < k]]
        start = np.r_[0, np.cumsum(copies)[:-1]]
        orders = [np.frombuffer(b"".join(x), np.int16).reshape(-1, m) for x in (qt.column("ord").to_pylist(), it.column("ord").take(pa.array(first_of)).to_pylist())]
        qv, iv = (unit(unpack(x, dim)) for x in (qt.column("vec").to_pylist(), it.column("vec").take(pa.array(first_of)).to_pylist()))
        q, x, cos, _ = ranked_rerank(orders[0], orders[1], qv, iv, count, least, first)
        if not len(q):
            return empty
        many = copies[x]
        i = kept[np.repeat(start[x], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        q, cos = np.repeat(q, many), np.repeat(cos, many)
        best = np.lexsort((i, -np.round(cos, 9), q))
        q, i, cos = q[best], i[best], cos[best]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0))
        keep = place < k
        q, i, cos = q[keep], i[keep], cos[keep]
        vecs, keys = qt.column("vec").to_pylist(), qt.column("q").to_pylist()
        hashes = {r: hash_bytes(vecs[r]) for r in set(q.tolist())}
        return pa.table({"q": pa.array([keys[r] for r in q], pa.string()), "qh": pa.array([hashes[r] for r in q.tolist()], pa.int64()), "i": pa.array(i, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    found = posts.groupBy("cell", "ipart", "qpart").applyInArrow(search, "q string, qh long, i long, cosine double")
    once = found.groupBy("q", "qh", "i").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("q", "qh").orderBy(F.round("cosine", 9).desc(), "i")
    return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "i", "cosine")


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b) - (1 << 63)
