"""Evaluation texts inside a corpus: SimHash of item-sized windows.

Every window of the items and of the documents gets a 64-bit SimHash of its
words.  Fingerprints are cut into blocks; two that differ in at most RADIUS bits
agree in one of RADIUS + 1 blocks, so block tables find every such pair.  Pairs
within the radius are verified by the exact weighted similarity of their word
shingles and then word by word.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import spread

WINDOW = 12
SHINGLE = 5
RADIUS = 3
BLOCKS = RADIUS + 1
#: words of the items that one pass holds; longer lists are taken in blocks
ITEM_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    s = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _WORD.findall(s.lower())


class Hasher:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def simhashes(h: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of WINDOW words: per bit, do most of their hashes set it?"""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    two = bits[:-1] + bits[1:]
    four = two[:-2] + two[2:]
    total = four[:-8] + four[4:-4] + four[8:]
    return np.packbits(total > WINDOW // 2, axis=1).reshape(-1).view(np.uint64)


class Index:
    """Windows of the items, by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        hasher = Hasher()
        ids, runs = [], []
        for ident, text in items:
            h = hasher(words(text))
            for a in range(len(h) - WINDOW + 1):
                ids.append(ident), runs.append(h[a: a + WINDOW])
        self.ids = np.array(ids, np.int64)
        self.runs = np.array(runs, np.uint64).reshape(-1, WINDOW)
        self.prints = np.concatenate([simhashes(r) for r in self.runs]) if len(ids) else np.empty(0, np.uint64)
        self.bits = 64 // BLOCKS
        self.tables = []
        for b in range(BLOCKS):
            v = self._block(self.prints, b)
            order = np.argsort(v, kind="stable").astype(np.int32)
            count = np.bincount(v, minlength=1 << self.bits).astype(np.int32)
            self.tables.append((order, np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int32), count))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.bits) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within RADIUS bits."""
        left, right = [], []
        for b, (order, start, count) in enumerate(self.tables):
            v = self._block(prints, b)
            n = count[v]
            at = np.flatnonzero(n)
            n = n[at]
            w = np.repeat(at, n)
            inside = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            i = order[start[v[w]] + inside]
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            left.append(w[near]), right.append(i[near])
        pairs = np.unique(np.concatenate(left).astype(np.int64) * max(1, len(self.prints)) + np.concatenate(right))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def _shingles(runs: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE words in each window."""
    out = np.zeros((len(runs), WINDOW - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + runs[:, j: j + out.shape[1]]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the word shingles of two windows each; a shingle weighs more the more of its words differ from each other."""
    sa, sb = _shingles(a), _shingles(b)

    def weight(r: np.ndarray) -> np.ndarray:
        grams = np.stack([r[:, j: j + SHINGLE] for j in range(r.shape[1] - SHINGLE + 1)], 1)
        s = np.sort(grams, 2)
        return 1.0 + (s[:, :, 1:] != s[:, :, :-1]).sum(2)

    wa, wb = weight(a), weight(b)
    same = sa[:, :, None] == sb[:, None, :]
    both = (np.where(same.any(2), wa, 0).sum(1) + np.where(same.any(1), wb, 0).sum(1)) / 2
    return both / np.maximum(wa.sum(1) + wb.sum(1) - both, 1e-9)


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: float = 1.0) -> DataFrame:
    """doc_id, item_id: each document with the items of which it holds WINDOW consecutive words.

    With ``least`` below 1 a window counts when the similarity of its shingles
    reaches it, hence also with a word changed, as far as RADIUS bits go.  Null
    and empty texts, and items shorter than a window, give no rows.  Documents
    are read whole, in the tasks that scan them; only the items' windows travel,
    ITEM_WORDS words at a time.
    """
    spark = docs.sparkSession
    src = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).filter("doc_id is not null and t <> ''"))
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    size = chosen.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_WORDS))
    out = None
    for b in range(blocks):
        rows = [(r["i"], r["t"]) for r in chosen.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]  # ITEM_WORDS words on average
        part = src.mapInPandas(_finder(sorted(rows), least), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else spark.createDataFrame([], "doc_id long, item_id long")).distinct()


def _finder(rows: list[tuple[int, str]], least: float):
    held: dict[str, object] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not held:
            held.update(index=Index(rows), hasher=Hasher())
        index, hasher = held["index"], held["hasher"]
        if not len(index.prints):
            return
        for pdf in batches:
            pending: list[tuple[int, np.ndarray]] = []
            size = 0
            for ident, text in zip(pdf["doc_id"], pdf["t"]):
                h = hasher(words(text))
                if len(h) >= WINDOW:
                    pending.append((ident, h))
                    size += len(h)
                if size > 200_000:
                    yield _matches(pending, index, least)
                    pending, size = [], 0
            if pending:
                yield _matches(pending, index, least)

    return run


def _matches(docs: list[tuple[int, np.ndarray]], index: Index, least: float, step: int = 200_000) -> pd.DataFrame:
    h = np.concatenate([x for _, x in docs])
    owner = np.repeat(np.array([i for i, _ in docs], np.int64), [len(x) for _, x in docs])
    place = np.repeat(np.arange(len(docs)), [len(x) for _, x in docs])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(h) - WINDOW + 1, step):
        part = h[a: a + step + WINDOW - 1]
        w, i = index.candidates(simhashes(part))
        w = w + a
        inside = place[w] == place[w + WINDOW - 1]
        w, i = w[inside], i[inside]
        if not len(w):
            continue
        runs = h[w[:, None] + np.arange(WINDOW)]
        ok = similarity(runs, index.runs[i]) >= least - 1e-9
        if least >= 1:
            ok &= (runs == index.runs[i]).all(1)
        found.append((owner[w[ok]], index.ids[i[ok]]))
    if not found:
        return pd.DataFrame({"doc_id": np.empty(0, np.int64), "item_id": np.empty(0, np.int64)})
    return pd.DataFrame({"doc_id": np.concatenate([x for x, _ in found]), "item_id": np.concatenate([y for _, y in found])}).drop_duplicates()
