"""Filling fixed-capacity containers: a configuration program over the length histogram.

A configuration says how many items of each length one container takes.  The
covering program over all configurations is solved by multiplicative weights,
each step pricing the best configurations by knapsack dynamic programming, until
every length is covered; the solution is rounded, and only what no use has room
for is filled greedily by length.  All of
this works on the histogram, whose size is bounded by the capacity; the items
themselves are numbered and assigned where they are.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut, spread

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how the byte-level tokenizer splits a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: texts are tokenized in stretches of this many characters or more, cut where the tokenizer always splits
STRETCH = 100_000
#: least covered share of a length, decline of weights with it, gain of a use, configurations priced at once, and their perturbation
SHORT, ETA, STEP, RUNS, SPREAD = 0.98, 2.0, 0.5, 96, 0.05
#: lengths that a step prices
PRICED = 256
_held: dict[str, object] = {}


def tokenizer(vocabulary: str):
    if vocabulary not in _held:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held[vocabulary] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held[vocabulary]


_SPLIT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def stretches(text: str) -> Iterator[str]:
    """Cut before a blank between two letters, where no token reaches across; without such a place a stretch goes on."""
    at = 0
    while len(text) - at > STRETCH and (m := _SPLIT.search(text, at + STRETCH)):
        yield text[at: m.start()]
        at = m.start()
    yield text[at:]


def token_count(text: str | None, enc) -> int:
    return 0 if not text else sum(len(enc.encode_ordinary(s)) for s in stretches(text))


def best_configurations(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """For each row of ``prices`` the items of each length in the container of highest total price (lengths ascending, any number of each; a price of 0 or less is never taken)."""
    runs, m = prices.shape
    p = np.ascontiguousarray(prices.T, np.float32)
    value = np.zeros((capacity + 1, runs), np.float32)
    room = np.empty((m, runs), np.float32)
    top = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        k = top[c]
        value[c] = value[c - 1]
        if k:
            np.take(value, c - lengths[:k], axis=0, out=room[:k], mode="clip")
            np.add(room[:k], p[:k], out=room[:k])
            np.maximum(value[c], np.maximum.reduce(room[:k]), out=value[c])
    out = np.zeros((runs, m), np.int64)
    for r in range(runs):
        v, c = value[:, r], capacity
        while c > 0:
            c = int(np.searchsorted(v, v[c] - 1e-6 * max(1.0, v[c])))  # the smallest capacity of this value
            k = top[c]
            if c <= 0 or not k:
                break
            gain = np.where(p[:k, r] > 0, v[c - lengths[:k]] + p[:k, r], -1.0)
            j = int(gain.argmax())
            if gain[j] < v[c] - 1e-5 * max(1.0, v[c]):
                c -= 1
                continue
            out[r, j] += 1
            c -= int(lengths[j])
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """(configurations and how often each is used, share of each length that they cover), by multiplicative weights.

    Every length is covered to SHORT or more, none beyond its count.  A length's
    price is its size times exp(-ETA * covered share): of full containers the
    least covered lengths are worth most.  Each step prices RUNS configurations
    at once, under small perturbations of the weights (fixed seed), and uses each
    until its tightest length has gained STEP of its count (less where there are few lengths).
    """
    counts = counts.astype(float)
    rng = np.random.default_rng(5)
    cover = np.zeros(len(lengths))
    # few lengths are covered in small steps, which cost little and keep their weights even
    most = float(np.clip(len(lengths) / 2000, 0.02, STEP))
    used: dict[bytes, list] = {}
    while (cover < SHORT).any():
        open_ = np.flatnonzero(cover < 1 - 1e-9)
        if len(open_) > PRICED:
            # partial pricing: the least covered lengths and as many others
            order = open_[np.argsort(cover[open_] + 1e-3 * rng.random(len(open_)))]
            open_ = np.sort(np.concatenate([order[: PRICED // 2], rng.choice(order[PRICED // 2:], PRICED // 2, replace=False)]))
        price = lengths[open_] * np.exp(-ETA * (cover[open_] - cover[open_].min())) * np.exp(SPREAD * rng.standard_normal((RUNS, len(open_))))
        for part in best_configurations(price / price.max(), lengths[open_], capacity):
            some = open_[part > 0]
            if not len(some):
                continue
            many = part[part > 0]
            step = float((np.minimum(most, 1 - cover[some]) * counts[some] / many).min())
            if step <= 1e-12:
                continue
            cover[some] += many * step / counts[some]
            a = np.zeros(len(lengths), np.int64)
            a[some] = many
            used.setdefault(a.tobytes(), [a, 0.0])[1] += step
    return [(a, x) for a, x in used.values()], cover


def _filled(a: np.ndarray, left: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """``a`` and what fits beside it of the items left, longest first."""
    a = a.copy()
    room = capacity - int(a @ lengths)
    j = int(np.searchsorted(lengths, room, side="right")) - 1
    while room > 0 and j >= 0:
        n = int(min(left[j] - a[j], room // lengths[j]))
        if n > 0:
            a[j] += n
            room -= n * int(lengths[j])
        j = min(j - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
    return a


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, program: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int, str]]:
    """(configuration, containers, origin) that hold all items exactly.

    The uses are rounded in turn, so that their running sum is never off by one
    ('program').  A use whose items are partly gone keeps the rest of its
    configuration and is filled up.  What no use has room for is filled by
    falling length ('rest').
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int, str]] = []
    partly: list[tuple[np.ndarray, int]] = []
    total, given = 0.0, 0
    for a, x in sorted(program, key=lambda p: -p[1]):
        total += x
        k = int(np.floor(total + 0.5)) - given
        given += k
        some = a > 0
        whole = int(min(k, (left[some] // a[some]).min()))
        if whole:
            out.append((a, whole, "program"))
            left -= whole * a
        if k > whole:
            partly.append((a, k - whole))
    # what is left of the most used length first, so that long items find their places
    for a, k in partly:
        while k > 0 and left.any():
            b = _filled(np.minimum(a, left), left, lengths, capacity)
            some = b > 0
            n = int(min(k, (left[some] // b[some]).min()))
            out.append((b, n, "program"))
            left -= n * b
            k -= n
    # gaps that items left over still fit in
    for i in range(len(out)):
        if not left.any():
            break
        a, k, how = out[i]
        b = _filled(a, left + a, lengths, capacity)
        more = b - a
        if more.any():
            some = more > 0
            n = int(min(k, (left[some] // more[some]).min()))
            out[i] = (b, n, how)
            if k > n:
                out.append((a, k - n, how))
            left -= n * more
    while left.any():
        a = _filled(np.zeros(len(lengths), np.int64), left, lengths, capacity)
        some = a > 0
        k = int((left[some] // a[some]).min())
        out.append((a, k, "rest"))
        left -= k * a
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int, str]]:
    """(configuration, containers, origin) that hold all items exactly; no items need none."""
    if not len(lengths):
        return []
    return rounded(lengths, counts, capacity, fractional(lengths, counts, capacity)[0])


def pieces(df: DataFrame, ident: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """id, piece, tokens: one row per text, more only for one that alone exceeds the capacity.  Null and empty texts have one piece of 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(vocabulary)
        for pdf in batches:
            n = np.array([token_count(t, enc) for t in pdf["t"]], np.int64)
            parts = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "piece": piece, "tokens": np.minimum(n[row] - piece * capacity, capacity)})

    src = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t")).filter("id is not null")
    return spread(src).mapInPandas(run, "id long, piece int, tokens int")


def pack(df: DataFrame, ident: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece, tokens, container: every piece in a container, none above ``capacity`` tokens.

    Pieces of 0 tokens need no room and stand in container 0.  Repeated rows are
    items of their own.  An empty table gives no rows.
    """
    spark = df.sparkSession

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for pdf in batches:
            at = pdf["tokens"].to_numpy()
            nth = seen[at] + pdf.groupby("tokens").cumcount().to_numpy()
            np.add.at(seen, at, 1)
            yield pdf.assign(part=part, nth=nth)

    items = cut(pieces(df, ident, text, capacity, vocabulary).mapInPandas(numbered, "id long, piece int, tokens int, part int, nth long"), "pieces")
    per = items.groupBy("part", "tokens").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("part", "tokens", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    histogram = sorted((r["tokens"], r["n"]) for r in per.filter("tokens > 0").groupBy("tokens").agg(F.sum("n").alias("n")).collect())  # a row a length, capacity at most
    lengths, counts = np.array([t for t, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    chosen = plan(lengths, counts, capacity)
    # Per length: the item numbers at which each configuration's share begins, its first container, and its items per container.
    # The number of configurations follows the number of lengths, whatever the number of items.
    ranges: dict[int, list[tuple[int, int, int]]] = {int(t): [] for t in lengths}
    given, base = np.zeros(len(lengths), np.int64), 0
    for a, k, _ in chosen:
        for j in np.flatnonzero(a):
            ranges[int(lengths[j])].append((int(given[j]), base, int(a[j])))
        given += k * a
        base += k
    table = {t: tuple(np.array(c) for c in zip(*r)) for t, r in ranges.items()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            nth, tokens = (pdf["nth"] + pdf["start"]).to_numpy(), pdf["tokens"].to_numpy()
            for t in np.unique(tokens):
                if t:
                    first, container, many = table[int(t)]
                    at = np.flatnonzero(tokens == t)
                    r = np.searchsorted(first, nth[at], side="right") - 1
                    out[at] = container[r] + (nth[at] - first[r]) // many[r]
            yield pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "tokens": tokens, "container": out})

    return items.join(starts, ["part", "tokens"]).mapInPandas(assign, "id long, piece int, tokens int, container long")
