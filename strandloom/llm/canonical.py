"""Free-entered values mapped to the entries of a reference list.

A trie holds every entry, its aliases and their word orders as glued lower-case
letters.  A Levenshtein automaton for the value walks the trie and returns all
entries within the distance that their length allows.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import skew_join
from strandloom.session import cut
from strandloom.tables import is_missing

K = 3  # the largest distance any entry allows
WIDTH = 2 * K + 1
INF = K + 1
#: entries that fit one trie; longer lists are searched in blocks
BLOCK = 20_000

# Words that tell side, state or handling and never the entry.
REMARKS = frozenset(
    "left right l r lft rt lt rgt frozen snap fresh fixed dissected adult neonatal juvenile mouse mice murine biopsy sample samples tissue "
    "homogenate lysate whole half piece pieces perfused rnalater bulk rna rep replicate stored pooled pool section of from the in".split()
)

SIDES = frozenset("left right l r lft rt lt rgt".split())


def allowed(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 11 else K


def words(value: str) -> list[str]:
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value)).lower()
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.findall(r"[a-z]+|\d+", s)


def _one_slip(a: str, b: str) -> bool:
    """One letter added, lost, changed or swapped with its neighbour."""
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:] or (a[i: i + 2] == b[i: i + 2][::-1] and a[i + 2:] == b[i + 2:])


def _exact(word: str) -> str | None:
    return word if word in REMARKS else None


@lru_cache(100_000)
def remark(word: str) -> str | None:
    """The remark a word is, perhaps with one slip of the pen."""
    if word in REMARKS:
        return word
    if len(word) > 3:
        return next((r for r in sorted(REMARKS) if len(r) > 3 and abs(len(r) - len(word)) < 2 and _one_slip(word, r)), None)
    return None


def readings(value: str) -> list[tuple[str, int]]:
    """Glued letters of a value and the words left out for them: all of it, without what follows a separator, without remarks."""
    out: dict[str, int] = {}
    full = words(value)

    def add(ws: list[str]) -> None:
        if ws:
            out.setdefault("".join(ws), len(full) - len(ws))
            if len(ws) > 4:
                out.setdefault("".join(sorted(ws)), len(full) - len(ws))

    add(full)
    head = words(re.sub(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|[;/#].*$|\s-\s.*$", " ", value)) or full
    add(head)
    for kept in ({"whole", "tissue"} | SIDES, {"tissue"} | SIDES, {"whole"} | SIDES, {"whole", "tissue"}, {"tissue"}, {"whole"}, SIDES, frozenset()):
        for of in (_exact, remark):
            add([w for w in head if (not (r := of(w)) or r in kept) and not w.isdigit()])
    if head and head[-1] == "tissue":
        add(head[:-1])
    return list(out.items())


class Automaton:
    """Levenshtein automaton with adjacent transpositions, in its position-free form.

    A state is a band of errors around the diagonal together with the band
    before it.  What a letter does to a state depends only on which of the
    letters near the diagonal it equals, so steps are kept once made and serve
    every value.
    """

    def __init__(self) -> None:
        start = tuple(d if d >= 0 else INF for d in range(-K, K + 1))
        self.rows: list[tuple] = [(start, (INF,) * WIDTH)]
        self.ids: dict[tuple, int] = {self.rows[0]: 0}
        self.least: list[int] = [0]
        self.steps: dict[tuple[int, int, int], int] = {}

    def step(self, state: int, bits: int, before: int) -> int:
        key = (state, bits, before)
        to = self.steps.get(key)
        if to is None:
            row, prev = self.rows[state]
            new = [INF] * WIDTH
            for d in range(WIDTH):
                e = row[d] + (0 if bits >> d & 1 else 1)
                if d + 1 < WIDTH and row[d + 1] + 1 < e:
                    e = row[d + 1] + 1
                if d and new[d - 1] + 1 < e:
                    e = new[d - 1] + 1
                # the letter equals the value's one before last, and the letter before it the value's last
                if d and bits >> (d - 1) & 1 and before >> d & 1 and prev[d] + 1 < e:
                    e = prev[d] + 1
                new[d] = min(e, INF)
            pair = (tuple(new), row)
            to = self.ids.setdefault(pair, len(self.rows))
            if to == len(self.rows):
                self.rows.append(pair)
                self.least.append(min(new))
            self.steps[key] = to
        return to


def orders(ws: list[str]) -> set[tuple[str, ...]]:
    """Word orders that lead to an entry: all of few words; of more, which have too many, each rotation and the sorted one, under which any order is looked up."""
    if len(ws) <= 4:
        return set(permutations(ws))
    return {(*ws[i:], *ws[:i]) for i in range(len(ws))} | {tuple(sorted(ws))}


class Trie:
    """Entries (text, id); every word order leads to the entry."""

    def __init__(self, entries: Iterable[tuple[str, int]]):
        self.root: dict = {}
        self.auto = Automaton()
        for text, ident in entries:
            ws = words(text)
            for order in orders(ws):
                self._add("".join(order), ident)

    def _add(self, glued: str, ident: int) -> None:
        if not glued:
            return
        node = self.root
        for c in glued:
            node = node.setdefault(c, {})
        ends = node.setdefault("", [])
        if ident not in ends:
            ends.append(ident)

    def search(self, glued: str) -> dict[int, int]:
        """id -> smallest distance, of every entry within the distance its length allows."""
        n, at = len(glued), {}
        for i, c in enumerate(glued):
            at[c] = at.get(c, 0) | 1 << (i + K)
        found: dict[int, int] = {}
        window = (1 << WIDTH) - 1
        auto, rows, least = self.auto, self.auto.rows, self.auto.least
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, state, before = stack.pop()
            for c, child in node.items():
                if not c:
                    d = n - depth
                    if -K <= d <= K:
                        e = rows[state][0][d + K]
                        if e <= allowed(depth):
                            for ident in child:
                                if e < found.get(ident, INF):
                                    found[ident] = e
                    continue
                bits = at.get(c, 0) >> depth & window
                to = auto.step(state, bits, before)
                if least[to] <= K:
                    # the next letter's window lies one further, so this letter's matches move down by one
                    stack.append((child, depth + 1, to, bits >> 1))
        return found

    def match(self, value: str) -> tuple[int, int, int]:
        """(distance, words left out, id) of the closest entry, or (INF, 0, -1).  Ties go to the reading that keeps most words, then the smaller id."""
        best = (INF, 0, -1)
        for glued, left_out in readings(value):
            for ident, e in self.search(glued).items():
                best = min(best, (e, left_out, ident))
            if best[0] == 0 and left_out == 0:
                break
        return best


def reference_entries(terms: DataFrame, ident: str, term: str, synonyms: str, separator: str = ";") -> DataFrame:
    names = F.concat(F.array(F.col(term)), F.coalesce(F.split(F.col(synonyms), separator), F.array()))
    return terms.select(F.explode(names).alias("name"), F.col(ident).alias("ident")).filter("trim(name) <> '' and ident is not null").distinct()


def _matcher(rows: list[tuple[str, int]]):
    held: dict[str, Trie] = {}

    def run(values: pd.Series) -> pd.DataFrame:
        if "trie" not in held:
            held["trie"] = Trie(rows)
        known = {v: held["trie"].match(v) for v in values.unique()}
        return pd.DataFrame([known[v] for v in values], columns=["dist", "left", "ident"])

    return run


def match_values(df: DataFrame, value: str, entries: DataFrame, out: str = "term_id") -> DataFrame:
    """``df`` plus ``out``: the id of the entry meant by ``value``, -1 where none is close enough; rows without a value are left out.

    ``df`` must have no columns named ``out`` or beginning with ``m_``.  A list of
    up to BLOCK entries needs no shuffle: values are matched once per batch where
    they stand.  A longer one goes to the tasks in blocks, which each different
    value meets once; the best of all blocks counts.  An empty list gives -1
    everywhere.
    """
    kept = df.filter(~is_missing(F.col(f"`{value}`")))
    n = entries.count()
    blocks = max(1, -(-n // BLOCK))

    def matcher(b: int):
        part = entries if blocks == 1 else entries.filter(F.pmod(F.xxhash64("name", "ident"), F.lit(blocks)) == b)
        return F.pandas_udf(_matcher(sorted((r["name"], r["ident"]) for r in part.collect())), "dist int, left int, ident int")  # BLOCK entries on average

    if blocks == 1:
        return kept.withColumn("m_0", matcher(0)(F.col(f"`{value}`"))).withColumn(out, F.col("m_0.ident")).drop("m_0")
    # Each different value meets the blocks once, however many rows hold it.
    values = cut(kept.select(F.col(f"`{value}`").alias("m_value")).distinct(), "values")
    found = None
    for b in range(blocks):
        part = values.withColumn("m", matcher(b)("m_value"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("m_value").agg(F.min("m")["ident"].alias("m_ident"))
    return skew_join(kept.withColumn("m_value", F.col(f"`{value}`")).withColumn("m_row", F.monotonically_increasing_id()), best, ["m_value"], "m_row").withColumn(out, F.col("m_ident")).drop("m_value", "m_ident", "m_row")


def unmatched(matched: DataFrame, value: str, out: str = "term_id") -> DataFrame:
    """value, n_rows of the values that mean no entry."""
    return matched.filter(F.col(out) == -1).groupBy(F.col(f"`{value}`").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
