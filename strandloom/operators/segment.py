"""Several values packed in one field: dictionary-guided segmentation.

A scan finds quoted stretches, a multi-pattern automaton finds known whole
values in quotes, and dynamic programming picks the best cover of the text;
delimiters inside a chosen stretch are protected.  Known values decide where
quotes alone do not: quotes inside a value that were not doubled, or stray ones.
The dictionary is learned from every row, and every text meets it: whole, in one
automaton, or, where it is too long for that, the part of it that a join by
quoted stretches finds possible in the texts at hand.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut
from strandloom.tables import is_missing

_QUOTED = re.compile(r'"((?:[^"]|"")*)"')


class Segmenter:
    """Splits texts at any of ``delimiters``.

    ``values`` are known whole values; those that hold no delimiter need no
    protection and are left out.  They count where they stand in quotes, with
    ``unquoted`` also elsewhere.  ``glue`` are signs after which a value may
    begin inside an item (a key and its value).  ``bind`` matches a label whose
    following blank does not split.
    """

    def __init__(self, delimiters: str, values: Iterable[str] = (), glue: str = ":=", bind: str | None = None, unquoted: bool = False):
        self.delimiters, self.glue = set(delimiters), set(glue)
        self.bind = re.compile(bind) if bind else None
        self.auto = ahocorasick.Automaton()
        for v in values:
            v = v.strip()
            if self.delimiters & set(v):
                for written in {f'"{v}"', '"' + v.replace('"', '""') + '"'} | ({v} if unquoted else set()):
                    self.auto.add_word(written, (len(written), v))
        if len(self.auto):
            self.auto.make_automaton()

    def _starts(self, s: str, i: int) -> bool:
        """May a value begin at i?  At the start, after a delimiter, or after a key's sign."""
        j = i - 1
        while j >= 0 and s[j] == " ":
            j -= 1
        return j < 0 or s[j] in self.delimiters or s[j] in self.glue or (" " in self.delimiters and j < i - 1)

    def _ends(self, s: str, i: int) -> bool:
        j = i
        while j < len(s) and s[j] == " ":
            j += 1
        return j >= len(s) or s[j] in self.delimiters or (" " in self.delimiters and j > i)

    def quoted(self, s: str) -> tuple[list[tuple[int, int, str]], bool]:
        """(start, end, text) of the stretches whose quotes stand beside delimiters, and whether they hold all quotes of the text."""
        spans = []
        i = s.find('"')
        while i >= 0:
            m = _QUOTED.match(s, i)
            if m and self._starts(s, i) and self._ends(s, m.end()):
                spans.append((i, m.end(), m.group(1).replace('""', '"')))
                i = s.find('"', m.end())
            else:
                i = s.find('"', i + 1)
        return spans, s.count('"') == sum(s.count('"', a, b) for a, b, _ in spans)

    def protected(self, s: str) -> list[tuple[int, int, str]]:
        """(start, end, text) of the values in the best cover, from left to right.

        Where all quotes are clear, a known value neither begins nor ends in a
        quoted stretch without being that stretch.
        """
        spans, clear = self.quoted(s)
        begins, stretches = [a for a, _, _ in spans], list(spans)

        def fits(a: int, b: int) -> bool:
            x, y = bisect_right(begins, a) - 1, bisect_left(begins, b) - 1
            if x >= 0 and stretches[x][:2] == (a, b):
                return True
            return not (x >= 0 and a < stretches[x][1]) and not (y >= 0 and b <= stretches[y][1])

        known: set[tuple[int, int]] = set()
        if len(self.auto):
            for end, (n, v) in self.auto.iter(s):
                a = end + 1 - n
                if self._starts(s, a) and self._ends(s, end + 1) and (not clear or fits(a, end + 1)):
                    known.add((a, end + 1))
                    spans.append((a, end + 1, v))
        if len(spans) < 2:
            return spans
        spans.sort(key=lambda x: (x[1], x[0]))
        ends = [0]
        best: list[tuple[int, tuple | None]] = [(0, None)]  # weight of the best cover up to an end, the way there
        for sp in spans:
            k = bisect_right(ends, sp[0]) - 1
            score = best[k][0] + (sp[1] - sp[0]) * (2 if sp[:2] in known else 1)  # a known value counts twice
            if score > best[-1][0]:
                best.append((score, (sp, k)))
                ends.append(sp[1])
        out, k = [], len(best) - 1
        while best[k][1]:
            sp, k = best[k][1]
            out.append(sp)
        return out[::-1]

    @staticmethod
    def inside(text: str) -> str:
        """The text without white space and brackets around it."""
        s = text.strip()
        if len(s) > 1 and s[0] + s[-1] in ("[]", "()", "{}") and s.count(s[0]) == 1:
            s = s[1:-1].strip()
        return s

    def split(self, text: str | None) -> list[str]:
        """The values in their order; empty slots are left out, repeated values stay."""
        if not text:
            return []
        s = self.inside(text)
        items: list[str] = []
        piece: list[str] = []

        def close() -> None:
            v = "".join(piece).strip()
            if v:
                items.append(v)
            piece.clear()

        guarded = self.protected(s) + [(len(s), len(s), "")]
        i = 0
        for a, b, value in guarded:
            run = s[i:a]
            start = 0
            for j, ch in enumerate(run):
                if ch in self.delimiters:
                    if ch == " " and self.bind and self.bind.search("".join(piece) + run[start:j]):
                        continue
                    piece.append(run[start:j])
                    close()
                    start = j + 1
            piece.append(run[start:])
            piece.append(value)
            i = b
        close()
        return items


def _class(delimiters: str) -> str:
    return "[" + re.escape(delimiters).replace("\\\t", "\\t").replace("\\\n", "\\n").replace("\\\r", "\\r") + "]"


_INSIDE = r'"([^"]*+(?:""[^"]*+)*+)"'  # a quoted stretch, without a branch for each sign


def learned_values(df: DataFrame, text: str, delimiters: str, glue: str = "") -> DataFrame:
    """value: every whole value of every row that stands in quotes, doubled quotes made single, and holds a delimiter.

    Learned from all rows, however rare a value is; one row a value, summed
    before the shuffle.
    """
    hard = _class(delimiters.replace(" ", ""))
    quoted = df.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit("(?:^|" + _class(delimiters + glue) + ")\\s*" + _INSIDE + "(?=\\s*(?:$|" + hard + "))"), 1)).alias("v"))
    return quoted.select(F.trim(F.replace("v", F.lit('""'), F.lit('"'))).alias("value")).filter(F.col("value").rlike(hard)).distinct()


#: letters of known values up to which one automaton holds them all (some 50 MB a task)
LETTERS = 1_000_000


def split_field(df: DataFrame, key: str, text: str, delimiters: str, glue: str = ":=", bind: str | None = None) -> DataFrame:
    """rec_key, pos, item: one row per value of each row's text, pos from 1.

    Null, blank and missing texts give no rows; other columns are left out, so
    none can clash.  Every text is searched for the known values of all rows by
    the automaton.  A dictionary of up to LETTERS is one automaton in every task
    and needs no shuffle.  A longer one is narrowed first: each batch's automaton
    holds the known values that its texts could hold, found by a join.
    """
    src = df.select(F.col(f"`{key}`").cast("string").alias("rec_key"), F.col(f"`{text}`").alias("t")).filter(~is_missing(F.col("t")))
    values = cut(learned_values(src, "t", delimiters, glue), "dictionary")
    size = values.agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("letters"), F.coalesce(F.max(F.length("value")), F.lit(0)).alias("most")).first()
    whole = sorted(r["value"] for r in values.collect()) if size["letters"] <= LETTERS else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(delimiters, whole or (), glue, bind)
        for pdf in batches:
            if whole is None:
                segmenter = Segmenter(delimiters, sorted({v for vs in pdf["known"] if vs is not None for v in vs}), glue, bind)
            cache = {t: segmenter.split(t) for t in pdf["t"].unique()}
            parts = [cache[t] for t in pdf["t"]]
            n = [len(p) for p in parts]
            yield pd.DataFrame({
                "rec_key": pdf["rec_key"].repeat(n).to_numpy(),
                "pos": [i for k in n for i in range(1, k + 1)],
                "item": [v for p in parts for v in p],
            })

    if whole is None:
        src = _narrowed(src, values, size["most"], delimiters, glue)
    return src.mapInPandas(run, "rec_key string, pos int, item string")


def _narrowed(src: DataFrame, values: DataFrame, most: int, delimiters: str, glue: str) -> DataFrame:
    """``src`` plus ``known``: the values, of ``most`` letters at most, that stand between two quotes of the text ``t``.

    Clear quotes hold their own stretches only; others could belong together in
    any pair.  Texts without quotes hold no value in quotes.
    """

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = Segmenter(delimiters, (), glue)
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                spans, clear = plain.quoted(plain.inside(t))
                found = {v.strip() for _, _, v in spans}
                at = [] if clear else [m.start() for m in re.finditer('"', t)]
                for x, a in enumerate(at):
                    for b in at[x + 1:]:
                        if b - a > 2 * most + 2:
                            break
                        found.add(t[a + 1: b].strip().replace('""', '"'))
                        found.add(t[a + 1: b].strip())
                rows += [(t, v) for v in found if v]
            yield pd.DataFrame(rows, columns=["t", "value"])

    quotes = F.col("t").contains('"')
    could = src.filter(quotes).select("t").distinct().mapInPandas(stretches, "t string, value string")
    known = could.join(values, "value", "left_semi").groupBy("t").agg(F.collect_set("value").alias("known"))  # at most a text's own stretches
    joined = src.filter(quotes).join(known, "t", "left").select("rec_key", "t", "known")
    return src.filter(~quotes).select("rec_key", "t", F.lit(None).cast("array<string>").alias("known")).unionByName(joined)
