"""Batched lookups at a service: ids in ranges, a request a batch, retries with growing waits.

The service is a function given by the caller, so that tests and closed networks
use a fixture; nothing here opens a connection itself.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(ids: DataFrame, ident: str, fetch: Callable[[list[str]], dict[str, dict]], fields: list[str], batch: int = 25_000, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """id and ``fields`` for every id the service knows; each id is asked for once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []

        def ask(part: list[str]) -> pd.DataFrame:
            for turn in range(retries):
                try:
                    found = fetch(part)
                    break
                except Exception:
                    if turn + 1 == retries:
                        raise
                    time.sleep(wait * 2**turn)
            return pd.DataFrame([[i, *[str(found[i].get(f, "")) for f in fields]] for i in part if i in found], columns=["id", *fields])

        for pdf in batches:
            held.extend(pdf["id"])
            while len(held) >= batch:
                yield ask(held[:batch])
                held = held[batch:]
        if held:
            yield ask(held)

    once = ids.select(F.col(ident).cast("string").alias("id")).filter("id is not null").distinct().repartitionByRange("id")
    return once.mapInPandas(run, "id string, " + ", ".join(f"{f} string" for f in fields))


def check_hit_rate(asked: DataFrame, found: DataFrame, least: float = 0.5) -> float:
    """Share of the ids that were found; too small a share stops the build."""
    n = asked.distinct().count()
    rate = found.count() / n if n else 1.0
    if rate < least:
        raise RuntimeError(f"only {rate:.1%} of {n} ids were found")
    return rate


class TooMany(Exception):
    """The service asks to slow down."""


def patient(ask: Callable, *args, tries: int = 5, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """``ask(*args)``, with waits that double after each :class:`TooMany`; other errors go through."""
    for turn in range(tries):
        try:
            return ask(*args)
        except TooMany:
            if turn + 1 == tries:
                raise
            sleep(wait * 2**turn)


def series_record(ident: str, search: Callable, summary: Callable, paper: Callable, soft: Callable, pace: float = 0.12, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """What is known of a series: search gives a uid, its summary the title and paper ids, the first paper its title and abstract, the SOFT text summary and design.

    A step that knows nothing leaves its fields blank; a later source fills what an earlier one left.
    """
    out = dict.fromkeys(("title", "geo_summary", "geo_design", "pubmed_ids", "pubmed_title", "pubmed_abstract"), "")
    uids = patient(search, ident, sleep=sleep) or []
    if uids:
        sleep(pace)
        found = patient(summary, uids[0], sleep=sleep) or {}
        out |= {"title": found.get("title", ""), "geo_summary": found.get("summary", ""), "pubmed_ids": ";".join(str(p) for p in found.get("pubmedids", []) if str(p).strip())}
        if out["pubmed_ids"]:
            sleep(pace)
            first = patient(paper, out["pubmed_ids"].split(";")[0], sleep=sleep) or {}
            out |= {"pubmed_title": first.get("title", ""), "pubmed_abstract": first.get("abstract", "")}
    sleep(pace)
    text = patient(soft, ident, sleep=sleep) or ""
    tagged = lambda tag: " ".join(x.split("=", 1)[1].strip() for x in text.splitlines() if x.startswith(tag) and "=" in x)
    out["geo_summary"] = tagged("!Series_summary") or out["geo_summary"]
    out["geo_design"] = tagged("!Series_overall_design")
    return out


def enrich(hits: DataFrame, ident: str, search: Callable, summary: Callable, paper: Callable, soft: Callable, pace: float = 0.12) -> DataFrame:
    """id and the fields of :func:`series_record`; each series is asked for once, however many hits name it."""
    fields = ["title", "geo_summary", "geo_design", "pubmed_ids", "pubmed_title", "pubmed_abstract"]

    def fetch(part: list[str]) -> dict[str, dict]:
        return {i: series_record(i, search, summary, paper, soft, pace) for i in part}

    return lookup(hits.filter(F.trim(F.col(ident)) != ""), ident, fetch, fields, batch=100)


def download(fetch: Callable[[int], Iterator[bytes]], path: str, size: int) -> int:
    """Fill ``path`` up to ``size`` bytes, going on where an earlier try stopped; ``fetch(start)`` gives the bytes from there.

    Returns how many bytes were fetched now.  A file that ends up with another size raises and stays as ``.part``.
    """
    import os

    part = path + ".part"
    if os.path.exists(path) and os.path.getsize(path) == size:
        return 0
    have = os.path.getsize(part) if os.path.exists(part) else 0
    if have > size:
        have = 0
    got = 0
    with open(part, "r+b" if have else "wb") as f:
        f.seek(have)
        for block in fetch(have) if have < size else ():
            f.write(block)
            got += len(block)
        f.truncate()
    if os.path.getsize(part) != size:
        raise OSError(f"{path}: {os.path.getsize(part)} of {size} bytes")
    os.replace(part, path)
    return got
