"""Quantities recorded in different units: one value in one unit per row.

Three sources of the unit, in this order: the value's own text, the statement of
the source (a study's description), and the source's history, in which an exact
penalised search finds level shifts that match a known unit factor.  Where the
statement names several units, the search decides among them.
"""
from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut
from strandloom.tables import is_missing

# Seconds of each unit, and the words that name it.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
UNIT_WORDS = {
    "second": "s sec secs second seconds",
    "minute": "min mins minute minutes",
    "hour": "h hr hrs hour hours",
    "day": "d day days",
    "week": "w wk wks week weeks",
    "month": "mo mos mon month months",
}
WORD_UNIT = {w: u for u, ws in UNIT_WORDS.items() for w in ws.split()}
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORD_NUMBER = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | {"hundred": 100, "half": 0}

_UNIT_ALT = "|".join(sorted(WORD_UNIT, key=len, reverse=True))
_NUMBER = r"\d{1,3}(?:[ ,']\d{3})+(?![\d])(?:\.\d+)?|\d+,\d{1,2}(?!\d)|\d+(?:\.\d+)?|\.\d+"
_TOKEN = re.compile(rf"(?P<num>{_NUMBER})|(?P<word>[^\W\d_]+)|(?P<sign>[^\s\w]|_)")
_ISO = re.compile(r"p(?=[\dt])(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)w)?(?:(\d+(?:\.\d+)?)d)?(?:t(?=\d)(?:(\d+(?:\.\d+)?)h)?(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)s)?)?")
_ISO_UNITS = ("month", "week", "day", "hour", "minute", "second")
_BREAKS = {"to", "or", "until", "till", "bis", "through", "between", "per", "every", "than", "least", "most", "minus"}
_RANGE_SIGNS = set("-–—/<>±≥≤|−")


def _number(text: str) -> Fraction:
    text = text.replace(" ", "").replace("'", "")
    if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", text):
        text = text.replace(",", "")
    return Fraction(text.replace(",", "."))


def _words_to_digits(tokens: list[tuple[str, str]]) -> list[tuple[str, object]]:
    """Runs of number words become one number; a hyphen inside a run belongs to it."""
    out: list[tuple[str, object]] = []
    i = 0
    while i < len(tokens):
        kind, t = tokens[i]
        if kind == "word" and t in WORD_NUMBER:
            total = Fraction(0)
            while i < len(tokens):
                kind, t = tokens[i]
                if kind == "word" and t in WORD_NUMBER:
                    if t == "hundred":
                        total = (total or 1) * 100
                    elif t == "half":
                        total += Fraction(1, 2)
                    else:
                        total += WORD_NUMBER[t]
                elif kind == "sign" and t == "-" and i + 1 < len(tokens) and tokens[i + 1][1] in WORD_NUMBER:
                    pass
                else:
                    break
                i += 1
            out.append(("num", total))
            continue
        out.append((kind, _number(t) if kind == "num" else t))
        i += 1
    return out


def parse_quantity(text: object) -> tuple[Fraction | None, bool]:
    """(seconds, True) for a text that states one quantity with its unit; (number, False) for a bare number; else (None, False)."""
    value, unit = written_quantity(text)
    return value, unit is not None


def written_quantity(text: object) -> tuple[Fraction | None, str | None]:
    """(seconds, first written unit), (bare number, None), or (None, None).

    Parts in falling units are added up.  Ranges, alternatives and texts of no
    quantity give (None, None), as do nulls and empty texts.
    """
    if not isinstance(text, str):
        return None, None
    s = " ".join(unicodedata.normalize("NFKC", text).lower().split())
    s = re.sub(r"\b(day|week|hour|month|minute|second)\(s\)", r"\1s", s)
    s = re.sub(r"\{\s*([^}]*?)\s*\}", r" \1", s)
    if (m := _ISO.fullmatch(s)) and any(m.groups()):
        return sum((Fraction(v) * UNIT_SECONDS[u] for v, u in zip(m.groups(), _ISO_UNITS) if v), Fraction(0)), next(u for v, u in zip(m.groups(), _ISO_UNITS) if v)
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    raw = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(re.sub(rf"(\d)({_UNIT_ALT})\b", r"\1 \2", s))]
    tokens = _words_to_digits(raw)
    parts: list[tuple[Fraction, str | None]] = []
    lead: str | None = None
    for k, (kind, t) in enumerate(tokens):
        if kind == "num":
            unit, lead = lead, None
            parts.append((t, unit))
        elif kind == "word" and t in WORD_UNIT:
            if parts and parts[-1][1] is None and tokens[k - 1][0] == "num":
                parts[-1] = (parts[-1][0], WORD_UNIT[t])
            elif not parts and k + 1 < len(tokens) and tokens[k + 1][1] in (":", "="):
                lead = WORD_UNIT[t]
            elif parts or kind == "num":
                return None, None
        elif kind == "word" and t in _BREAKS:
            return None, None
        elif kind == "sign" and t in _RANGE_SIGNS:
            return None, None
    if not parts:
        return None, None
    if len(parts) == 1 and parts[0][1] is None:
        bare = all(kind != "word" or t in ("about", "approx", "approximately", "ca", "circa", "roughly", "around", "nominal") for kind, t in tokens)
        return (parts[0][0], None) if bare else (None, None)
    if any(u is None for _, u in parts):
        return None, None
    size = [UNIT_SECONDS[u] for _, u in parts]  # type: ignore[index]
    if any(a <= b for a, b in zip(size, size[1:])):
        return None, None
    return sum((v * n for (v, _), n in zip(parts, size)), Fraction(0)), parts[0][1]


_ABOUT = re.compile(r"\b(durations?|length of stay|time on study|exposure times?|time (?:in|of) flight|days? on orbit column)\b")


_LISTED = re.compile(r"\s*(?:/|,?\s*(?:and|or)\b|,\s*(?=in\b))(?:\s*in\b)?\s*")
_LATER = re.compile(r"\b(?:then|later|until|till|since|afterwards|thereafter)\b")


def stated_units(text: object) -> list[str]:
    """The units a free description states for durations, the one nearest to their mention first.

    Only sentences about durations count, the first that names a unit; a unit
    right after a number is an amount, and a unit after "not" is denied.  Further
    units of the sentence count if they are listed with the first or said to
    follow it in time.
    """
    if not isinstance(text, str):
        return []
    for sentence in re.split(r"(?<=[.;!?])\s+|\n+", unicodedata.normalize("NFKC", text).lower()):
        m = _ABOUT.search(sentence)
        if not m:
            continue
        spots = [(u.start() < m.start(), u.start(), WORD_UNIT[u.group()]) for u in re.finditer(rf"\b(?:{_UNIT_ALT})\b", sentence)
                 if not re.search(r"(\bnot(?: in)?|\d|\bper|\ba)\s*$", sentence[: u.start()])]
        if spots:
            _, begin, unit = min(spots)
            out, maybe, end = [unit], [], None
            for u in re.finditer(rf"\b(?:{_UNIT_ALT})\b", sentence[begin:]):
                between = sentence[begin + end: begin + u.start()] if end is not None else None
                if any(at == begin + u.start() for _, at, _ in spots):
                    if between is not None and (_LISTED.fullmatch(between) or _LATER.search(between)):
                        out += [*maybe, WORD_UNIT[u.group()]]
                        maybe = []
                    elif between is not None and between.strip() == ",":  # counts if the list goes on to an "and" or "or"
                        maybe.append(WORD_UNIT[u.group()])
                    elif between is not None:
                        break
                    end = u.end()
            return list(dict.fromkeys(out))
    return []


def stated_unit(text: object) -> str | None:
    """The first of :func:`stated_units`, or None."""
    return next(iter(stated_units(text)), None)


def _parse_batch(texts: pd.Series) -> pd.DataFrame:
    found = {t: written_quantity(t) for t in texts.dropna().unique()}
    num, den, units = [], [], []
    for t in texts:
        v, unit = found.get(t, (None, None)) if isinstance(t, str) else (None, None)
        if v is not None and unit:
            v = v / UNIT_SECONDS[unit]  # in the unit that is written first
        ok = v is not None and v.numerator < 2**53 and v.denominator < 2**53
        num.append(v.numerator if ok else None)
        den.append(v.denominator if ok else None)
        units.append(unit if ok else None)
    return pd.DataFrame({"num": pd.array(num, "Int64"), "den": pd.array(den, "Int64"), "unit": pd.Series(units, dtype=object)})


def _stated_batch(texts: pd.Series) -> pd.Series:
    found = {t: stated_units(t) for t in texts.dropna().unique()}
    return pd.Series([found.get(t) for t in texts], dtype=object)


def with_quantities(df: DataFrame, value: str, source: str, descriptions: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` plus ``q_num, q_den`` (the number, exact), ``q_units`` (the units it can be given in), ``q_unit`` (the only one of them),
    ``q_unit_from`` (text, statement or null), ``q_seconds_num, q_seconds_den`` (exact) and ``q_number`` (a bare number).

    Null, missing and unreadable values give nulls; a bare number without a
    statement has no unit.  ``descriptions`` may lack a source or hold it twice.
    Where they state several units, ``q_units`` holds them all, ``q_unit`` and
    the seconds are null, and :func:`unit_history` decides.
    """
    clean = df.withColumn("q_text", F.when(~is_missing(F.col(f"`{value}`")), F.col(f"`{value}`")))
    parsed = clean.withColumn("q_parse", F.pandas_udf(_parse_batch, "num long, den long, unit string")("q_text"))
    units = (
        descriptions.select(F.col(f"`{key}`").alias("q_source"), F.explode(F.pandas_udf(_stated_batch, "array<string>")(F.col(f"`{text}`"))).alias("q_stated"))
        .filter(F.col("q_source").isNotNull())
        .groupBy("q_source").agg(F.sort_array(F.collect_set("q_stated")).alias("q_stated"))  # six at most
    )
    joined = parsed.join(units, F.col(f"`{source}`") == F.col("q_source"), "left")
    seconds = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    only = F.when(F.size("q_stated") == 1, F.col("q_stated")[0])
    own, stated = F.coalesce(F.col("q_parse.unit").isNotNull(), F.lit(False)), F.col("q_stated").isNotNull() & F.col("q_parse.num").isNotNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("q_parse.num").alias("q_num"), F.col("q_parse.den").alias("q_den"),
        F.when(own, F.array("q_parse.unit")).when(stated, F.col("q_stated")).alias("q_units"),
        F.when(own, F.col("q_parse.unit")).when(stated, only).alias("q_unit"),
        (F.col("q_parse.num") * F.try_element_at(seconds, F.when(own, F.col("q_parse.unit")).when(stated, only))).alias("q_seconds_num"),
        F.when(own | (stated & only.isNotNull()), F.col("q_parse.den")).alias("q_seconds_den"),
        F.when(~own & F.col("q_parse.num").isNotNull(), F.col("q_parse.num") / F.col("q_parse.den")).alias("q_number"),
        F.when(own, F.lit("text")).when(stated, F.lit("statement")).alias("q_unit_from"),
    )


# ---- exact penalised segmentation of histories -----------------------------

STATES = tuple(UNIT_SECONDS)
#: stands for an impossible reading, and yet keeps sums finite
TOLD = 1e12
LOG_HOURS = np.log(np.array([UNIT_SECONDS[u] / 3600 for u in STATES]))


def _costs(logv: np.ndarray, mu: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of a value read in each unit from its source's level, capped so that one odd value is no reason for a segment.

    ``fixed`` has one bit for each unit that is told (by the text or a
    statement), 0 if none is.  An observation cannot be read in a unit that is
    not told, and costs nothing in one that is told alone.
    """
    out = np.minimum((logv[:, None] + LOG_HOURS[None, :] - mu[:, None]) ** 2 / 2, 6.0)
    if fixed is None:
        return out
    told = (fixed[:, None] >> np.arange(len(STATES))[None, :]) & 1 > 0
    out = np.where(told.sum(1, keepdims=True) == 1, 0.0, out)
    return np.where(told | (fixed[:, None] == 0), out, TOLD)


def _group_costs(g: pd.DataFrame, number: str, level: str) -> np.ndarray:
    x = g[number].to_numpy(float)
    cost = _costs(np.log(np.where(x > 0, x, 1.0)), g[level].to_numpy(float), g["_told"].to_numpy(np.int64))
    return np.where((x > 0)[:, None] | (cost >= TOLD), cost, 0.0)  # nothing is the same in every unit


def _transfer(cost: np.ndarray, penalty: float) -> np.ndarray:
    """(min,+) product over a run: the cheapest way from each unit before it to each unit at its end."""
    k = len(STATES)
    t = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    for c in cost:
        t = np.minimum(t, t.min(1, keepdims=True) + penalty) + c[None, :]
    return t


def _viterbi(cost: np.ndarray, penalty: float, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    best, back = start.copy(), np.empty(cost.shape, np.int8)
    for i, c in enumerate(cost):
        j = int(best.argmin())
        stay = best <= best[j] + penalty
        back[i] = np.where(stay, np.arange(len(best)), j)
        best = np.where(stay, best, best[j] + penalty) + c
    path = np.empty(len(cost), np.int8)
    s = int((best + end).argmin())
    for i in range(len(cost) - 1, -1, -1):
        path[i] = s
        s = back[i, s]
    return path


def unit_history(df: DataFrame, source: str, order: list[str], number: str, level: str, fixed: str | None = None, penalty: float = 6.0) -> DataFrame:
    """``df`` plus ``unit``, the unit of each number by its source's history, and ``part``, the sorted range it lies in.

    Where ``fixed`` names a unit, the history runs through it; where it holds an
    array of units, through one of them.  A null source is a history of its own.

    ``level`` holds the log of the hours usual for the source.  The segmentation
    minimises squared distance plus ``penalty`` per change over all paths, hence
    is exact.  Because a shift counts only when it matches a known factor, the
    search runs over a handful of units, and its steps combine in any grouping:
    histories are cut into sorted ranges, each range is summed up in one small
    matrix, the matrices are chained, and the ranges are traced back on their
    own.  A source that holds most rows is thus never in one task.  Rows with a
    null number, or one that is not positive and has no fixed unit, are left out.
    Empty input gives no rows.
    """
    spark = df.sparkSession
    bits = F.create_map(*[F.lit(x) for i, u in enumerate(STATES) for x in (u, 1 << i)])
    bit = lambda u: F.coalesce(F.try_element_at(bits, u), F.lit(0))
    told = F.lit(0)
    if fixed:
        listed = df.schema[fixed].dataType.typeName() == "array"
        told = F.aggregate(F.array_distinct(F.coalesce(F.col(fixed), F.array().cast("array<string>"))), F.lit(0), lambda a, u: a + bit(u)) if listed else bit(F.col(fixed))
    keep = df.withColumn("_told", told).filter(F.col(number).isNotNull() & ((F.col(number) > 0) | (F.col("_told") > 0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep.repartitionByRange(n, F.col(source), *[F.col(o) for o in order]).sortWithinPartitions(source, *order)
    base = cut(ranged.withColumn("part", F.spark_partition_id()), "history")
    src, srt = source, [source, *order]

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(srt, kind="stable", na_position="first")
        rows = []
        for s in dict.fromkeys((pdf[src].iloc[0], pdf[src].iloc[-1])):  # only these can go on in another range
            g = pdf[pdf[src].isna()] if s is None else pdf[pdf[src] == s]
            t = _transfer(_group_costs(g, number, level), penalty)
            rows.append((int(pdf["part"].iloc[0]), s, t.ravel().tolist()))
        return pd.DataFrame(rows, columns=["part", "s", "t"])

    kind = df.schema[source].dataType.simpleString()
    # At most two rows a range, so the driver's share is bounded by the number of partitions.
    edges = base.groupBy("part").applyInPandas(summed, f"part int, s {kind}, t array<double>").toPandas()
    k = len(STATES)
    chain: dict[tuple[int, object], tuple[np.ndarray, np.ndarray]] = {}
    for s, g in edges.groupby("s", sort=False, dropna=False):
        s = None if pd.isna(s) else s
        g = g.sort_values("part")
        mats = [np.array(t, float).reshape(k, k) for t in g["t"]]
        fore, vec = [], np.zeros(k)
        for m in mats:
            fore.append(vec)
            vec = (vec[:, None] + m).min(0)
        vec = np.zeros(k)
        for p, m, f in reversed(list(zip(g["part"], mats, fore))):
            chain[(int(p), s)] = (f, vec)
            into = (m + vec[None, :]).min(1)
            vec = into
    flat = {key: (a.tolist(), b.tolist()) for key, (a, b) in chain.items()}

    def traced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(srt, kind="stable", na_position="first")
        out = np.empty(len(pdf), object)
        p, at = int(pdf["part"].iloc[0]), 0
        for s, g in pdf.groupby(src, sort=False, dropna=False):
            s = None if pd.isna(s) else s
            f, e = flat.get((p, s), ([0.0] * k, [0.0] * k))
            path = _viterbi(_group_costs(g, number, level), penalty, np.array(f), np.array(e))
            out[at: at + len(g)] = [STATES[i] for i in path]
            at += len(g)
        return pdf.drop(columns="_told").assign(unit=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "_told")
    return base.groupBy("part").applyInPandas(traced, f"{fields}, unit string")


def source_levels(df: DataFrame, source: str, hours: str) -> DataFrame:
    """source, level: mean log of the hours that rows of the source state in so many words, else of all rows."""
    some = df.filter(F.col(hours) > 0).select(F.col(source).alias("lv_source"), F.log(F.col(hours)).alias("x"))
    per = some.groupBy("lv_source").agg(F.avg("x").alias("lv"))
    return per


def unit_changes(history: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Runs of one unit in a source's :func:`unit_history`: source, run, unit, factor to hours, first and last row, and their number.

    Runs are found inside each sorted range; only the first and last run of a
    range, which may go on in another, meet on the driver.  Null sources are left
    out.
    """
    spark = history.sparkSession
    srt, last = [source, *order], order[-1]
    types = {f.name: f.dataType.simpleString() for f in history.schema.fields}

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(srt, kind="stable").reset_index(drop=True)
        new = ((pdf[source] != pdf[source].shift()) | (pdf["unit"] != pdf["unit"].shift())).to_numpy()
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(pdf))
        edge = np.zeros(len(begin), bool)
        edge[[0, -1]] = True
        return pd.DataFrame({
            "part": pdf["part"].iloc[0], "place": np.arange(len(begin)), "edge": edge, source: pdf[source].to_numpy()[begin], "unit": pdf["unit"].to_numpy()[begin],
            "first_row": pdf[last].to_numpy()[begin], "last_row": pdf[last].to_numpy()[end - 1], "n_rows": end - begin,
        })

    shape = f"part int, place long, edge boolean, `{source}` {types[source]}, unit string, first_row {types[last]}, last_row {types[last]}, n_rows long"
    runs = cut(history.filter(F.col(source).isNotNull()).groupBy("part").applyInPandas(local, shape), "runs")
    ends = [r.asDict() for r in runs.filter("edge").orderBy("part", "place").collect()]  # two a range at most
    whole: list[dict] = []
    for r in ends:
        p = whole[-1] if whole else None
        if p and (p[source], p["unit"]) == (r[source], r["unit"]) and p["open"] and r["place"] == 0 and r["part"] != p["part"]:
            p.update(last_row=r["last_row"], n_rows=p["n_rows"] + r["n_rows"])
            # a range that is one run goes on into the next
            p["part"] = r["part"]
        else:
            whole.append(r)
        whole[-1]["open"] = True
    joined = spark.createDataFrame([tuple(r[c] for c in runs.columns) for r in whole], runs.schema)
    every = runs.filter("not edge").unionByName(joined)
    hours = F.create_map(*[F.lit(x) for u in STATES for x in (u, UNIT_SECONDS[u] / 3600)])
    w = Window.partitionBy(source).orderBy("part", "place")  # over runs, not rows
    return every.select(F.col(source), (F.row_number().over(w) - 1).cast("long").alias("run"), "unit", F.try_element_at(hours, "unit").alias("factor"), "first_row", "last_row", "n_rows")
