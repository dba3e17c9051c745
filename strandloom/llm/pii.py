"""Personal information in free text: a skip-chain conditional random field.

Every token of every text (see :mod:`strandloom.llm.pii_tokens`) gets a label; a
form is a feature and excludes no label.  Neighbours share potentials along the
chain, and each word shares one with the same word before it in the text,
however far away.  Loopy messages pass along chains and skips in turn.  All
potentials, those of the skips included, are learned together by
:mod:`strandloom.llm.pii_training`.

A token whose own score favours "nothing" by more than all potentials around it
could ever change is settled beforehand; that bound is exact, so chains fall
apart into short runs without any change of the most probable labels.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.pii_tokens import CLASSES, VOCABULARY, Tokens, tokenize
from strandloom.session import spread

LABELS = ("O", "name", "email", "phone", "idnum", "address")
KIND = {k: i for i, k in enumerate(LABELS)}
PLACEHOLDER = {k: f"[{k.upper()}]" for k in LABELS[1:]}
#: kinds of skips: words no vocabulary has in lower case, other words, numbers
SKIPS = 3
ROUNDS = 2
#: log-odds beyond the bound at which a token is settled
SETTLED = 3.0
#: log-odds against the begin of a piece: running text holds far fewer pieces than training texts do
SPARSE = 1.0
#: characters of a batch, so that memory does not follow the length of the texts' sum
BATCH = 400_000


class Field(NamedTuple):
    """Potentials: by feature, between neighbours, and by kind of skip."""

    unary: np.ndarray  # (1 << BITS, labels)
    pair: np.ndarray
    skip: np.ndarray  # (SKIPS, labels, labels)


def scores(field: Field, feats: np.ndarray) -> np.ndarray:
    """Each token's own score of each label."""
    out = np.zeros((feats.shape[1], len(LABELS)), np.float32)
    one = np.empty_like(out)
    for row in feats:
        np.take(field.unary, row, axis=0, out=one, mode="clip")
        out += one
    return out


def skip_kind(t: Tokens, at: np.ndarray) -> np.ndarray:
    return np.where(t.group[at] == 2, 2, (t.code[at] % np.uint64(4) != 0).astype(int))


def chain(u: np.ndarray, pair: np.ndarray, open_start: np.ndarray, open_end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, backward, potentials) of runs (run, place, label), each between two tokens of label O where not open; padding comes last."""
    e = np.exp(u - u.max(2, keepdims=True))
    a = np.exp(pair - pair.max())
    n, t, k = e.shape
    fore, back = np.empty_like(e), np.empty_like(e)
    one = np.ones(k, e.dtype)
    x = np.where(open_start[:, None], one, a[0]) * e[:, 0]
    fore[:, 0] = x / x.sum(1, keepdims=True)
    for i in range(1, t):
        x = (fore[:, i - 1] @ a) * e[:, i]
        fore[:, i] = x / x.sum(1, keepdims=True)
    stop = np.where(open_end[:, None], one, a[:, 0])
    last = size - 1
    back[:, t - 1] = stop
    for i in range(t - 2, -1, -1):
        x = (back[:, i + 1] * e[:, i + 1]) @ a.T
        x /= x.sum(1, keepdims=True)
        back[:, i] = np.where((i >= last)[:, None], stop, x)
    node = fore * back
    return node / node.sum(2, keepdims=True), fore, back, e


def messages(belief: np.ndarray, left: np.ndarray, right: np.ndarray, table: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New log messages over skips from ``left`` to ``right`` tokens and back, from beliefs without what the other end said before."""
    out = np.clip(belief[left] * np.exp(-behind), 1e-30, None)
    back = np.clip(belief[right] * np.exp(-ahead), 1e-30, None)
    a = np.einsum("nk,nkl->nl", out / out.sum(1, keepdims=True), table)
    b = np.einsum("nl,nkl->nk", back / back.sum(1, keepdims=True), table)
    a, b = np.log(a), np.log(b)
    return a - a[:, :1], b - b[:, :1]


def could_differ(field: Field, u: np.ndarray, bound: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Tokens that some run of other labels than O around them could win, by SETTLED or less short of it.

    A run between two O gains its tokens' scores over O, a transition inside for
    each further token, and the way in and out; skips add what they can at most.
    The best run through each token follows from running sums and their running
    minima, from both sides.
    """
    pair, none = field.pair, field.pair[0, 0]
    inside = pair[1:, 1:].max() - none
    around = pair[0, 1:].max() + pair[1:, 0].max() - 2 * none - inside
    told = (field.skip - field.skip[:, :, :1]).max((0, 1)) + (field.skip - field.skip[:, :1]).max((0, 2))
    v = u[:, 1].astype(np.float64)
    for c in range(2, u.shape[1]):
        np.maximum(v, u[:, c], out=v)
    v += inside - u[:, 0]
    v[linked] += max(0.0, float(told.max()))
    v[bound] = -1e6

    def reach(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))

    return ~bound & (reach(v) + reach(v[::-1])[::-1] - v + around > -SETTLED)


def label(field: Field, t: Tokens, use_skips: bool = True) -> np.ndarray:
    """The most probable label of each token after loopy messages."""
    m, k = len(t.start), len(LABELS)
    lab = np.zeros(m, np.int8)
    if not m:
        return lab
    start = field.pair.copy()
    start[0, 1:] -= SPARSE
    field = Field(field.unary, start, field.skip)
    u = scores(field, t.feats)
    linked = np.zeros(m, bool)
    right = np.flatnonzero(t.skip >= 0)
    left = t.skip[right]
    if use_skips:
        linked[left] = linked[right] = True
    at = np.flatnonzero(could_differ(field, u, t.bound, linked))
    if not len(at):
        return lab
    open_ = np.zeros(m, bool)
    open_[at] = True
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    size = np.diff(np.append(starts, len(at)))
    packs = []
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        width = size[order[a]]
        b = min(len(order), a + 4096, int(np.searchsorted(size[order], width * 1.3 + 2, side="right")))
        rows = order[a:b]
        a = b
        longest = int(size[rows].max())
        place = starts[rows][:, None] + np.arange(longest)[None, :]
        real = np.arange(longest)[None, :] < size[rows][:, None]
        packs.append((at[np.where(real, place, starts[rows][:, None])], real, size[rows]))
    belief = np.zeros((m, k), np.float32)
    belief[:, 0] = 1.0

    def pass_chains(extra: np.ndarray | None, those: list) -> None:
        for idx, real, sizes in those:
            x = u[idx] if extra is None else u[idx] + extra[idx]
            x = np.where(real[:, :, None], x, 0.0)
            shut = np.zeros(len(idx), bool)
            node = chain(x, field.pair.astype(np.float32), shut, shut, sizes)[0]
            belief[idx[real]] = node[real]

    pass_chains(None, packs)
    useful = open_[left] | open_[right]
    left, right = left[useful], right[useful]
    if use_skips and len(left):
        # only runs with a skip can change
        some = [(idx[r], real[r], sizes[r]) for idx, real, sizes in packs if len(r := np.flatnonzero((linked[idx] & real).any(1)))]
        table = np.exp(field.skip[skip_kind(t, right)]).astype(np.float32)
        ahead, behind = np.zeros((len(left), k), np.float32), np.zeros((len(left), k), np.float32)
        for _ in range(ROUNDS):
            ahead, behind = messages(belief, left, right, table, ahead, behind)
            extra = np.zeros((m, k), np.float32)
            np.add.at(extra, right, ahead)
            np.add.at(extra, left, behind)
            pass_chains(extra, some)
    lab[at] = belief[at].argmax(1)
    return lab


#: letters and digits that a piece of each kind must have at least
LEAST = {"name": (2, 0), "email": (3, 0), "phone": (0, 6), "idnum": (0, 5), "address": (2, 1)}
#: signs over which a piece of a kind reaches to the end of its unbroken run
WITHIN = {"email": "._+-@", "phone": "-./+()", "idnum": "-"}
AT = list(CLASSES).index("at") + 1


def spans(field: Field, texts: list[str], vocabulary: str = VOCABULARY, use_skips: bool = True) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal information in each text, from left to right."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not texts:
        return found
    _, at, t = tokenize(texts, vocabulary)
    lab = label(field, t, use_skips)
    for a, b, d, k in pieces(t, lab):
        found[d].append((int(a - at[d]), int(b - at[d]), LABELS[k]))
    return found


def pieces(t: Tokens, lab: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, text, label) of runs of one label.

    A piece never ends inside an unbroken run of signs of its kind, and has no
    loose signs at its ends; e-mails hold an at-sign in some form, and numbers
    enough digits.
    """
    on = np.flatnonzero(lab)
    if not len(on):
        return []
    lab = lab.copy()
    group, start, end, sign = t.group, t.start, t.end, t.form - 24
    mail = {ord(c) for c in WITHIN["email"]}
    for i in np.flatnonzero((lab == KIND["email"]) & (group == 4) & (sign == 64)).tolist():
        # an address runs as far as its signs do, whatever its parts look like by themselves
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lab) and (end[j] == start[j + 1] if step < 0 else start[j] == end[j - 1]) and (group[j] < 3 or group[j] == 4 and int(sign[j]) in mail):
                lab[j] = KIND["email"]
                j += step
    for i in np.flatnonzero((lab == KIND["email"]) & (t.code // np.uint64(16) == AT)).tolist():
        # before a spelled at-sign stands the local part
        j = i - 1
        if j > 0 and lab[j] != KIND["email"] and group[j] < 3:
            lab[j] = KIND["email"]
            while end[j - 1] == start[j] and (group[j - 1] < 3 or group[j - 1] == 4 and int(sign[j - 1]) in mail):
                j -= 1
                lab[j] = KIND["email"]
    on = np.flatnonzero(lab)
    new = np.concatenate([[True], (np.diff(on) > 1) | (lab[on[1:]] != lab[on[:-1]])])
    firsts, lasts = on[new], on[np.append(new[1:], True)] + 1
    out, done = [], 0
    for i, j in zip(firsts.tolist(), lasts.tolist()):
        k = int(lab[i])
        kind = LABELS[k]
        if j <= done:
            continue  # taken in by the piece before
        within = {ord(c) for c in WITHIN.get(kind, "")}
        if within:
            while j < len(group) and start[j] == end[j - 1] and (group[j] < 3 or group[j] == 4 and int(sign[j]) in within):
                j += 1
            while i > done and end[i - 1] == start[i] and (group[i - 1] < 3 or group[i - 1] == 4 and int(sign[i - 1]) in within):
                i -= 1
        done = j
        opening = (43, 40) if kind == "phone" else ()  # a phone number may begin with + or (
        while i < j and group[i] > 2 and int(sign[i]) not in opening:
            i += 1
        # the dot of a shortened street belongs to it
        dot = kind == "address" and j - i > 1 and sign[j - 1] == 46 and end[j - 2] == start[j - 1] and group[j - 2] == 1 and end[j - 2] - start[j - 2] < 5
        while j > i and group[j - 1] > 2 and not dot:
            j -= 1
        size = end[i:j] - start[i:j]
        if i == j or size[group[i:j] == 1].sum() < LEAST[kind][0] or size[group[i:j] == 2].sum() < LEAST[kind][1]:
            continue
        if kind == "email" and not ((sign[i:j] == 64) | (t.code[i:j] // np.uint64(16) == AT)).any():
            continue
        out.append((int(start[i]), int(end[j - 1]), int(t.doc[i]), k))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], PLACEHOLDER[k]]
            at = b
    return "".join(out) + text[at:]


# ---- over tables -----------------------------------------------------------------


def _run(field: Field, what: str, vocabulary: str):
    on = np.flatnonzero(field.unary.any(1))
    small, size_of, pair, skip = field.unary[on].astype(np.float16), field.unary.shape, field.pair, field.skip  # a table of every bucket would travel in vain

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unary = np.zeros(size_of, np.float32)
        unary[on] = small
        own = Field(unary, pair, skip)
        for pdf in batches:
            size = np.cumsum(pdf["t"].str.len().to_numpy()) // BATCH
            for _, part in pdf.groupby(size, sort=True):
                texts = part["t"].tolist()
                found = spans(own, texts, vocabulary)
                if what == "spans":
                    rows = [(i, k, t[a:b]) for i, t, f in zip(part["doc_id"], texts, found) for a, b, k in f]
                    yield pd.DataFrame(rows, columns=["doc_id", "kind", "found_text"])
                else:
                    yield pd.DataFrame({"doc_id": part["doc_id"], "text": [redact(t, f) for t, f in zip(texts, found)], "n_found": [len(f) for f in found]})

    return run


def _source(df: DataFrame, ident: str, text: str) -> DataFrame:
    return spread(df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("t")).filter("doc_id is not null and t is not null"))


def find(df: DataFrame, ident: str, text: str, field: Field, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, kind, found_text of all personal information; null and empty texts give no rows, repeated pieces come once each time."""
    return _source(df, ident, text).mapInPandas(_run(field, "spans", vocabulary), "doc_id long, kind string, found_text string")


def redacted(df: DataFrame, ident: str, text: str, field: Field, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, n_found: each text with a typed placeholder in place of each piece.  Null texts are left out, empty ones stay."""
    return _source(df, ident, text).mapInPandas(_run(field, "redacted", vocabulary), "doc_id long, text string, n_found int")
