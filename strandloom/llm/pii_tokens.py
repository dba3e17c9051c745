"""Tokens of free text and their features, made for a whole batch of texts at once.

Texts are laid end to end as one array of code points.  A token is a run of
letters, a run of digits, a run of line ends, or one other sign; nothing in a
text is left out but blanks.  Features are hashes of words, of forms (letter
case, digits by their number, the sign itself) and of windows of forms, so that
every place of every text is described without a loop over tokens.
"""
from __future__ import annotations

import base64
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BITS = 19
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken,/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BOUND = "\x1e"  # stands between texts
GAP = 8  # so often, that no window reaches from one text to another

# Words whose kind matters more than they do.
CLASSES = {
    "street": "street st road rd avenue ave lane ln drive dr court ct close mews boulevard blvd terrace way crescent square grove hill walk row gardens parade place park view quay yard straße strasse str weg allee ring gasse platz damm ufer steig chaussee",
    "rue": "rue quai avenue boulevard chemin allée allee impasse cours route passage place square via calle",
    "of": "de du des la le les van von der den zu zum zur di da del am im",
    "at": "at", "dot": "dot punkt point", "house": "bis ter",
    "title": "mr mrs ms miss dr prof professor herr herrn frau mme mlle madame monsieur sir dame dipl ing",
}
SPACE, LINE, LOWER, UPPER, DIGIT, SIGN = range(6)
GROUP = np.array([0, 3, 1, 1, 2, 4], np.uint8)
MULT = np.uint64(0x9E3779B97F4A7C15)


class Chars(NamedTuple):
    kind: np.ndarray
    low: np.ndarray


@lru_cache(1)
def chars() -> Chars:
    """Kind and lower case of every sign of the basic plane; signs beyond it stand for themselves."""
    kind, low = np.full(1 << 16, SIGN, np.uint8), np.arange(1 << 16, dtype=np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if c in "\n\r \x0b\x0c":
            kind[i] = LINE
        elif c.isspace():
            kind[i] = SPACE
        elif c.isalpha():
            kind[i] = UPPER if c.isupper() or c.istitle() else LOWER
            s = c.lower()
            low[i] = ord(s) if len(s) == 1 else i
        elif c.isdigit():
            kind[i] = DIGIT
    return Chars(kind, low)


_POW = np.uint64(0x5851F42D4C957F2D)
_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def word_hash(word: str) -> int:
    """The hash that :func:`tokenize` gives a lower-case word."""
    h, p = 0, 1
    for c in word:
        h = (h + (ord(c) + 1) * p) & (1 << 64) - 1
        p = p * int(_POW) & (1 << 64) - 1
    return h * int(MULT) & (1 << 64) - 1


@lru_cache(4)
def lexicon(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, hashes, codes): how common a word is in lower case and with a capital, by its rank in public vocabularies; and its class.

    ``vocabulary`` names files parted by commas.  code = lower bucket (0 none, 1 most common to 3) + 4 * capital bucket (0 to 2) + 16 * class.
    """
    low: dict[str, int] = {}
    cap: dict[str, int] = {}
    for path in vocabulary.split(","):
        with open(path, "rb") as f:
            for line in f:
                a, b = line.split()
                try:
                    w = base64.b64decode(a).decode()
                except UnicodeDecodeError:
                    continue
                if len(w) > 2 and w[0] == " " and w[1:].isalpha():
                    w, rank = w[1:], int(b)
                    if w.islower():
                        low[w] = min(rank, low.get(w, rank))
                    elif w[0].isupper() and w[1:].islower():
                        cap[w.lower()] = min(rank, cap.get(w.lower(), rank))
    bucket = lambda r: 0 if r is None else 1 if r < 4000 else 2 if r < 15000 else 3
    code = {w: bucket(low.get(w)) + 4 * (0 if w not in cap else 1 if cap[w] < 15000 else 2) for w in low.keys() | cap.keys()}
    for i, ws in enumerate(CLASSES.values(), 1):
        for w in ws.split():
            code[w] = code.get(w, 0) % 16 + 16 * i
    order = sorted(code, key=lambda w: (code[w] < 16, low.get(w, 1 << 20)), reverse=True)  # the most telling is written last
    hashes = np.array([word_hash(w) for w in order], np.uint64)
    slots = np.full(1 << 20, -1, np.int32)
    slots[(hashes >> np.uint64(44)).astype(np.int64)] = np.arange(len(order))
    return slots, hashes, np.array([code[w] for w in order], np.uint8)


def dictionary(vocabulary: str) -> list[str]:
    """Lower-case words of the vocabulary files, for training."""
    out = set()
    for path in vocabulary.split(","):
        with open(path, "rb") as f:
            for line in f:
                try:
                    w = base64.b64decode(line.split()[0]).decode()
                except UnicodeDecodeError:
                    continue
                if len(w) > 3 and w[0] == " " and w[1:].isalpha() and w.islower():
                    out.add(w[1:])
    return sorted(out)


class Tokens(NamedTuple):
    """Columns of a batch's tokens; places are those of the joined text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    group: np.ndarray  # 1 letters, 2 digits, 3 line ends, 4 a sign
    word: np.ndarray  # hash of the lower-case token
    form: np.ndarray
    code: np.ndarray  # of the lexicon
    feats: np.ndarray  # (feature, token) numbers below 1 << BITS
    bound: np.ndarray  # stands between texts
    skip: np.ndarray  # token the same word stood at before in the text, or -1


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    return (((x + np.uint64(zlib.crc32(b"%d" % salt))) * MULT) >> np.uint64(64 - BITS)).astype(np.int32)


def tokenize(texts: list[str], vocabulary: str = VOCABULARY) -> tuple[str, np.ndarray, Tokens]:
    """(joined text, place of each text in it, tokens with their features)."""
    wall = BOUND * GAP
    texts = [t.replace(BOUND, " ") if BOUND in t else t for t in texts]
    joined = wall + wall.join(texts) + wall
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    at = np.cumsum([GAP] + [len(t) + GAP for t in texts])[:-1]
    table = chars()
    wide = cp >= 1 << 16
    safe = np.where(wide, 0xFFFD, cp) if wide.any() else cp
    kind, low = table.kind[safe], table.low[safe]
    kind[cp == ord(BOUND)] = SIGN
    group = GROUP[kind]
    cuts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (group[1:] == 4)]))
    ends = np.append(cuts[1:], n)
    real = group[cuts] != 0
    start, end = cuts[real], ends[real]
    g = group[start]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _POW, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _INV, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((low + np.uint64(1)) * power)])
    word = (total[end] - total[start]) * inverse[start] * MULT
    length = end - start
    upper = np.concatenate([[0], np.cumsum(kind == UPPER)])
    ups = upper[end] - upper[start]
    first_up = kind[start] == UPPER
    m = len(start)
    case = np.where(ups == 0, 1, np.where((ups == length) & (length > 1), 2, np.where(first_up & (ups == 1), 3, 4)))
    case = np.where(length == 1, np.where(first_up, 6, 5), case)
    sign = np.minimum(low[start], 255)
    form = np.where(g == 1, case, np.where(g == 2, 8 + np.minimum(length, 15), np.where(g == 3, 7, 24 + sign))).astype(np.uint64)
    # the lexicon, by one look at a slot and a check of the whole hash
    slots, hashes, codes = lexicon(vocabulary)
    s = slots[(word >> np.uint64(44)).astype(np.int64)]
    code = np.where((g == 1) & (s >= 0) & (hashes[s] == word), codes[s], 0).astype(np.uint64)
    glued = np.concatenate([[False], end[:-1] == start[1:]])
    bound = (g == 4) & (cp[start] == ord(BOUND))
    doc = np.cumsum(bound) // GAP - 1
    # a form knows whether its token stands right behind the one before, and the word's class
    f = (form * np.uint64(2) + glued) * np.uint64(8) + code // np.uint64(16)
    v = code % np.uint64(16)
    fv = f * np.uint64(16) + v
    edge = np.uint64(7919)

    def shift(x: np.ndarray, k: int) -> np.ndarray:
        """The column as seen from ``k`` tokens before: x[i + k]."""
        out = np.full_like(x, edge)
        if 0 <= k < m:
            out[: m - k] = x[k:]
        elif 0 < -k < m:
            out[-k:] = x[:k]
        return out

    K1, K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

    def mix(*xs: np.ndarray) -> np.ndarray:
        h = xs[0]
        for x in xs[1:]:
            h = (h * K1 + x) * K2
            h ^= h >> np.uint64(29)
        return h

    F = {k: shift(f, k) for k in range(-7, 8)}
    W = {k: shift(word, k) for k in (-3, -2, -1, 1, 2, 3)}
    back = [shift(fv, -1), shift(fv, 1)]
    last = [low[np.maximum(end - j, start)] for j in (1, 2, 3)]
    head = [low[np.minimum(start + j, end - 1)] for j in (0, 1, 2)]
    suffix2 = last[0] * np.uint64(65536) + last[1]
    suffix3 = suffix2 * np.uint64(65536) + last[2]
    prefix3 = (head[0] * np.uint64(65536) + head[1]) * np.uint64(65536) + head[2]
    # the nearest words of two letters or more, before and behind
    place = np.arange(m)
    solid = (g == 1) & (length > 1)
    before = np.maximum.accumulate(np.where(solid, place, -1))
    before = np.concatenate([[-1], before[:-1]])
    behind = np.minimum.accumulate(np.where(solid, place, m)[::-1])[::-1]
    behind = np.append(behind[1:], m)
    near = lambda x, fill: np.where(np.abs(x - place) <= GAP, np.append(word, [edge, edge])[x], fill)
    wp, wn = near(before, edge), near(np.minimum(behind, m), edge)
    before2 = before[np.maximum(before, 0)]
    wp2 = near(np.where(before >= 0, before2, -1), edge)
    # stretches between blanks: do they hold an at-sign, a dot, digits, letters?
    chunk = np.flatnonzero(~glued)
    which = np.cumsum(~glued) - 1
    marks = np.where(g == 4, np.where(sign == 64, 1, np.where(sign == 46, 2, np.where(sign == 47, 4, 0))), np.where(g == 2, 8, np.where(g == 1, 16, 0)))
    held = (np.bitwise_or.reduceat(marks, chunk) if m else marks)[which].astype(np.uint64)
    after_at = np.cumsum(marks == 1)
    seen_at = (after_at - after_at[chunk][which] + (marks[chunk] == 1)[which] > 0).astype(np.uint64)
    # the line: its length and the place in it
    line = np.concatenate([[0], np.cumsum((g == 3) | bound)[:-1]])
    first = np.concatenate([[True], line[1:] != line[:-1]])
    begin = np.flatnonzero(first)
    since = place - begin[line - line[0]] if m else place
    size = np.diff(np.append(begin, m))[line - line[0]] if m else place
    spot = np.minimum(since, 3) * 5 + np.searchsorted([3, 5, 8, 14], size)
    spot = spot.astype(np.uint64)
    # words with a capital that also stand in lower case in the same text
    key = mix(word, doc.astype(np.uint64))
    lower_seen = np.zeros(m, np.uint64)
    cap = (g == 1) & (ups > 0) & (length > 1)
    plain = np.unique(key[(g == 1) & (ups == 0)])
    if len(plain) and cap.any():
        p = np.minimum(np.searchsorted(plain, key[cap]), len(plain) - 1)
        lower_seen[cap] = 1 + (plain[p] == key[cap])
    feats = [
        word, mix(W[-1], edge), mix(W[1], edge), mix(W[-2], edge), mix(W[2], edge), mix(W[-1], f), mix(W[1], f), mix(W[-2], W[-1]), mix(W[1], W[2]), mix(suffix3, f), mix(prefix3, f),
        fv, mix(back[0], fv, back[1]), mix(wp, f), mix(wn, f), mix(wp2, wp, f),
        mix(F[-1], f, F[1]), mix(F[-2], F[-1], f, F[1], F[2]), mix(F[-3], F[-2], F[-1], f, F[1], F[2], F[3]), mix(f, F[1], F[2], F[3], F[4]), mix(F[-4], F[-3], F[-2], F[-1], f),
        mix(f, F[1], F[2], F[3], F[4], F[5], F[6], F[7]), mix(F[-7], F[-6], F[-5], F[-4], F[-3], F[-2], F[-1], f), mix(F[-2], F[-1], f, F[1], F[2], F[3], F[4], F[5]), mix(F[-5], F[-4], F[-3], F[-2], F[-1], f, F[1], F[2]),
        mix(lower_seen, fv), mix(spot, fv), mix(held, seen_at, f),
    ]
    numbers = np.stack([_slot(x, i) for i, x in enumerate(feats)]) if m else np.empty((len(feats), 0), np.int32)
    # the same word before: names, and numbers of three digits or more
    share = ((g == 1) & (ups > 0) & (length > 2)) | ((g == 2) & (length > 2))
    skip = np.full(m, -1)
    at_share = np.flatnonzero(share)
    if len(at_share):
        order = at_share[np.argsort(key[at_share], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        skip[order[1:][same]] = order[:-1][same]
    return joined, at, Tokens(start, end, doc, g, word, form.astype(np.int64), code, numbers, bound, skip)
