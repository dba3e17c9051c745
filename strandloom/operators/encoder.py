"""Forward pass of a small expression transformer in numpy, one Arrow batch at a time."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def seeded_weights(genes: int, dim: int = 16, layers: int = 2, heads: int = 2, seed: int = 0) -> dict[str, np.ndarray]:
    """Stand-in weights; real ones come as an npz with the same names."""
    rng = np.random.default_rng(seed)
    w = {"gene": rng.normal(0, 1, (genes, dim)), "heads": np.array(heads)}
    for n in range(layers):
        for part, shape in (("q", (dim, dim)), ("k", (dim, dim)), ("v", (dim, dim)), ("o", (dim, dim)), ("up", (dim, 4 * dim)), ("down", (4 * dim, dim))):
            w[f"{part}{n}"] = rng.normal(0, shape[0] ** -0.5, shape)
    return w


def _norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def encode(x: np.ndarray, w: dict[str, np.ndarray], mask: float = -10.0) -> np.ndarray:
    """Mean-pooled vectors of samples x genes; a value equal to ``mask`` adds no value term."""
    dim, heads = w["gene"].shape[1], int(w["heads"])
    freq = 100.0 ** (-np.arange(0, dim, 2) / dim)
    angle = np.where(x == mask, 0.0, x)[:, :, None] * freq
    rot = np.concatenate([np.sin(angle), np.cos(angle)], -1) * (x != mask)[:, :, None]
    h = w["gene"][None] + rot
    n = 0
    while f"q{n}" in w:
        y = _norm(h)
        b, t, _ = y.shape
        q, k, v = (np.reshape(y @ w[f"{p}{n}"], (b, t, heads, -1)).transpose(0, 2, 1, 3) for p in "qkv")
        s = q @ k.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1])
        s = np.exp(s - s.max(-1, keepdims=True))
        a = (s / s.sum(-1, keepdims=True)) @ v
        h = h + a.transpose(0, 2, 1, 3).reshape(b, t, dim) @ w[f"o{n}"]
        u = _norm(h) @ w[f"up{n}"]
        h = h + (0.5 * u * (1 + np.tanh(0.7978845608 * (u + 0.044715 * u**3)))) @ w[f"down{n}"]
        n += 1
    return h.mean(1)


FEATURES = ("relu", "elu+1", "sqr", "abs")  # fixed values: feature maps of linear attention
_RANDOM = "favor+"


def valid_feature(kind: str) -> bool:
    """A known feature map; random features may name their number, as in ``favor+_64``."""
    name, _, number = kind.partition("_")
    return name in FEATURES and not number or name == _RANDOM and (not number or number.isdigit() and int(number) > 0)


def feature_map(x: np.ndarray, kind: str, seed: int = 0) -> np.ndarray:
    """Non-negative features whose products stand for attention weights."""
    if not valid_feature(kind):
        raise ValueError(f"unknown feature map {kind}")
    name, _, number = kind.partition("_")
    if name == "relu":
        return np.maximum(x, 0)
    if name == "elu+1":
        return np.where(x > 0, x + 1, np.exp(np.minimum(x, 0)))
    if name == "sqr":
        return x * x
    if name == "abs":
        return np.abs(x)
    d, m = x.shape[-1], int(number or x.shape[-1])
    rng = np.random.default_rng(seed)
    w = np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] * np.sqrt(rng.chisquare(d, d))[:, None] for _ in range(-(-m // d))])[:m]
    x = x / d**0.25
    return np.exp(x @ w.T - (x**2).sum(-1, keepdims=True) / 2 - 1e-6) / np.sqrt(m)


def batch_state(state: np.ndarray, batch: int) -> np.ndarray:
    """A carried state for ``batch`` rows: one row serves all, another number than ``batch`` is an error."""
    if state.shape[0] not in (1, batch):
        raise ValueError(f"a state of {state.shape[0]} rows for a batch of {batch}")
    return np.broadcast_to(state, (batch, *state.shape[1:]))


def linear_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, kind: str = "relu", state: tuple[np.ndarray, np.ndarray] | None = None, block: int = 64) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(outputs, state) of causal attention over (batch, place, dim) in linear time.

    The state is the sum of key features times values, and of key features; a
    text can thus be taken in pieces, each going on from the state of the one
    before.  Places are worked on ``block`` at a time.
    """
    fq, fk = feature_map(q, kind), feature_map(k, kind)
    b, t, f = fk.shape
    s, z = (batch_state(x, b).copy() for x in state) if state else (np.zeros((b, f, v.shape[-1])), np.zeros((b, f)))
    out = np.empty((b, t, v.shape[-1]))
    for a in range(0, t, block):
        x, y, w = fq[:, a: a + block], fk[:, a: a + block], v[:, a: a + block]
        inside = np.tril(np.ones((x.shape[1], x.shape[1])))
        weight = (x @ y.transpose(0, 2, 1)) * inside
        total = x @ s + weight @ w
        norm = np.einsum("btf,bf->bt", x, z) + weight.sum(2)
        out[:, a: a + block] = total / np.maximum(norm, 1e-12)[:, :, None]
        s += y.transpose(0, 2, 1) @ w
        z += y.sum(1)
    return out, (s, z)


def encode_table(df: DataFrame, ident: str, values: str, weights: dict[str, np.ndarray], l2: bool = False) -> DataFrame:
    """ident, embedding of each row's expression array (already aligned to the weights' genes); rows of another length are left out."""
    genes = len(weights["gene"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == genes for v in pdf[values]]]
            for a in range(0, len(pdf), 64):
                part = pdf.iloc[a: a + 64]
                e = encode(np.array(part[values].tolist(), float), weights)
                if l2:
                    e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({ident: part[ident].to_numpy(), "embedding": list(e.astype(np.float32))})

    return df.select(ident, values).mapInPandas(run, f"{ident} {df.schema[ident].dataType.simpleString()}, embedding array<float>")
