"""Gates that run on the driver: files, digests, parameters; each gives (check, value, threshold, status)."""
from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_pointer(path: str | Path) -> bool:
    """A small text file that stands for a large one kept elsewhere."""
    p = Path(path)
    return p.is_file() and p.stat().st_size <= 4096 and p.read_bytes().startswith(b"version https://git-lfs")


def artifacts(expected: dict[str, tuple[int, str] | None], root: str | Path) -> list[tuple[str, str, str, str]]:
    """Presence, size and digest of files; all problems at once."""
    rows = []
    for name, want in expected.items():
        p = Path(root, name)
        if not p.is_file() or is_pointer(p):
            rows.append((name, "missing", "present", "FAIL"))
        elif want and (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) != tuple(want):
            rows.append((name, f"{p.stat().st_size} bytes", f"{want[0]} bytes", "FAIL"))
        else:
            rows.append((name, "present", "present", "OK"))
    return rows


def digest(genes: list[str], pinned: str) -> tuple[str, str, str, str]:
    got = hashlib.sha256("\n".join(g.strip() for g in genes).encode()).hexdigest()
    return "gene order", got, pinned, "OK" if got == pinned else "FAIL"


def spectrum(shares: list[float], dim: int, most: float = 0.5) -> list[tuple[str, float, float, str]]:
    return [
        ("first share", shares[0], most, "OK" if shares[0] < most else "FAIL"),
        ("spectrum", sum(shares), 1.0, "OK" if len(shares) == dim and abs(sum(shares) - 1) < 1e-6 else "FAIL"),
    ]


def quality(share: float, recall: float, chance: float, method: str) -> tuple[str, float, float, str]:
    """A neighbour layout must keep a quarter of what is recoverable and 20 times the recall of chance; a linear one only warns."""
    good = share > 0.25 and recall > 20 * chance
    return f"{method} quality", share, 0.25, "OK" if good else "WARN" if method == "pca" else "FAIL"


def mixing(ratio: float) -> tuple[str, float, float, str]:
    return "mixing", ratio, 50.0, "WARN" if ratio > 50 else "MODERATE" if ratio > 10 else "OK"


def same_rows(before: DataFrame, after: DataFrame) -> tuple[str, int, int, str]:
    a, b = before.count(), after.count()
    return "row count", b, a, "OK" if a == b else "FAIL"


def covered(df: DataFrame, flag: str, least: float = 0.5) -> tuple[str, float, float, str]:
    rate = df.agg(F.avg(F.col(flag).cast("int"))).first()[0] or 0.0
    return "hit rate", rate, least, "OK" if rate >= least else "FAIL"


def spread(ratio: float, least: float = 0.05) -> tuple[str, float, float, str]:
    return "spread ratio", ratio, least, "OK" if ratio > least else "FAIL"


def shard_totals(rows: dict[str, tuple[int, int]], total: int) -> list[tuple[str, int, int, str]]:
    """Per shard the rows written against those read, and their sum against the announced total."""
    out = [(name, wrote, read, "OK" if wrote == read else "FAIL") for name, (wrote, read) in sorted(rows.items())]
    done = sum(w for w, _ in rows.values())
    return [*out, ("total", done, total, "OK" if done == total else "FAIL")]


def stage(name: str, asked: bool, made: bool) -> tuple[str, str, str, str]:
    """A stage that was not asked for is skipped; one that ran and left nothing failed."""
    return name, "made" if made else "absent", "asked" if asked else "not asked", "OK" if made else "FAIL" if asked else "SKIP"


def gene_choice(lists: dict[str, list[str]], pinned: str, wanted: int | None, inferred: list[str] | None = None) -> tuple[str, list[str], str]:
    """(name, genes, status): the list whose digest is pinned; else one as long as the checkpoint says; else the first; else the genes inferred from the checkpoint, each once.

    Only the first is certain; the others come with WARN, and without any list with FAIL.
    """
    for name, genes in lists.items():
        if digest(genes, pinned)[3] == "OK":
            return name, genes, "OK"
    for name, genes in lists.items():
        if wanted is not None and len(genes) == wanted:
            return name, genes, "WARN"
    if lists:
        name = next(iter(lists))
        return name, lists[name], "WARN"
    if inferred:
        once = list(dict.fromkeys(g.strip() for g in inferred if g.strip()))
        return "inferred", once[:wanted] if wanted else once, "WARN"
    return "none", [], "FAIL"


def attention(config: dict, needed: str = "flash") -> tuple[str, str, str, str]:
    mode = str(config.get("attention", config.get("attn_mode", ""))).lower()
    return "attention mode", mode or "unknown", needed, "OK" if mode == needed else "FAIL"


def vectors(df: DataFrame, vec: str, dim: int, least: float = 1e-4) -> list[tuple[str, float, float, str]]:
    """Every vector has ``dim`` finite entries, and the entries vary."""
    e = F.col(vec)
    odd = e.isNull() | (F.size(e) != dim) | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = df.agg(F.count_if(odd)).first()[0]
    entries = df.filter(~F.coalesce(odd, F.lit(True))).select(F.posexplode(e.cast("array<double>")).alias("i", "x"))
    deviation = entries.groupBy("i").agg(F.stddev_pop("x").alias("s")).agg(F.avg("s")).first()[0] or 0.0
    return [("vectors", float(bad), 0.0, "OK" if not bad else "FAIL"), ("mean deviation", deviation, least, "OK" if deviation > least else "FAIL")]


def contiguous(df: DataFrame, block: str, index: str) -> list[tuple[str, float, float, str]]:
    """Each block's indices are one range without a gap, and no two blocks' ranges meet."""
    rows = df.groupBy(block).agg(F.min(index).alias("a"), F.max(index).alias("b"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()  # a row a block
    out, end = [], None
    for r in rows:
        good = r["n"] == r["b"] - r["a"] + 1 and (end is None or r["a"] > end)
        out.append((f"block {r[block]}", float(r["n"]), float(r["b"] - r["a"] + 1), "OK" if good else "FAIL"))
        end = r["b"]
    return out


def exit_code(rows: list[tuple]) -> int:
    return int(any(r[-1] == "FAIL" for r in rows))
