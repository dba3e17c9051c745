"""Small driver-side decisions around the queries: windows, budgets, methods, paths, reports."""
from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("umap", "tsne", "pca")  # fixed values: the order in which a default is looked for
BUDGETS = {2: (40_000, 100_000, 200_000, 400_000), 3: (20_000, 40_000)}  # fixed values: points drawn, by dimensions


def viewport_of(event: dict | None, now: tuple | None) -> tuple | None:
    """The window after a pan or zoom event: new ranges, None after a reset, else unchanged."""
    if not event:
        return now
    if any(k.endswith("autorange") and v for k, v in event.items()):
        return None
    keys = [f"{axis}axis.range[{i}]" for axis in "xy" for i in (0, 1)]
    if all(k in event for k in keys):
        x0, x1, y0, y1 = (float(event[k]) for k in keys)
        return min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    return now


def next_viewport(trigger: str, event: dict | None, frame: tuple | None, now: tuple | None) -> tuple | None:
    """The window after a trigger: a new method or dimension resets it, a retrieval frames its hits, a pan or zoom moves it, all else keeps it."""
    if trigger in ("method", "dims", "reset"):
        return None
    if trigger == "retrieval":
        return frame if frame is not None else now
    return viewport_of(event, now) if trigger == "relayout" else now


def budgets(total: int, dims: int) -> list[tuple[str, int]]:
    """(name, points) of the offered budgets; 'All' only where a flat map can draw all."""
    out = [(f"{n:,}", n) for n in BUDGETS[dims] if n < total]
    return out + ([("All", total)] if dims == 2 or not out else [])


def available(folder: str | Path, method: str, dims: int | None = None) -> bool:
    """Is there a coordinate table of the method (and of the dimensions)?"""
    return Path(folder, f"method={method}", f"dims={dims or 2}").is_dir()


def default_method(folder: str | Path) -> str | None:
    return next((m for m in METHODS if available(folder, m)), None)


def read_coords(spark, folder: str, method: str, dims: int) -> DataFrame:
    """Coordinates of one method; an empty table of the right shape where there are none."""
    names = "xyz"[:dims]
    if not available(folder, method, dims):
        return spark.createDataFrame([], "point long, " + ", ".join(f"{c} float" for c in names))
    return spark.read.parquet(folder).filter((F.col("method") == method) & (F.col("dims") == dims)).select("point", *[F.col(c).cast("float") for c in names])


def build_record(path: str | Path) -> dict:
    """A build record; absent, broken or not an object: empty."""
    try:
        out = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def parameters(record: dict, method: str) -> list[tuple[str, str]]:
    """(name, value) of a method's parameters in a build record; what is missing drops out."""
    at = len(method) + 1
    return [(k[at:], f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)) for k, v in record.items() if k.startswith(method + "_")]


def first_existing(name: str, roots: Iterable[str | Path]) -> Path | None:
    """A file by its path, under any root, by its tail from ``raw/``, or by its bare name."""
    p = Path(name)
    tails = [p, Path(*p.parts[p.parts.index("raw"):]) if "raw" in p.parts else p, Path("raw", p.name), Path(p.name)]
    tries = [p, *[Path(r, t) for r in roots for t in tails if not t.is_absolute()]]
    return next((t for t in tries if t.is_file()), None)


def present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def report(hits: DataFrame, title: str, limit: int = 20, valid: bool = True) -> str:
    """A Markdown table of the first hits by rank; an invalid run says so at its head."""
    rows = hits.orderBy("rank").limit(limit).collect()
    lines = [f"# {title}", ""] + ([] if valid else ["**INVALID: the gene order does not match.**", ""])
    lines += ["| " + " | ".join(hits.columns) + " |", "|" + " --- |" * len(hits.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]) + "\n"


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def clock(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
