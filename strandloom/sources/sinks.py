"""Writers: vectors, coordinates by method, records of a build, reports."""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_coords(df: DataFrame, folder: str, method: str, dims: int) -> None:
    """Coordinates under method and dims, so that a read of one prunes the rest."""
    df.withColumn("method", F.lit(method)).withColumn("dims", F.lit(dims)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "dims").parquet(folder)


def write_raw(df: DataFrame, path: str, vec: str = "embedding", order: str = "global_index", dtype: str = "float16") -> int:
    """Raw rows in order, partition after partition through the driver (an export; never more than a partition at once)."""
    import numpy as np

    n = 0
    with open(path + ".part", "wb") as f:
        for row in df.orderBy(order).select(vec).toLocalIterator(prefetchPartitions=False):
            f.write(np.asarray(row[0], dtype).tobytes())
            n += 1
    os.replace(path + ".part", path)
    return n


def write_metadata(df: DataFrame, folder: str, rows: int = 100_000) -> None:
    """Parquet files of at most ``rows`` rows, each written by its own task."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(folder)


def write_identity(points: DataFrame, accessions: DataFrame, folder: str) -> None:
    """Points with their data set and source row, and the accessions of the index, side by side."""
    points.select(F.col("dataset").cast("byte").alias("dataset"), F.col("src_index").cast("int").alias("src_index"), F.col("species_id").cast("byte").alias("species_id")).write.mode("overwrite").parquet(folder + "/points_meta")
    accessions.select("global_index", "geo_accession").write.mode("overwrite").parquet(folder + "/archs4_geo")


def write_labels(df: DataFrame, folder: str, key: str, labels: list[str]) -> None:
    """A key and its label columns, one file set a label, so that a view reads one column's file only."""
    for c in labels:
        df.select(key, F.col(c).alias("label")).write.mode("overwrite").parquet(f"{folder}/{c}")


def write_npy(df: DataFrame, path: str, dim: int, vec: str = "embedding", order: str = "global_index", dtype: str = "float32") -> int:
    """A .npy matrix in row order; the header is written for the counted rows, then partition after partition follows."""
    import numpy as np

    n = df.count()
    with open(path + ".part", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": (n, dim)})
        for row in df.orderBy(order).select(vec).toLocalIterator(prefetchPartitions=False):
            f.write(np.asarray(row[0], dtype).tobytes())
    os.replace(path + ".part", path)
    return n


def promote(path: str | Path, digest: str) -> None:
    """Put ``path.part`` in place only if its SHA-256 is the expected one; else remove it and raise."""
    part = Path(str(path) + ".part")
    h = hashlib.sha256()
    with part.open("rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    if h.hexdigest() != digest:
        part.unlink()
        raise ValueError(f"{path}: digest {h.hexdigest()} is not {digest}")
    os.replace(part, path)


def reusable(path: str | Path, key: str) -> bool:
    """Was the cached table at ``path`` made from what ``key`` stands for?  Its key lies beside it."""
    try:
        return Path(path).exists() and Path(str(path) + ".key").read_text().strip() == key
    except OSError:
        return False


def keep_key(path: str | Path, key: str) -> None:
    Path(str(path) + ".key").write_text(key)


def merge_record(path: str | Path, shape: dict, new: dict) -> dict:
    """A build record that keeps earlier keys only if they belong to the same shape; an unreadable one starts anew."""
    try:
        old = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        old = {}
    same = isinstance(old, dict) and all(old.get(k) == v for k, v in shape.items())
    out = (old if same else {}) | shape | new
    Path(str(path) + ".part").write_text(json.dumps(out, indent=1, sort_keys=True))
    os.replace(str(path) + ".part", path)
    return out


def fingerprint(parts: Iterable[str]) -> str:
    """Digest of ordered parts: the key under which a cached table may be used again."""
    return hashlib.sha256("\n".join(p.strip() for p in parts).encode()).hexdigest()


def write_csv(df: DataFrame, folder: str) -> None:
    """One file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True)
