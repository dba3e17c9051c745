"""Top N items within every group by a global sort and prefix-summed positions.

Rows are sorted by group, score and identifier over range partitions, so a group
of any size spreads over as many partitions as it needs.  Each partition numbers
its own rows; what earlier partitions hold of a group that runs over their edge
is prefix-summed, which gives exact positions.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

COLS = ["kind", "key", "score", "id"]


def _differs(col: pa.Array, last: object) -> np.ndarray:
    """Does each value differ from the one before it, the first from ``last``?"""
    n = len(col)
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    out[0] = last is None or col[0].as_py() != last
    return out


def _numbered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, the first ``n`` distinct ones of each group, with their position."""
    last: list[object] = [None] * 4
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        diff = [_differs(batch.column(i), last[i]) for i in range(4)]
        group = diff[0] | diff[1]
        new = group | diff[2] | diff[3]
        count = np.cumsum(new)
        # distinct rows counted before each group's first one; the first group goes on from the batch before
        start = np.maximum.accumulate(np.where(group, count - 1, -seen))
        pos = count - start
        keep = new & (pos <= n)
        seen = int(pos[-1])
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(4)]
        if keep.any():
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(4)], pa.array(pos[keep].astype(np.int32))], names=[*COLS, "pos"])


def top_n(rows: DataFrame, n: int) -> DataFrame:
    """kind, key, score, id, pos: the ``n`` best rows of each (kind, key), highest score first, then smaller id.

    ``rows`` has exactly kind string, key string, score double, id long.  Null
    and NaN scores, null keys and null ids never count.  Repeated rows count
    once; an id that comes with different scores counts once for each.  Empty
    input gives no rows.
    """
    clean = rows.select("kind", "key", (F.col("score") + 0.0).alias("score"), "id").filter(
        F.col("score").isNotNull() & ~F.isnan("score") & F.col("key").isNotNull() & F.col("id").isNotNull()
    )
    order = [F.col("kind"), F.col("key"), F.col("score").desc(), F.col("id")]
    schema = "kind string, key string, score double, id long, pos int"
    # Before anything is shuffled each task drops what cannot be among the first n of its own rows.
    few = cut(clean.sortWithinPartitions(*order).mapInArrow(lambda it: _numbered(it, n), schema).drop("pos"), "topn-few")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = few.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = cut(ranged.mapInArrow(lambda it: _numbered(it, n), schema).withColumn("part", F.spark_partition_id()), "topn-local")
    # Only the first and last group of a partition can go on elsewhere: one row a partition reaches the driver.
    edge = F.struct("kind", "key")
    ends = (
        local.groupBy("part").agg(F.min(edge).alias("a"), F.max(edge).alias("b"))
    )
    counts = (
        local.join(F.broadcast(ends), "part")  # a row a partition
        .filter((edge == F.col("a")) | (edge == F.col("b")))
        .groupBy("part", "kind", "key").agg(F.max("pos").alias("n")).collect()
    )
    carry: list[tuple[int, str, str, int]] = []
    total: dict[tuple[str, str], int] = {}
    for r in sorted(counts, key=lambda r: r["part"]):
        g = (r["kind"], r["key"])
        if g in total:
            carry.append((r["part"], *g, total[g]))
        total[g] = total.get(g, 0) + r["n"]
    if not carry:
        return local.select(*COLS, "pos")
    before = rows.sparkSession.createDataFrame(carry, "part int, kind string, key string, before int")
    return (
        local.join(F.broadcast(before), ["part", "kind", "key"], "left")  # fewer rows than partitions
        .withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0))).filter(F.col("pos") <= n).select(*COLS, "pos")
    )
