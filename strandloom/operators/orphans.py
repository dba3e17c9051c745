"""References to records that do not exist: missing, deleted or late parents.

References and the load/delete marks of their parents are co-partitioned by key
and sorted by time; one pass over both merged streams carries the number of
parents alive.  A key that holds a large share of the references is split: its
references are spread over salts and its few marks repeated on each.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.skew import hot_hashes


def parent_marks(parents: DataFrame, key: list[Column], loaded: Column, deleted: Column) -> DataFrame:
    """k, at, delta: how many parents of a key come and go at each instant, summed before any shuffle.

    Rows with a null key or load time, or deleted no later than loaded, never live.
    """
    k = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    live = parents.select(k.alias("k"), loaded.alias("a"), deleted.alias("d")).filter(
        F.col("a").isNotNull() & (F.col("d").isNull() | (F.col("d") > F.col("a")))
    )
    for i in range(len(key)):
        live = live.filter(F.col(f"k.k{i}").isNotNull())
    marks = live.select("k", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("d").alias("at"), F.lit(-1).alias("delta")))).alias("m"))
    return marks.filter(F.col("m.at").isNotNull()).groupBy("k", F.col("m.at").alias("at")).agg(F.sum("m.delta").alias("delta"), F.sum(F.greatest("m.delta", F.lit(0))).alias("loads"))


def orphans(refs: DataFrame, ref_id: str, key: list[Column], at: Column, marks: DataFrame) -> DataFrame:
    """ref_id, at, status for every reference without a live parent at its time.

    status: ``deleted`` (a parent lived before), ``late`` (one is loaded later),
    ``missing`` (none ever) and ``undated`` for a reference without a time, to
    which no parent can be live.  A reference with a null key part is an orphan
    too.  References are kept row by row, repeated ones included.
    """
    k = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    r = refs.select(F.col(f"`{ref_id}`").alias("ref_id"), k.alias("k"), at.alias("at"))
    hot, total = hot_hashes(r, ["k"], least=1000)
    salts = max(1, min(1024, math.ceil(total / 500_000)))
    is_hot = F.xxhash64("k").isin(hot) if hot else F.lit(False)
    r = r.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("ref_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    # Ahead of all times each key gets one row with the number of its loads, so a single pass also knows what is still to come.
    heads = marks.groupBy("k").agg(F.sum("loads").alias("total"))
    none = F.lit(0).cast("long")
    every = marks.select("k", "at", F.lit(0).alias("side"), "delta", "loads", none.alias("total")).unionByName(
        heads.select("k", F.lit(None).cast("timestamp").cast(r.schema["at"].dataType).alias("at"), F.lit(-1).alias("side"), none.alias("delta"), none.alias("loads"), "total")
    )
    m = every.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    stream = m.withColumn("ref_id", F.lit(None).cast(r.schema["ref_id"].dataType)).unionByName(
        r.select("k", "salt", "at", F.lit(1).alias("side"), none.alias("delta"), none.alias("loads"), none.alias("total"), "ref_id")
    )
    w = Window.partitionBy("k", "salt").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        stream.withColumn("alive", F.sum("delta").over(w)).withColumn("before", F.sum("loads").over(w)).withColumn("ever", F.max("total").over(w))
    )
    status = F.when(F.col("at").isNull(), "undated").when(F.col("before") > 0, "deleted").when(F.col("ever") > 0, "late").otherwise("missing")
    return merged.filter((F.col("side") == 1) & ((F.col("alive") <= 0) | F.col("at").isNull())).select("ref_id", "at", status.alias("status"))
