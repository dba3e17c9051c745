"""Connected components by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import skew_join
from strandloom.session import cut, drop_cut


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return skew_join(sym, _least(sym), ["u"], "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    rest = skew_join(down, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component: every node of an edge with the smallest node of its component.

    ``edges`` has u and v of one orderable type; loops and repeats are harmless,
    null ends are left out, no edges give no rows.  Each round is written to the
    work area, so its lineage never grows, and nothing but two totals reaches
    the driver.
    """
    e = cut(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct(), "cc")
    seen = None
    for _ in range(limit):
        before, e = e, cut(_small_star(_large_star(e)).filter("u <> v").distinct(), "cc")
        drop_cut(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
