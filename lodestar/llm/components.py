"""Connected components by alternating large and small stars, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges with m, the least of u and its neighbours v; a star's edges are dealt to salts, so no task holds all of them."""
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt"))
    salted = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = salted.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return dealt.join(salted.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of `edges` (u, v) but the roots themselves; a root is its component's smallest node."""
    now, before = materialize(edges.filter("u != v").distinct(), "lz4"), None
    while True:
        total = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if total == before or not total.n:
            return now.select("u", F.col("v").alias("root"))
        nxt = materialize(_small(_large(now)).distinct(), "lz4")
        drop_table(now)
        now, before = nxt, total
