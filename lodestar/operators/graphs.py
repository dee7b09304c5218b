"""Graphs of code and configuration: reach, ancestors, seeds, includes, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def reach(seeds: DataFrame, edges: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """(node, hop, via) within `hops` edges (src, dst, kind) of the seeds (node): least hop, and the kind of the first edge that reached it.

    Each hop joins the new nodes only, and is stored, so no hop is computed twice. Of kinds that
    reach a node in one hop the least counts; seeds have none.
    """
    allowed = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    allowed = stored(allowed.groupBy("src", "dst").agg(F.min("kind").alias("kind")))
    front = stored(seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")))
    found = front
    for hop in range(1, hops + 1):
        met = front.select(F.col("node").alias("src")).join(allowed, "src").groupBy(F.col("dst").alias("node")).agg(F.min("kind").alias("via"))
        front = stored(met.join(found.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "via"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def hop_summary(reached: DataFrame) -> DataFrame:
    """Nodes a hop and up to it."""
    return reached.groupBy("hop").agg(F.count(F.lit(1)).alias("nodes")).withColumn("upto", F.sum("nodes").over(Window.orderBy("hop")))  # a row a hop


def seeds(by_name: DataFrame, by_registration: DataFrame) -> DataFrame:
    """Nodes named as entry points, and those registered that are not named; with their origin."""
    return by_name.select("node", F.lit("name").alias("origin")).unionByName(by_registration.join(by_name, "node", "left_anti").select("node", F.lit("registration").alias("origin"))).distinct()


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a forest (node, parent; null at roots), depth 0 for itself.

    Depths are doubled in each round, so a tree of depth d takes log2(d) joins.
    """
    known = stored(parents.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionByName(parents.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))))
    width = 1
    while True:
        far = known.filter(F.col("depth") == width).select("node", F.col("ancestor").alias("mid"))
        more = far.join(known.filter("depth > 0").select(F.col("node").alias("mid"), "ancestor", "depth"), "mid").select("node", "ancestor", (F.col("depth") + width).alias("depth"))
        more = stored(more)
        if more.isEmpty():
            return known
        known, width = stored(known.unionByName(more)), width * 2


def nearest(closure: DataFrame, marked: DataFrame) -> DataFrame:
    """Each node's nearest ancestor (itself included) among the marked ones (ancestor, ...); nodes without one are left out."""
    others = [c for c in marked.columns if c != "ancestor"]
    return closure.join(marked, "ancestor").groupBy("node").agg(F.min_by(F.struct("ancestor", *others), "depth").alias("a")).select("node", "a.*")


def resolved(calls: DataFrame, local: DataFrame, exported: DataFrame) -> DataFrame:
    """Calls (file, name) with their target: a function of the same file, else one exported under that name, else none; and the kind."""
    a = local.groupBy("file", "name").agg(F.min("target").alias("here"))
    b = exported.groupBy("name").agg(F.min("target").alias("there"), F.count_distinct("target").alias("candidates"))
    met = calls.join(a, ["file", "name"], "left").join(b, "name", "left")
    kind = F.when(F.col("here").isNotNull(), "local").when(F.col("there").isNotNull(), "exported").when(F.instr("name", ":") > 0, "method").otherwise("unresolved")
    return met.select(*calls.columns, F.coalesce("here", "there").alias("target"), kind.alias("kind"), (F.coalesce("candidates", F.lit(0)) > 1).alias("ambiguous"))


def includes(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, file, depth) of all files that a root file includes, itself at depth 0; `lines`: (file, included). Cycles end at files already seen."""
    edges = stored(lines.select(F.col("file").alias("src"), F.col("included").alias("dst")).distinct())
    front = stored(roots.select(F.col("file").alias("root"), "file", F.lit(0).alias("depth")).distinct())
    found, depth = front, 0
    while True:
        depth += 1
        met = front.select("root", F.col("file").alias("src")).join(edges, "src").select("root", F.col("dst").alias("file")).distinct()
        front = stored(met.join(found.select("root", "file"), ["root", "file"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def offspring(survivors: DataFrame, ident: str, generation: str, per_parent: int) -> DataFrame:
    """The next generation: `per_parent` children of each survivor, with ids below their parent's."""
    child = F.explode(F.sequence(F.lit(1), F.lit(per_parent)))
    rows = survivors.withColumn("__child", child)
    return rows.select(F.concat_ws(".", F.col(ident).cast("string"), F.col("__child").cast("string")).alias(ident), F.col(ident).cast("string").alias("parent"), (F.col(generation) + 1).alias(generation))


def inside(points: DataFrame, at: Column, spans: DataFrame, on: list[str], cell: int) -> DataFrame:
    """Points strictly inside a span (lo, hi) of their group; spans are dealt to cells, so the join is an equi-join."""
    celled = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    return points.withColumn("__at", at).withColumn("__cell", F.floor(at / cell)).join(celled, [*on, "__cell"]).filter((F.col("lo") < F.col("__at")) & (F.col("__at") < F.col("hi"))).drop("__cell", "__at")
