"""The capture gate: proof that a rewriting leaves every name bound to what it was bound to.

Names are bound in the script before and after. The pieces that were put in cut both texts into
spans: what stands between pieces is the same in both, shifted. A name of such a span is found again
at its place; a name within a replaced span is compared with the same name in the piece. Where a
binding is another than before, an inserted declaration has captured the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bindings import stored_bindings
from .rules import of


def spans(rewritten: DataFrame) -> DataFrame:
    """path, span, lo, hi, to_lo, to_hi, kept: a script's spans in order, those between pieces and the pieces."""
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("to_start"), F.lit(0).alias("to_end"))), "pieces")
    rows = rewritten.filter("applied > 0").select("path", F.col("pieces").alias("p"), cuts.alias("cuts"), F.size("pieces").alias("n"))
    far = F.lit((1 << 31) - 1)
    after = lambda c, i, name: F.coalesce(F.get(c, i + 1)[name], far)
    between = F.transform("cuts", lambda x, i: F.struct((2 * i).alias("span"), x["end"].alias("lo"), after(F.col("cuts"), i, "start").alias("hi"), x["to_end"].alias("to_lo"), after(F.col("cuts"), i, "to_start").alias("to_hi"), F.lit(True).alias("kept")))
    put = F.transform("p", lambda x, i: F.struct((2 * i + 1).alias("span"), x["start"].alias("lo"), x["end"].alias("hi"), x["to_start"].alias("to_lo"), x["to_end"].alias("to_hi"), F.lit(False).alias("kept")))
    return rows.select("path", F.explode(F.concat(between, put)).alias("s")).select("path", "s.*")


def _placed(rows: DataFrame, cuts: DataFrame, place: str, lo: str, hi: str, into: str) -> DataFrame:
    """Adds {into}_span, {into}_at (the offset in a kept span, else null), {into}_kept for a place; null for what is no place."""
    within = cuts.select(F.col("path").alias("__path"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col("span").alias(f"{into}_span"), "kept")
    met = rows.join(within, (F.col("path") == F.col("__path")) & (F.col(place) >= F.col("__lo")) & (F.col(place) < F.col("__hi")), "left")
    return met.withColumn(f"{into}_at", F.when(F.col("kept"), F.col(place) - F.col("__lo"))).withColumnRenamed("kept", f"{into}_kept").drop("__path", "__lo", "__hi")


def _bound(b: DataFrame, cuts: DataFrame, lo: str, hi: str) -> DataFrame:
    """path, name, line, span, at, and bound: global, the place of the declaration in a kept span, or the piece that declares it."""
    used = of(b, "use").select("path", "name", "line", "lo", F.when(F.col("decl") < -1, -F.col("decl") - 2).otherwise(F.col("decl")).alias("decl"), (F.col("decl") == -1).alias("free"))
    rows = _placed(_placed(used.join(cuts.select("path").distinct(), "path", "left_semi"), cuts, "lo", lo, hi, "own"), cuts, "decl", lo, hi, "its")
    place = F.when(F.col("its_kept"), F.concat_ws(":", "its_span", "its_at")).otherwise(F.concat(F.lit("piece "), "its_span"))
    return rows.select("path", "name", "line", F.col("own_span").alias("span"), F.col("own_at").alias("at"), F.when(F.col("free"), "global").otherwise(place).alias("bound"), (~F.col("free") & ~F.coalesce("its_kept", F.lit(True))).alias("by_piece"))


def captures(files: DataFrame, rewritten: DataFrame) -> DataFrame:
    """path, name, line (in the new text), before, after: names bound to something else after a rewriting.

    `rewritten` is what `edits.rewrite` gives for the files. A variable whose declaration was itself
    replaced and is declared by another piece has moved; that is none. Names that only the new text has
    are none. Scripts that can't be parsed on either side have no names to compare.
    """
    cuts = spans(rewritten)
    old, new = _bound(stored_bindings(files), cuts, "lo", "hi"), _bound(stored_bindings(rewritten), cuts, "to_lo", "to_hi")
    key = ["path", "name", "span"]
    a, b = old.withColumnsRenamed({"bound": "before", "by_piece": "replaced"}).drop("line"), new.withColumnRenamed("bound", "after")
    kept = b.filter("at IS NOT NULL").join(a.filter("at IS NOT NULL"), [*key, "at"]).filter("before != after AND NOT (replaced AND by_piece)")
    was = a.filter("at IS NULL").groupBy(*key).agg(F.collect_set("before").alias("before"), F.bool_or("replaced").alias("replaced"))  # of one piece
    within = b.filter("at IS NULL").join(was, key).filter(~F.array_contains("before", F.col("after")) & ~(F.col("replaced") & F.col("by_piece")))
    return kept.select("path", "name", "line", "before", "after").unionByName(within.select("path", "name", "line", F.array_join(F.sort_array("before"), ", ").alias("before"), "after")).distinct()


def gated(files: DataFrame, rewritten: DataFrame) -> DataFrame:
    """The rewritten scripts without those that have a capture; these are left as they were (applied 0)."""
    bad = captures(files, rewritten).select("path").distinct().withColumn("__bad", F.lit(True))
    old = files.select("path", F.col("text").alias("__old"))
    rows = rewritten.join(bad, "path", "left").join(old, "path")
    held: Column = F.col("__bad").isNotNull()
    return rows.select("path", F.when(held, F.col("__old")).otherwise(F.col("text")).alias("text"), F.when(held, 0).otherwise(F.col("applied")).alias("applied"), F.when(held, F.col("applied") + F.col("dropped")).otherwise(F.col("dropped")).alias("dropped"))
