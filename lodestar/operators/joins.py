"""Joins with an order or a range in them: winners, intervals, as-of, bands, fallbacks, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of two runs side by side, 0 where one lacks the key: delta, new and gone flags."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return both.select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"), F.col("b").isNull().alias("is_new"), F.col("a").isNull().alias("is_gone"))


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two tables, with both (null where a table lacks the key)."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def winners(rows: DataFrame, key: str, rank: list[Column], keep_losers: bool = False) -> DataFrame:
    """The row that wins each key in load order (`rank` ascending, nulls first, then by all columns); with the losers, every row and its `place`.

    A winner alone is an aggregate, made where the rows are before they meet; places need a key's rows in order.
    """
    if not keep_losers:
        best = F.min(F.struct(F.struct(*rank).alias("__rank"), F.struct(*rows.columns).alias("__row")))["__row"]
        return rows.groupBy(key).agg(best.alias("__row")).select("__row.*")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*rank)))
    return placed


def unused(defined: DataFrame, key: str, *uses: DataFrame) -> DataFrame:
    """Definitions that none of the use tables names."""
    out = defined
    for u in uses:
        out = out.join(u, key, "left_anti")
    return out


def innermost(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, on: list[str], point_id: str, cell: int, span_id: str | None = None) -> DataFrame:
    """Each point with the shortest span of its group that holds it (lo <= at <= hi); of equals the one that begins last, then the one of least `span_id`.

    Spans are dealt to cells of the axis, so the join is an equi-join on group and cell.
    """
    celled = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    met = points.withColumn("__cell", F.floor(F.col(at) / cell)).join(celled, [*on, "__cell"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
    nearest = Window.partitionBy(point_id).orderBy(F.col(hi) - F.col(lo), F.col(lo).desc(), *([F.col(span_id)] if span_id else []))
    return met.withColumn("__place", F.row_number().over(nearest)).filter("__place = 1").drop("__place", "__cell")


def overlaps(rows: DataFrame, key: str, ident: str, lo: str, hi: str, cell: int) -> DataFrame:
    """Pairs of rows of a key whose half-open intervals overlap.

    Intervals are dealt to the cells of the axis that they touch, so a key is split by time and only
    neighbours meet; a pair counts in the cell where its later interval begins.
    """
    celled = rows.filter(F.col(lo) < F.col(hi)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))))
    a, b = celled.alias("a"), celled.alias("b")
    here = F.floor(F.greatest(f"a.{lo}", f"b.{lo}") / cell) == F.col("a.__cell")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__cell") == F.col("b.__cell")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")) & (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}")) & here)


def last_before(rows: DataFrame, key: str, order: list[str], is_source: Column, value: str, into: str) -> DataFrame:
    """For every row, the value of the last source row before it in its key."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(before))


def preceded_within(rows: DataFrame, key: str, t: str, lo: int, hi: int, into: str) -> DataFrame:
    """How many rows of the key come lo to hi units of `t` earlier."""
    band = Window.partitionBy(key).orderBy(t).rangeBetween(-hi, -lo)
    return rows.withColumn(into, F.count(F.lit(1)).over(band))


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear between knots, clamped outside."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))
