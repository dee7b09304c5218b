"""Ranks and ranked values without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def ranked_values(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, rank: str = "__rank", into: str = "__value") -> DataFrame:
    """keys, rank, into: the value at each wanted rank (keys, rank; from 0, smallest first) of a key.

    Equal values are counted where the rows are, so a value that most rows have is a row a task. The
    distinct values are dealt by ranges of (keys, value), whatever a key's share of them; ranges are
    counted, and only those that hold a wanted rank are looked into. Two shuffles of the distinct
    values, however they are spread; infinities are ordinary ends of the order.

    Null and NaN are no values; ranks beyond a key's values, and null keys, are left out; equal values
    take as many ranks as there are rows of them; an empty table gives no rows. Columns of `rows` may
    have any names but those that begin with two underscores.
    """
    some = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")).filter(~F.isnan("__v"))
    counted = some.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    dealt = stored(counted.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()))
    ranges = dealt.groupBy(*keys, "__range").agg(F.sum("__c").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range"))  # a row a range
    started = ranges.select(*keys, "__range", (upto - F.col("__n")).alias("__start"), "__n")
    asked = wanted.select(*keys, F.col(rank).alias("__r")).join(started, keys).filter("__r >= __start AND __r < __start + __n")
    within = F.sum("__c").over(Window.partitionBy(*keys, "__range").orderBy("__v"))
    looked = dealt.join(asked.select(*keys, "__range").distinct(), [*keys, "__range"], "left_semi").withColumn("__upto", within)
    local = asked.select(*keys, "__range", "__r", (F.col("__r") - F.col("__start")).alias("__at"))
    met = local.join(looked, [*keys, "__range"]).filter("__at < __upto AND __at >= __upto - __c")
    return met.select(*keys, F.col("__r").alias(rank), F.col("__v").alias(into))


def numbered(rows: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """The rows with their place in their key (from 0) by `order`: rows are dealt by ranges, and only ranges are counted together."""
    dealt = stored(rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = counts.select(key, "__range", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order)) - 1
    placed = dealt.withColumn("__in", within).join(starts, [key, "__range"])
    return placed.withColumn(into, F.col("__start") + F.col("__in")).select(*rows.columns, into)


def top(rows: DataFrame, key: str | list[str], order: list[Column], limit: int, spread: Column, salts: int = 64) -> DataFrame:
    """The first `limit` rows of each key by `order`, `place` from 1: first of each of a key's `salts` parts, then of those."""
    key = [key] if isinstance(key, str) else key
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = rows.withColumn("__salt", F.pmod(spread, F.lit(salts))).withColumn("place", first([*key, "__salt"])).filter(F.col("place") <= limit)
    return parts.withColumn("place", first(key)).filter(F.col("place") <= limit).drop("__salt")
