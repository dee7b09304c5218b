"""Shared plumbing: scratch tables in the cluster's shared folder, stable row ids, prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters of `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Unset, a temporary folder takes its place on a local master; on a cluster that would not be
    shared, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most `rows` rows at a time, as rows that hold whole sets or texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """The named columns plus `row`, a number that stays with each input row (also with repeated rows)."""
    return materialize(docs.select(*[c.alias(n) for n, c in columns.items()]).withColumn("row", F.monotonically_increasing_id()))


#: Bitmaps of 4 KB that are broadcast at most: 32 MB, up to 268 million rows.
MOST_BITMAPS = 8192


def only_rows(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a table with large columns whose `row` is in `wanted`, without a shuffle of the table.

    The wanted numbers are a bit each, in bitmaps of 32,768 that are counted before they are broadcast;
    of more than MOST_BITMAPS both tables are shuffled instead.
    """
    number, bit = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    bitmaps = materialize(wanted.select("row").groupBy(number.alias("__n")).agg(F.bitmap_construct_agg(bit).alias("__bits")), "lz4")
    if bitmaps.count() > MOST_BITMAPS:
        return table.join(wanted.select("row"), "row", "left_semi")
    byte = F.conv(F.hex(F.substr("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = table.withColumn("__n", number).join(F.broadcast(bitmaps), "__n")
    return met.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(*table.columns)


def keep_rows(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents of a stored table (struct column `doc`, `row`) whose row is in `kept`; texts are not shuffled."""
    return only_rows(stored, kept).select("doc.*")


def numbered(df: DataFrame, groups: list[str], order: list[Column], size: Column, into: str, buckets: int = 512, spread: Column | None = None) -> DataFrame:
    """Adds `into`: the sum of `size` over the rows before this one in its group.

    A group is dealt to `buckets` by a hash, so that no task holds a whole group; only the sums of
    buckets meet, at most `buckets` rows a group. The order is that of buckets, then `order`.
    """
    part = F.pmod(spread if spread is not None else F.xxhash64(*order), F.lit(buckets)).cast("int")
    dealt = df.withColumn("__bucket", part).withColumn("__size", size.cast("long"))
    by_bucket = Window.partitionBy(*groups, "__bucket").orderBy(*order)
    inner = F.sum("__size").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*groups, "__bucket").agg(F.sum("__size").alias("__total")).withColumn("__start", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    same = [dealt[g].eqNullSafe(F.col(f"s.{g}")) for g in [*groups, "__bucket"]]
    placed = dealt.withColumn("__inner", F.coalesce(inner, F.lit(0)))
    same = [placed[g].eqNullSafe(F.col(f"s.{g}")) for g in [*groups, "__bucket"]]
    joined = placed.alias("d").join(starts.alias("s"), same[0] if len(same) == 1 else _all(same))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("s.__start") + F.col("d.__inner")).alias(into))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
