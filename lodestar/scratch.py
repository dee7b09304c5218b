"""Tables written to the cluster's shared folder, to end a lineage that a loop would repeat; rows dealt to tasks by their number."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 2_000_000  # rows that a task sorts at once
PARTS = 1 << 16


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the folder of spark.checkpoint.dir and read back (a temporary folder on a local master)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows dealt by columns to as many tasks as `n` rows (of this or a larger table that it meets) need at TASK_ROWS each."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *by)


def crowded(rows: DataFrame, *by: str, most: Column | None = None) -> tuple[int, int | None, Column | None]:
    """The number of rows, the largest `most`, and which rows are of keys that over TASK_ROWS rows share (none: None), by the hash of the key: one pass with PARTS counts a task."""
    part = F.pmod(F.xxhash64(*by), F.lit(PARTS))
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__c"), F.max(F.lit(0) if most is None else most).alias("__most"))
    seen = counts.agg(F.sum("__c").alias("n"), F.max("__most").alias("most"), F.collect_list(F.when(F.col("__c") > TASK_ROWS, F.col("__part"))).alias("hot")).first()
    return seen.n or 0, seen.most, part.isin(seen.hot) if seen.hot else None
