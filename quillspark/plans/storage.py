"""Tables on storage that all executors share: they cut lineage, and a lost executor costs only
the tasks that it was running."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LOCAL_BITS = 33  # monotonically_increasing_id: the row's place in its partition


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a fresh temporary folder if driver and executors
    are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """The table, written once and read again."""
    path = f"{shared_dir(df.sparkSession)}/quillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a stored table with fewer splits than cores to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return keep(rows).withColumn("_pid", F.shiftright("_mid", LOCAL_BITS))


def number(df: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers rows 0, 1, ... in the order of key: ranges of keys are sorted apart, each numbers its
    own, and their offsets are a row a partition."""
    rows = _sorted(df, [F.col(key)])
    sizes = rows.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return rows.join(F.broadcast(offsets), "_pid").withColumn(name, place).drop("_pid", "_off", "_mid")


def running_sum(df: DataFrame, keys: list[str], order: Column, value: str, name: str) -> DataFrame:
    """The running total of value by key in the given order, each row's own included. Ranges of
    the order are summed apart, so that no key is a task; totals before them are a row a range and key."""
    rows = _sorted(df, [*map(F.col, keys), order])
    sums = rows.groupBy("_pid", *keys).agg(F.sum(value).alias("_s"))
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_pid", *keys, F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_off"))
    inside = W.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(F.broadcast(offsets), ["_pid", *keys]).withColumn(name, F.col("_off") + F.sum(value).over(inside)).drop("_pid", "_mid", "_off")
