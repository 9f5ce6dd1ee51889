"""Cutting a sorted rewrite into files at key boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df computed once: range limits are sampled, so two evaluations could deal rows out differently."""
    context = df.sparkSession.sparkContext
    folder = context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def entry_bytes(value: str = "value"):
    """Bytes of a version as the size rules count them: key, 8 for the timestamp, value."""
    return F.length("key") + F.coalesce(F.length(value), F.lit(0)) + F.lit(8)


def with_file(log: DataFrame, target_bytes: int, value: str = "value") -> DataFrame:
    """key, key_bytes and file_no of every key: key ranges of about target_bytes, in key order, with all
    versions of a key in one file, however large.

    Keys are dealt out by range; ranges are summed; the sums, one a range, shift the running sums
    inside.  No task sees all keys.
    """
    keys = log.groupBy("key").agg(F.sum(entry_bytes(value)).cast("long").alias("key_bytes"))
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(keys.repartitionByRange(n, "key").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("key_bytes").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_start") + F.coalesce(F.sum("key_bytes").over(inside), F.lit(0))
    out = ranged.join(F.broadcast(sums), F.col("_range") == F.col("_r"))  # a row a shuffle partition
    return out.select("key", "key_bytes", F.floor(start / F.lit(target_bytes)).cast("long").alias("file_no"))
