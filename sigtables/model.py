"""Signals and pulses as tables, and the driver tables that stand in for them."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.functions.scalars import r6

RATE_HZ = 64.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where none is set, as in tests on one machine, a folder of its own; on a cluster an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir: a folder that all executors share is needed")
    warnings.warn("spark.checkpoint.dir is not set: using a folder that only this machine has", stacklevel=2)
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as columns, whose size plans know: for tables that later steps read often, or a few columns of.

    A row costs less to write and to read than what kept() writes, but nothing clears the files away.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly to as many tasks as shuffles have: for rows of which each becomes many, as a read's tasks are dealt by the bytes before that."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def placed(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place (from 0) in an order of all rows, found by ranges.

    Rows are sorted in ranges and written once; a row's place is what stands before it in its range and, by a count of each
    range, in earlier ones. No task holds more than a range, and only counts meet in one.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_nth", F.monotonically_increasing_id())
    ranged = kept(ranged).withColumn("_range", F.shiftright("_nth", 33))
    sizes = ranged.groupBy("_range").agg(F.min("_nth").alias("_first"), F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", (before - F.col("_first")).alias("_shift"))
    return ranged.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_nth") + F.col("_shift")).drop("_nth", "_range", "_shift")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, signal_id, idx, t_s and value: each embedding is a signal at 64 Hz."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("signal_id"), F.posexplode("embedding").alias("idx", "value"))
    return e.select("group_id", "signal_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") / RATE_HZ).alias("t_s"), F.col("value").cast("double").alias("value"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, signal_id and values, the array layout for stages that need a whole short signal."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("signal_id"), F.col("embedding").cast("array<double>").alias("values"))


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, pulse_id, toa_s, value and k: each user's events are a pulse group."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("group_id"), F.col("event_id").alias("pulse_id"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6).alias("toa_s"), "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


__all__ = ["RATE_HZ", "pulses", "r6", "samples", "signals", "table"]
