"""Groups of lines chained by counts, found in parallel: a group's line says how many lines belong to it, the next begins after them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.model import kept

#: Lines in a bucket, which one task walks through.
BUCKET = 1 << 16
HOPS = pa.schema([("path", pa.string()), ("n", pa.int64()), ("next", pa.int64())])


def numbered(rows: DataFrame, number: str, *by: str) -> DataFrame:
    """rows of file blocks (path, block and other columns) with their number in the file, without a shuffle of the rows.

    Rows of a block stand together in one partition, so the count of each block is all that tasks must know: a row for each
    spark.sql.files.maxPartitionBytes of the files, which is broadcast. (A shuffled join would also move the rows whose places
    in their partitions are counted.)
    """
    own = rows.withColumn("_at", F.monotonically_increasing_id())
    sizes = own.groupBy("path", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("path", "block", (before - F.col("_first")).alias("_shift"))
    return own.join(F.broadcast(starts), ["path", "block"]).withColumn(number, F.col("_at") + F.col("_shift")).drop("_at", "_shift")


def _walk(table: pa.Table) -> tuple[str, np.ndarray, np.ndarray]:
    """(path, lines, the line after each one's group) of one bucket."""
    order = np.argsort(table.column("n").to_numpy())
    n = table.column("n").to_numpy()[order]
    take, odd = table.column("take").to_numpy()[order], table.column("odd").to_numpy(zero_copy_only=False)[order]
    later, after = table.column("later_odd")[0].as_py(), np.empty(len(n), np.int64)
    for i in range(len(n) - 1, -1, -1):
        after[i] = later if take[i] < 0 else min(n[i] + take[i] + 1, later)
        if odd[i]:
            later = int(n[i])
    return table.column("path")[0].as_py(), n, after


def _hops(table: pa.Table) -> pa.Table:
    """For each line of a bucket, if it began a group, the first line beyond the bucket that would, where the file has one."""
    path, n, after = _walk(table)
    first, last = int(n[0]), int(n[-1])
    for i in range(len(n) - 1, -1, -1):
        if after[i] <= last:
            after[i] = after[after[i] - first]
    inside = after < table.column("file_end")[0].as_py()
    return pa.table({"path": pa.array([path] * int(inside.sum()), pa.string()), "n": n[inside], "next": after[inside]}, schema=HOPS)


def _starts(table: pa.Table) -> pa.Table:
    """The lines that begin groups, from the one where the bucket is entered on."""
    path, n, after = _walk(table)
    at, first, out = table.column("entry")[0].as_py(), int(n[0]), []
    while at is not None and at <= n[-1]:
        out.append((at, int(after[at - first])))
        at = out[-1][1]
    return pa.table({"path": pa.array([path] * len(out)), "n": pa.array([a for a, _ in out], pa.int64()), "next": pa.array([b for _, b in out], pa.int64())}, schema=HOPS)


def group_lines(lines: DataFrame, first: int, bucket: int | None = None) -> DataFrame:
    """lines with group_ord and row: row -1 begins a group, the others are numbered in it.

    lines: path, n (0 and on without a gap), take (lines that would belong to it, -1: all up to the next odd one) and odd
    (can't belong to a group). A group ends early at an odd line. Lines before `first` are left out.

    Where a group would end is known for every line by itself. Buckets of lines turn that into hops beyond the bucket; as
    chains soon meet, few lines are reached by hops, and which of them the first line reaches is found by doubling hops.
    """
    bucket = bucket or BUCKET
    d = lines.where(F.col("n") >= first).withColumn("bucket", F.floor(F.col("n") / bucket))
    each = d.groupBy("path", "bucket").agg(F.min(F.when(F.col("odd"), F.col("n"))).alias("first_odd"), (F.max("n") + 1).alias("end"))
    by = W.partitionBy("path").orderBy("bucket")
    later = F.coalesce(F.min("first_odd").over(by.rowsBetween(1, W.unboundedFollowing)), F.max("end").over(W.partitionBy("path")))
    each = kept(each.select("path", "bucket", later.alias("later_odd"), F.max("end").over(W.partitionBy("path")).alias("file_end")))
    d = d.join(each, ["path", "bucket"])
    narrow = kept(d.select("path", "bucket", "n", "take", "odd", "later_odd", "file_end"))
    hops = kept(narrow.groupBy("path", "bucket").applyInArrow(_hops, "path string, n long, next long"))
    start = narrow.groupBy("path").agg(F.min("n").alias("n"))
    graph = kept(hops.join(hops.select("path", F.col("next").alias("n")).union(start).distinct(), ["path", "n"]))
    reached = start
    while not graph.isEmpty():
        reached = kept(reached.union(reached.join(graph, ["path", "n"]).select("path", F.col("next").alias("n"))).distinct())
        graph = kept(graph.join(graph.select("path", F.col("n").alias("next"), F.col("next").alias("_n")), ["path", "next"]).select("path", "n", F.col("_n").alias("next")))
    entries = reached.groupBy("path", F.floor(F.col("n") / bucket).alias("bucket")).agg(F.min("n").alias("entry"))
    begun = kept(narrow.join(entries, ["path", "bucket"]).groupBy("path", "bucket").applyInArrow(_starts, "path string, n long, next long").withColumn("bucket", F.floor(F.col("n") / bucket)))
    counts = begun.groupBy("path", "bucket").agg(F.count("*").alias("groups"), F.max("n").alias("last"))
    before = each.select("path", "bucket").join(counts, ["path", "bucket"], "left")
    upto = by.rowsBetween(W.unboundedPreceding, -1)
    before = before.select("path", "bucket", F.coalesce(F.sum("groups").over(upto), F.lit(0)).alias("_groups"), F.last("last", ignorenulls=True).over(upto).alias("_last"))
    d = d.drop("take", "odd", "later_odd", "file_end").join(begun.select("path", "n", F.lit(True).alias("_begins")), ["path", "n"], "left").join(before, ["path", "bucket"])
    inside = W.partitionBy("path", "bucket").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_g", F.coalesce(F.last(F.when(F.col("_begins"), F.col("n")), ignorenulls=True).over(inside), "_last"))
    d = d.withColumns({"group_ord": (F.col("_groups") + F.count("_begins").over(inside) - 1).cast("int"), "row": (F.col("n") - F.col("_g") - 1).cast("int")})
    return d.drop("_begins", "_groups", "_last", "_g", "bucket")
