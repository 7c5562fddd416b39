"""A library of signals, pulses and their contents as tables: written in one go, read by range, counted and audited."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtables.functions.scalars import scaled
from sigtables.operators.catalog import zone_maps
from sigtables.operators.profile import summarise

#: The columns that name a content, by table.
REFERENCES = (("signals", "content"), ("signals", "time_content"), ("groups", "toa_content"), ("fields", "content"), ("artifacts", "content"))


def write_signals(samples: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes samples (group_id, signal_id, idx, t_s, value) and a signal table with their summaries under path; returns both.

    Files are sorted by signal and index, so that a range of one signal is a few row groups. The signals' summaries come
    from what was written.
    """
    spark = samples.sparkSession
    samples.repartitionByRange("signal_id", "idx").sortWithinPartitions("signal_id", "idx").write.parquet(f"{path}/samples")
    stored = spark.read.parquet(f"{path}/samples")
    summarise(stored, "group_id", "signal_id").write.parquet(f"{path}/signals")
    return stored, spark.read.parquet(f"{path}/signals")


def write_pulses(pulses: DataFrame, path: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Writes pulses (group_id, idx, toa_s, fields) and the zone maps of each group's fields under path; returns both."""
    spark = pulses.sparkSession
    pulses.repartitionByRange("group_id", "idx").sortWithinPartitions("group_id", "idx").write.parquet(f"{path}/pulses")
    stored = spark.read.parquet(f"{path}/pulses")
    zone_maps(stored, list(fields)).write.parquet(f"{path}/fields")
    return stored, spark.read.parquet(f"{path}/fields")


def open_library(spark: SparkSession, path: str, *tables: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def read_range(samples: DataFrame, signal_id: int, start: int, stop: int, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Samples of a signal from start up to stop (what lies outside the signal is left out), as the values that stored numbers mean."""
    own = samples.where((F.col("signal_id") == signal_id) & (F.col("idx") >= max(start, 0)) & (F.col("idx") < stop))
    return own.withColumn("value", scaled(F.col("value"), scale, offset))


def pages(samples: DataFrame, page: int, size: int = 200) -> DataFrame:
    """The rows of one page of each signal's or group's value table, by index; nothing is counted off."""
    return samples.where((F.col("idx") >= page * size) & (F.col("idx") < (page + 1) * size))


def read_record(pulses: DataFrame, group_id: int, idx: int) -> DataFrame:
    """One pulse across all its fields."""
    return pulses.where((F.col("group_id") == group_id) & (F.col("idx") == idx))


def groups_of_dataset(trains: DataFrame, groups: DataFrame, dataset: object) -> DataFrame:
    """The groups of a dataset's trains (dataset, train_id, train_ord), by the order of trains and of groups in them."""
    own = trains.where(F.col("dataset") == dataset).select("train_id", "train_ord")
    return groups.join(own, "train_id").orderBy("train_ord", "group_ord")


def train_extent(pulses: DataFrame, train: str, group: str = "group_id") -> DataFrame:
    return pulses.groupBy(F.col(train).alias("train")).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("pulses"))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: 8 a number, the text's bytes, those of arrays' elements."""
    wide = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}

    def size(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(c)
        if kind.startswith("array<"):
            return F.size(c) * wide.get(kind[6:-1], 8)
        return F.when(c.isNotNull(), wide.get(kind, 8))

    parts = [F.coalesce(size(n, k).cast("long"), F.lit(0).cast("long")) for n, k in df.dtypes]
    return sum(parts[1:], parts[0])


def summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """entity, n and bytes of each table."""
    out = None
    for name, df in tables.items():
        part = df.select(row_bytes(df).alias("b")).agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).select("entity", "n", "bytes")
        out = part if out is None else out.unionByName(part)
    return out


def storage(contents: DataFrame) -> DataFrame:
    """kind, contents, bytes and unreferenced bytes of contents (kind, byte_len, refcount)."""
    lost = F.when(F.col("refcount") <= 0, F.col("byte_len")).otherwise(0)
    return contents.groupBy("kind").agg(F.count("*").alias("contents"), F.sum("byte_len").alias("bytes"), F.sum(lost).alias("unreferenced_bytes"))


def references(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]] = REFERENCES) -> DataFrame:
    """source, row_id and content of every reference to a content, from all columns that hold one."""
    out = None
    for table, column in columns:
        if table in tables and column in tables[table].columns:
            part = tables[table].where(F.col(column).isNotNull()).select(F.lit(f"{table}.{column}").alias("source"), F.col("id").cast("string").alias("row_id"), F.col(column).alias("content"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("tables: none has a reference")
    return out


def verify(contents: DataFrame, refs: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """content, fault and detail of every fault; nothing is changed.

    contents: content, byte_len, checksum, refcount; refs as references() gives them; data: content and bytes, as stored.
    Faults: dangling (a reference to no content), pending (not finished), unreferenced, refcount (another count than
    stored), length and checksum; a wrong length isn't reported as a wrong checksum as well.
    """
    counted = refs.groupBy("content").agg(F.count("*").alias("actual"))
    dangling = refs.join(contents, "content", "left_anti").select("content", F.lit("dangling").alias("fault"), F.concat_ws(" ", "source", "row_id").alias("detail"))
    pending = F.col("checksum").startswith("pending:")
    d = contents.join(counted, "content", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    state = F.when(pending, "pending").when(F.col("actual") == 0, "unreferenced").when(F.col("actual") != F.col("refcount"), "refcount")
    out = dangling.unionByName(d.select("content", state.alias("fault"), F.concat_ws(" ", "refcount", "actual").alias("detail")).where("fault IS NOT NULL"))
    if data is None:
        return out
    stored = data.select("content", F.octet_length("data").cast("long").alias("n"), F.sha2("data", 256).alias("sum"))
    s = contents.where(~pending).join(stored, "content", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    fault = F.when(F.col("n") != F.col("byte_len"), "length").when(~F.col("sum").eqNullSafe(F.col("checksum")), "checksum")
    return out.unionByName(s.select("content", fault.alias("fault"), F.concat_ws(" ", "byte_len", "n").alias("detail")).where("fault IS NOT NULL"))


def repaired(contents: DataFrame, refs: DataFrame) -> DataFrame:
    """contents with the counts of their references, without pending ones and those that nothing refers to; data is never mended."""
    counted = refs.groupBy("content").agg(F.count("*").alias("_n"))
    return contents.where(~F.col("checksum").startswith("pending:")).join(counted, "content").withColumn("refcount", F.col("_n")).drop("_n")
