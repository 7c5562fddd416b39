"""Several tables published at once: files are staged under a folder of their own, and one manifest says which folders count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.functions.scalars import finite


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> dict[int, dict[str, list[str]]]:
    """The folders of each table by version; a manifest that isn't whole yet doesn't count. One small file a commit is read."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/_commits")):
        return {}
    out = {}
    for f in fs.listStatus(at(f"{path}/_commits")):
        stream = fs.open(f.getPath())
        try:
            out[int(f.getPath().getName().removesuffix(".json"))] = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            continue
        finally:
            stream.close()
    return dict(sorted(out.items()))


def commit(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], replace: tuple[str, ...] = ()) -> int:
    """Adds the rows of all tables, or those of none, and returns the new version; tables in `replace` lose their earlier rows.

    Every table is written first. Then the manifest is made, which fails if another commit has taken its number; then it
    is made anew on top of that one. What fails before leaves files that no manifest names (see abandoned).
    """
    folder = f"{path}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    fs, at = _files(spark, path)
    while True:
        known = versions(spark, path)
        number = max(known, default=0) + 1
        now = {n: list(f) for n, f in known[number - 1].items()} if known else {}
        for name in tables:
            now[name] = [*([] if name in replace else now.get(name, [])), f"{folder}/{name}"]
        try:
            stream = fs.create(at(f"{path}/_commits/{number}.json"), False)
        except Py4JJavaError as e:
            if "Exists" not in str(e.java_exception):
                raise
            continue
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        return number


def tables(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the latest by default; all of one commit, whatever other commits do meanwhile."""
    known = versions(spark, path)
    if not known and version is None:
        return {}
    return {n: spark.read.parquet(*folders) for n, folders in known[max(known) if version is None else version].items()}


def abandoned(spark: SparkSession, path: str) -> list[str]:
    """Staged folders that no version names."""
    fs, at = _files(spark, path)
    named = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in versions(spark, path).values() for folders in v.values() for f in folders}
    staged = [f.getPath().getName() for f in fs.listStatus(at(f"{path}/data"))] if fs.exists(at(f"{path}/data")) else []
    return sorted(set(staged) - named)


def add_dataset(spark: SparkSession, path: str, name: str, pulses: DataFrame, fields: tuple[str, ...]) -> int:
    """Adds a dataset with its trains, groups, pulses and fields by one commit.

    pulses: train, group_id, idx, toa_s and fields. datasets: dataset; trains: dataset, train, train_ord; groups: dataset, train,
    group_id, group_ord, pulses, t0_s; fields: dataset, group_id, field, low, high, n (finite values). A dataset that is there
    already is an error.
    """
    there = tables(spark, path)
    if "datasets" in there and there["datasets"].where(F.col("dataset") == name).count():
        raise ValueError(f"{name}: is there already")
    own = pulses.select(F.lit(name).alias("dataset"), "train", "group_id", "idx", "toa_s", *fields)
    trains = own.select("dataset", "train").distinct()  # a few
    trains = trains.withColumn("train_ord", F.row_number().over(W.partitionBy("dataset").orderBy("train")) - 1)
    groups = own.groupBy("dataset", "train", "group_id").agg(F.count("*").alias("pulses"), F.min_by("toa_s", "idx").alias("t0_s"))
    groups = groups.withColumn("group_ord", F.row_number().over(W.partitionBy("dataset", "train").orderBy("group_id")) - 1)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    value = F.when(finite(F.col("v")), F.col("v"))
    zones = own.select("dataset", "group_id", F.explode(cells).alias("c")).select("dataset", "group_id", "c.*").groupBy("dataset", "group_id", "field").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return commit(spark, path, {"datasets": spark.createDataFrame([(name,)], "dataset string"), "trains": trains, "groups": groups, "pulses": own, "fields": zones})
