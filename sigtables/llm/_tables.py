"""Reading the tables, sizing partitions by the input and keeping intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtables.model import kept, shared_folder, table

__all__ = ["kept", "pieces", "remove_folder", "shared_folder", "table", "text_bytes"]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark keeps it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(docs: DataFrame, name: str = "text") -> int:
    """Bytes of text over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(name).cast("long")), F.lit(0))).first()[0]


def pieces(total_bytes: int, each: int = 8 << 20, least: int = 16) -> int:
    """How many pieces of about `each` bytes hold total_bytes."""
    return max(least, -(-total_bytes // each))
