"""Sharding by weighted rendezvous hashing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one numbering task sorts at most, about.
ROWS_PER_TASK = 50_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for u drawn in (0, 1] from the key and the shard; the least score wins the key."""
    u = (F.xxhash64(key, F.lit(shard)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float]) -> Column:
    scores = [F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def rendezvous_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """Adds shard, slot and grown_shard to every row.

    Each shard draws a score for each key; the key goes to the shard with the least. A shard added later can only win
    keys from others, so only the keys that it wins move (grown_shard: where the key is once a shard of grown_weight
    has been added). A shard of weight 0 gets nothing. Slots number a shard's rows from 0 without a gap.

    Rows with equal keys stay together; a null key is a key like any other. Slots of rows with equal keys follow the
    hash of the whole row; repeated whole rows are interchangeable. An empty table stays empty. Columns of df named
    shard, slot or grown_shard are replaced, all others stay whatever they are called.
    """
    if not weights or max(weights) <= 0 or min(weights) < 0:
        raise ValueError("weights: none may be negative and one must be positive")
    names = [f"`{c}`" for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    whole = [n for n, kind in zip(names, (df.schema[n[1:-1]].dataType.simpleString() for n in names), strict=True) if kind != "void" and "map<" not in kind and "variant" not in kind]
    rows = df.select(F.struct(*names).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(*whole).alias("whole"))
    k, best = F.col("key"), _best(F.col("key"), weights)
    grown = _score(k, len(weights), grown_weight) if grown_weight > 0 else F.lit(float("inf"))
    rows = rows.withColumn("best", best)
    # A shard may hold any share of the rows, so each is numbered in parts: a row's slot is its place in its part after all earlier parts.
    parts = max(1, df.count() // (len(weights) * ROWS_PER_TASK) + 1) * 4
    part = F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts))
    rows = rows.select("row", "key", "whole", F.col("best.shard").alias("shard"), F.when(grown < F.col("best.score"), len(weights)).otherwise(F.col("best.shard")).alias("grown_shard"), part.alias("part"))
    sizes = df.select(F.col(f"`{key}`").alias("key")).select(best["shard"].alias("shard"), part.alias("part")).groupBy("shard", "part").count()
    before = sizes.select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    numbered = rows.withColumn("at", F.row_number().over(W.partitionBy("shard", "part").orderBy("key", "whole")) - 1)
    return numbered.join(before, ["shard", "part"]).select("row.*", "shard", "grown_shard", (F.col("before") + F.col("at")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot and grown_shard of each document.

    A null text counts as empty; null and repeated ids are keys like others; an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    facts = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    out = rendezvous_shards(facts, "doc_id", [1.0] * shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
