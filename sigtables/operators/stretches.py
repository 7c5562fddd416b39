"""States that run along a signal, found in stretches: each task sums up the neighbouring samples that it holds, the sums are put in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a describe function gives: for each stretch, whose first rows it gets, a value of each new column.
Describe = Callable[[np.ndarray, list[np.ndarray]], list[pa.Array]]


def by_stretch(samples: DataFrame, by: Sequence[str], columns: Sequence[str], describe: Describe, schema: str) -> DataFrame:
    """by, at and the columns of schema: a row for each stretch of samples.

    A stretch is a run of neighbouring idx of one signal inside a batch of a task, at its first. No sample is shuffled: what
    isn't in order in a batch is sorted there, and what lies in other batches is another stretch. As stretches have no gaps
    they don't overlap, so what they leave can be put together in the order of `at`. describe(first row of each stretch, columns).
    """
    own = T.StructType([*(samples.schema[c] for c in by), T.StructField("at", T.LongType())])
    for part in T.StructType.fromDDL(schema):
        own = own.add(part)
    names = own.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in range(len(by))]
            idx = batch.column(len(by)).to_numpy(zero_copy_only=False).astype(np.int64)

            def first_rows(codes: list[np.ndarray], idx: np.ndarray) -> np.ndarray:
                new = np.ones(len(idx), bool)
                new[1:] = np.diff(idx) != 1
                for c in codes:
                    new[1:] |= c[1:] != c[:-1]
                return np.flatnonzero(new)

            first, order = first_rows(codes, idx), None
            if len(first) > 1:
                order = np.lexsort((idx, *codes[::-1]))
                if (np.diff(order) == 1).all():
                    order = None
                else:
                    codes, idx = [c[order] for c in codes], idx[order]
                    first = first_rows(codes, idx)
            data = [batch.column(len(by) + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            data = data if order is None else [c[order] for c in data]
            rows = pa.array(first if order is None else order[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(by))), pa.array(idx[first]), *describe(first, data)], names)

    return samples.select(*by, "idx", *columns).mapInArrow(run, own)


def carried(state: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each state, or the last before it in its stretch where it is negative; -1 where there is none."""
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    begin = np.repeat(first, np.diff([*first, len(state)]))
    return np.where(at >= begin, state[np.maximum(at, 0)], -1)


def runs_of(decide: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Describe:
    """Describes stretches of t_s and value by the stays in state 1: head, first_on, last_on, left, right, inner.

    decide(values) gives (what is measured, decision: 1, 0 or -1 for as before). head: the samples before the first decision,
    whose state is that in which the stretch begins; left: the stay that follows it at once, or that begins the stretch; right:
    another one that ends the stretch; inner: those between, which are whole.
    """

    def describe(first: np.ndarray, data: list[np.ndarray]) -> list[pa.Array]:
        times, (values, decision) = data[0], decide(data[1].astype(float))
        state = carried(decision, first)
        new = np.ones(len(state), bool)
        new[1:] = state[1:] != state[:-1]
        new[first] = True
        piece = np.flatnonzero(new)
        kind, end = state[piece], np.append(piece[1:], len(state)) - 1
        top = np.maximum.reduceat(np.where(np.isnan(values), -np.inf, values), piece)
        of = np.searchsorted(first, piece, side="right") - 1
        low, high = np.searchsorted(of, np.arange(len(first))), np.searchsorted(of, np.arange(len(first)), side="right") - 1
        head = kind[low] == -1
        begun = np.where(head, np.minimum(low + 1, len(kind) - 1), low)
        decided = ~head | (high > low)
        first_on, last_on = (kind[begun] == 1) & decided, (kind[high] == 1) & decided
        inner = kind == 1
        inner[begun[first_on]] = False
        inner[high[last_on]] = False
        edges = np.concatenate([[0], np.cumsum(inner)])[np.append(low, len(kind))]

        def stay(at: np.ndarray, there: np.ndarray | None = None) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array(f[at]) for f in (times[piece], times[end], top)], ["start_s", "end_s", "peak"], mask=None if there is None else pa.array(~there))

        return [
            stay(low, head), pa.array(first_on, mask=~decided), pa.array(last_on, mask=~decided), stay(begun, first_on), stay(high, last_on & ~(first_on & (begun == high))),
            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), stay(inner)),
        ]

    return describe


STAY = "struct<start_s:double,end_s:double,peak:double>"
RUNS = f"head {STAY}, first_on boolean, last_on boolean, left {STAY}, right {STAY}, inner array<{STAY}>"


def stays(stretches: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, start_s, end_s and peak of each stay in state 1, from stretches that runs_of() describes; signals begin in state 0.

    The state in which a stretch begins is the last that stretches before it leave. Only stays that meet an end of theirs, three a
    stretch at most, are put together along the signal; whole ones stand apart, in a part for each stretch, so that a signal
    of many stays is many parts. One shuffle of stays serves all.
    """
    outer = ("head", "first_on", "last_on", "left", "right")
    kinds = {c: stretches.schema[c].dataType for c in outer}
    edge = F.struct(F.lit(-1).cast("long").alias("part"), F.lit(None).cast(STAY).alias("stay"), *outer)
    whole = F.transform("inner", lambda x: F.struct(F.col("at").alias("part"), x.alias("stay"), *(F.lit(None).cast(kinds[c]).alias(c) for c in outer)))
    d = stretches.select(*by, "at", F.explode(F.concat(F.array(edge), whole)).alias("x")).select(*by, "at", "x.*")
    w = W.partitionBy(*by, "part")
    d = d.withColumn("_in", F.coalesce(F.last("last_on", ignorenulls=True).over(w.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    pieces = [(F.when(F.col("_in"), F.col("head")), F.lit(True)), (F.col("left"), F.col("_in")), (F.col("right"), F.lit(False)), (F.col("stay"), F.lit(False))]
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), p.alias("stay"), on.alias("goes_on")) for n, (p, on) in enumerate(pieces))), lambda p: p["stay"].isNotNull())
    d = d.select(*by, "part", "at", F.explode(found).alias("p")).select(*by, "part", "at", "p.n", "p.stay.*", "p.goes_on")
    d = d.withColumn("_id", F.sum((~F.col("goes_on")).cast("int")).over(w.orderBy("at", "n").rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*by, "part", "_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("peak").alias("peak")).drop("part", "_id")


def changes(first: np.ndarray, data: list[np.ndarray]) -> list[pa.Array]:
    """Describes stretches of value by their sign changes and their first and last sign, over finite values that are not zero."""
    v = data[0].astype(float)
    sign = np.where(np.isfinite(v) & (v != 0), (v > 0).astype(np.int8), np.int8(-1))
    told = np.flatnonzero(sign >= 0)
    of = np.searchsorted(first, told, side="right") - 1
    turn = (sign[told][1:] != sign[told][:-1]) & (of[1:] == of[:-1])
    low, high = np.searchsorted(of, np.arange(len(first))), np.searchsorted(of, np.arange(len(first)), side="right") - 1
    none = high < low
    begin, end = (sign[told][np.clip(k, 0, len(told) - 1)] if len(told) else np.zeros(len(first), np.int8) for k in (low, high))
    return [pa.array(np.bincount(of[1:][turn], minlength=len(first)).astype(np.int64)), pa.array(begin, pa.int8(), mask=none), pa.array(end, pa.int8(), mask=none)]
