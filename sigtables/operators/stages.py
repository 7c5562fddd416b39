"""Stages: functions from samples (group_id, signal_id, idx, t_s, value) to samples or artifacts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.functions.scalars import finite
from sigtables.model import kept
from sigtables.operators.stretches import RUNS, by_stretch, runs_of, stays

KEY = ("group_id", "signal_id")
#: What is no more than this is taken for zero: the spacing of doubles at 1.
TINY = 2.220446049250313e-16


def rate_column(rate_hz: float | str) -> Column:
    """A rate: a number for all signals, or the name of a column that has each signal's own."""
    return F.col(rate_hz) if isinstance(rate_hz, str) else F.lit(float(rate_hz))


def by_signal() -> W:
    return W.partitionBy(*KEY).orderBy("idx")


def gain(samples: DataFrame, factor: float = 1.0) -> DataFrame:
    return samples.withColumn("value", F.col("value") * factor)


def whole_signal() -> W:
    return W.partitionBy(*KEY)


def passthrough(samples: DataFrame) -> DataFrame:
    return samples


def detrend(samples: DataFrame, mode: str = "mean") -> DataFrame:
    """Without each signal's mean, or without its least-squares line over the index."""
    w, v = whole_signal(), F.when(finite(F.col("value")), F.col("value"))
    if mode == "mean":
        return samples.withColumn("value", F.col("value") - F.avg(v).over(w))
    if mode != "linear":
        raise ValueError("mode: mean or linear")
    x = F.when(v.isNotNull(), F.col("idx").cast("double"))
    slope = F.coalesce(F.covar_pop(v, x).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0)), F.lit(0.0))
    return samples.withColumn("value", F.col("value") - F.avg(v).over(w) - slope * (F.col("idx") - F.avg(x).over(w)))


def normalise(samples: DataFrame, mode: str = "peak", target: float = 1.0) -> DataFrame:
    """Scaled so that each signal's peak or rms is `target`; one that is all but zero stays."""
    if mode not in ("peak", "rms"):
        raise ValueError("mode: peak or rms")
    w, v = whole_signal(), F.when(finite(F.col("value")), F.col("value"))
    ref = F.max(F.abs(v)).over(w) if mode == "peak" else F.sqrt(F.avg(v * v).over(w))
    return samples.withColumn("_ref", ref).withColumn("value", F.when(F.col("_ref") > TINY, F.col("value") * target / F.col("_ref")).otherwise(F.col("value"))).drop("_ref")


def conditioning_metrics(before: DataFrame, mode: str, target: float = 1.0) -> DataFrame:
    """group_id, signal_id, metric and value of a conditioning stage's input: gain's peak, detrend's offset_removed, normalise's scale.

    A signal that normalise leaves as it is has the metric left_as_is instead of scale.
    """
    v = F.when(finite(F.col("value")), F.col("value"))
    if mode == "peak":
        name, value = F.lit("peak"), F.max(F.abs(v)) * abs(target)
    elif mode == "offset_removed":
        name, value = F.lit("offset_removed"), F.coalesce(F.avg(v), F.lit(0.0))
    else:
        ref = F.max(F.abs(v)) if mode == "scale_peak" else F.sqrt(F.avg(v * v))
        name, value = F.when(ref > TINY, "scale").otherwise("left_as_is"), F.when(ref > TINY, target / ref).otherwise(F.coalesce(ref, F.lit(0.0)))
    return before.groupBy(*KEY).agg(name.alias("metric"), value.alias("value"))


def statistics(summaries: DataFrame) -> DataFrame:
    """signals' min, max, mean, rms and peak_to_peak from their stored summaries, without their samples; 0 where there is none."""
    return summaries.select(*KEY, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("min", "max", "mean", "rms", "peak_to_peak")])


def biquad_coefficients(response: str, cutoff_hz: float, rate_hz: float, q: float = math.sqrt(0.5)) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2 of a second-order low, high, band or notch filter, by the bilinear transform."""
    if not 0 < cutoff_hz < rate_hz / 2:
        raise ValueError("cutoff_hz: between 0 and half the sample rate")
    w = 2 * math.pi * cutoff_hz / rate_hz
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    b = {"low": ((1 - c) / 2, 1 - c, (1 - c) / 2), "high": ((1 + c) / 2, -1 - c, (1 + c) / 2), "band": (alpha, 0.0, -alpha), "notch": (1.0, -2 * c, 1.0)}[response]
    a0 = 1 + alpha
    return (*(x / a0 for x in b), -2 * c / a0, (1 - alpha) / a0)


def filter_signals(signals: DataFrame, response: str, cutoff_hz: float, rate_hz: float, q: float = math.sqrt(0.5), sections: int = 1) -> DataFrame:
    """signals (values as arrays) through a cascade of identical sections that start at rest. For signals that fit in a row."""
    b0, b1, b2, a1, a2 = biquad_coefficients(response, cutoff_hz, rate_hz, q)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        lengths = column.map(lambda v: -1 if v is None else len(v)).to_numpy()
        out = [None] * len(column)
        for n in np.unique(lengths[lengths >= 0]):
            rows = np.flatnonzero(lengths == n)
            x = np.array([column.iloc[i] for i in rows], float).reshape(len(rows), n)
            for _ in range(sections):  # signals side by side, a sample at a time
                y = np.zeros_like(x)
                for i in range(n):
                    y[:, i] = b0 * x[:, i] + (b1 * x[:, i - 1] - a1 * y[:, i - 1] if i > 0 else 0) + (b2 * x[:, i - 2] - a2 * y[:, i - 2] if i > 1 else 0)
                x = y
            for i, row in zip(rows, x, strict=True):
                out[i] = row.tolist()
        return pd.Series(out, dtype=object)

    return signals.withColumn("values", run("values"))


def to_blocks(samples: DataFrame, block: int = 1 << 16, *more: str) -> DataFrame:
    """group_id, signal_id, block, start_idx, start_s, values and `more` columns (one value a signal): the samples of each stretch of
    `block` indexes, in order; null counts as NaN."""
    cells = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("value", F.lit(float("nan"))).alias("value"))))
    d = samples.groupBy(*KEY, F.floor(F.col("idx") / block).alias("block")).agg(cells.alias("v"), F.min_by("t_s", "idx").alias("start_s"), *(F.first(c).alias(c) for c in more))
    return d.select(*KEY, "block", F.get("v", F.lit(0))["idx"].alias("start_idx"), "start_s", F.transform("v", lambda x: x["value"]).alias("values"), *more)


def from_blocks(blocks: DataFrame, rate_hz: float | str) -> DataFrame:
    """samples of blocks without gaps."""
    d = blocks.withColumn("_rate", rate_column(rate_hz)).select(*KEY, "start_idx", "start_s", "_rate", F.posexplode("values").alias("_at", "value"))
    return d.select(*KEY, (F.col("start_idx") + F.col("_at")).alias("idx"), (F.col("start_s") + F.col("_at") / F.col("_rate")).alias("t_s"), "value")


@lru_cache(64)
def going_on(response: str, cutoff_hz: float, rate_hz: float, q: float, block: int) -> np.ndarray:
    """Row i: the output i after a block's start, without any input, for each of the two outputs before it."""
    a1, a2 = biquad_coefficients(response, cutoff_hz, rate_hz, q)[3:]
    step = np.array([[-a1, -a2], [1.0, 0.0]])
    rows, power = step[:1], step
    while len(rows) < block:
        rows, power = np.concatenate([rows, rows @ power]), power @ power
    return rows[:block]


def filter_samples(samples: DataFrame, response: str, cutoff_hz: float, rate_hz: float | str, q: float = math.sqrt(0.5), sections: int = 1, block: int = 1 << 16) -> DataFrame:
    """samples (idx without gaps) through a cascade of identical sections that start at rest, however long a signal is.

    rate_hz: a number, or the column with each signal's own rate, for which the section is designed. A block's output is what
    its inputs give from rest plus what the two outputs before it go on to give. Blocks are run from rest side by side;
    where each one ends, carried from block to block by a 2 by 2 matrix, is a small table of a signal; each block then adds
    its part of that. Every task holds a few blocks.
    """
    if sections < 1 or block < 2:
        raise ValueError("sections: one at least; block: two samples at least")
    if not isinstance(rate_hz, str):
        biquad_coefficients(response, cutoff_hz, rate_hz, q)

    @F.pandas_udf("array<double>")
    def from_rest(values: pd.Series, x1: pd.Series, x2: pd.Series, rates: pd.Series) -> pd.Series:
        out = [None] * len(values)
        kinds = pd.DataFrame({"n": values.map(len).to_numpy(), "rate": rates.to_numpy()})
        for (n, rate), rows in kinds.groupby(["n", "rate"]).indices.items():  # blocks of one length and rate side by side, a sample at a time
            b0, b1, b2, a1, a2 = biquad_coefficients(response, cutoff_hz, rate, q)
            x = np.zeros((n + 2, len(rows)))
            x[2:] = np.array([values.iloc[i] for i in rows], float).T
            x[1], x[0] = x1.to_numpy()[rows], x2.to_numpy()[rows]
            forced = b0 * x[2:] + b1 * x[1:-1] + b2 * x[:-2]
            y = np.zeros((n + 2, len(rows)))
            for i in range(n):
                y[i + 2] = forced[i] - a1 * y[i + 1] - a2 * y[i]
            for i, row in zip(rows, y[2:].T, strict=True):
                out[i] = row.tolist()
        return pd.Series(out, dtype=object)

    @F.pandas_udf("s1 array<double>, s2 array<double>")
    def carried(sizes: pd.Series, e1: pd.Series, e2: pd.Series, rates: pd.Series) -> pd.DataFrame:
        """The two outputs before each block of a signal; signals of as many blocks and one rate side by side, a block at a time."""
        out = np.empty((len(sizes), 2), object)
        kinds = pd.DataFrame({"n": sizes.map(len).to_numpy(), "rate": rates.to_numpy()})
        for (count, rate), rows in kinds.groupby(["n", "rate"]).indices.items():
            goes_on = np.concatenate([[[1.0, 0.0]], going_on(response, cutoff_hz, rate, q, block)])  # row n: the output n - 1 after a block's start
            n, last, before = (np.array([c.iloc[i] for i in rows]).T for c in (sizes, e1, e2))
            s, states = np.zeros((len(rows), 2)), np.zeros((2, len(rows), count))
            for i in range(count):
                states[:, :, i] = s.T
                s = np.stack([last[i] + (goes_on[n[i]] * s).sum(1), before[i] + (goes_on[n[i] - 1] * s).sum(1)], 1)
            for i, a, b in zip(rows, *states, strict=True):
                out[i] = a, b
        return pd.DataFrame({"s1": out[:, 0], "s2": out[:, 1]})

    @F.pandas_udf("array<double>")
    def added(values: pd.Series, s1: pd.Series, s2: pd.Series, rates: pd.Series) -> pd.Series:
        rows = zip(values, s1, s2, rates, strict=True)
        return pd.Series([(np.asarray(v) + going_on(response, cutoff_hz, r, q, block)[: len(v)] @ np.array([a, b])).tolist() for v, a, b, r in rows], dtype=object)

    blocks, zero = to_blocks(samples.withColumn("_rate", rate_column(rate_hz)), block, "_rate"), F.lit(0.0)
    for _ in range(sections):
        last, w = F.slice("values", F.greatest(F.size("values") - 1, F.lit(1)), 2), W.partitionBy(*KEY).orderBy("block")
        d = blocks.withColumn("_last", F.lag(last).over(w))
        x1, x2 = F.coalesce(F.get("_last", F.size("_last") - 1), zero), F.coalesce(F.get("_last", F.size("_last") - 2), zero)
        d = kept(d.withColumn("values", from_rest("values", x1, x2, "_rate")).drop("_last"))
        size = F.size("values")
        ends = d.select(*KEY, "block", "_rate", size.alias("n"), F.get("values", size - 1).alias("e1"), F.coalesce(F.get("values", size - 2), zero).alias("e2"))
        of = ends.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block", "n", "e1", "e2"))).alias("b"), F.first("_rate").alias("_rate"))
        starts = of.select(*KEY, F.col("b.block").alias("block"), carried("b.n", "b.e1", "b.e2", "_rate").alias("s"))
        starts = starts.select(*KEY, F.inline(F.arrays_zip("block", F.col("s.s1").alias("s1"), F.col("s.s2").alias("s2"))))
        blocks = d.join(starts, [*KEY, "block"]).withColumn("values", added("values", "s1", "s2", "_rate")).drop("s1", "s2")
    return from_blocks(blocks, "_rate")


WINDOWS = {"rect": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman-harris": (0.35875, 0.48829, 0.14128, 0.01168), "flat-top": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)}


def window_values(name: str, n: int) -> np.ndarray:
    k = 2 * np.pi * np.arange(n) / n
    return sum((-1) ** i * a * np.cos(i * k) for i, a in enumerate(WINDOWS[name]))


def spectrum(signals: DataFrame, rate_hz: float | str, window: str = "hann", size: int = 0) -> DataFrame:
    """group_id, signal_id, k, freq_hz, magnitude_db and phase_rad of each signal (values as arrays); rate_hz: a number or a column."""

    schema = T.StructType([*[signals.schema[c] for c in KEY], *(T.StructField(c, k) for c, k in (("k", T.ArrayType(T.IntegerType())), ("freq_hz", T.ArrayType(T.DoubleType())), ("magnitude_db", T.ArrayType(T.DoubleType())), ("phase_rad", T.ArrayType(T.DoubleType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            lengths = np.where(values.is_null(), 0, np.diff(values.offsets.to_numpy()))
            flat = values.flatten().to_numpy(zero_copy_only=False)
            first, rates = np.cumsum(lengths) - lengths, batch.column(3).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0]).tolist():  # signals of one length side by side
                rows = np.flatnonzero(lengths == n)
                used = min(size, n) if size else n
                w, m = window_values(window, used), 1 << (used - 1).bit_length()
                x = np.fft.rfft(flat[first[rows][:, None] + np.arange(used)] * w, m, axis=1)
                a = np.abs(x) / w.sum()
                a[:, 1 : a.shape[1] - (m > 1)] *= 2
                db = np.maximum(20 * np.log10(np.maximum(a, 1e-300)), -300)
                bins = a.shape[1]
                at = np.arange(0, bins * len(rows) + 1, bins, dtype=np.int32)
                k = np.tile(np.arange(bins, dtype=np.int32), len(rows))
                columns = [pa.ListArray.from_arrays(at, pa.array(c)) for c in (k, k * np.repeat(rates[rows] / m, bins), db.ravel(), np.angle(x).ravel())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *columns], schema.fieldNames())

    found = signals.select(*KEY, F.col("values").cast("array<double>").alias("values"), rate_column(rate_hz).alias("_rate")).mapInArrow(run, schema)
    return found.select(*KEY, F.inline(F.arrays_zip("k", "freq_hz", "magnitude_db", "phase_rad")))


def window_at(name: str, k: np.ndarray, n: int) -> np.ndarray:
    """The window of n samples at places k."""
    return sum((-1) ** i * a * np.cos(i * (2 * np.pi / n) * k) for i, a in enumerate(WINDOWS[name]))


def window_sum(name: str, n: int) -> float:
    """The cosines of a whole number of turns, of more samples than terms, add up to nothing."""
    return float(window_values(name, n).sum()) if n <= 8 else WINDOWS[name][0] * n


def in_whole_groups(df: DataFrame, by: list[str], function: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """function(table, first row of each group) over tables of many whole groups: for groups that are many and small, or a few long ones.

    Groups lie in order in a partition. Tables are as large as batches; only a group that is longer is put together of several.
    """

    def begins(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in by:
            code = pc.dictionary_encode(table.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of one group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ends = begins(table)[1:]
            if held and len(begins(pa.concat_tables([held[-1].slice(0, 1), table.slice(0, 1)]))) > 1:
                ends = np.append(0, ends)
            if len(ends):
                whole = pa.concat_tables([*held, table.slice(0, ends[-1])]).combine_chunks()
                held, table = [], table.slice(ends[-1])
                if whole.num_rows:
                    yield from function(whole, begins(whole))
            held.append(table)
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            yield from function(whole, begins(whole))

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def long_spectrum(samples: DataFrame, rate_hz: float | str, window: str = "hann", size: int = 0, columns: int = 256) -> DataFrame:
    """spectrum() of samples (idx without gaps), for signals of any length: no task holds a whole one.

    A transform of a * b points, a and b powers of two, is a matrix of a rows of b samples. Tasks take `columns` of its columns and
    transform them, times the turns that lead from columns to rows; one shuffle deals the results out by rows; tasks then
    transform rows, whose number k and place m are the point k + a * m.
    """
    keys = [samples.schema[c] for c in KEY]
    spans = samples.groupBy(*KEY).agg((F.max("idx") + 1).alias("_n"))
    used = F.least(F.lit(size), F.col("_n")) if size else F.col("_n")
    spans = spans.withColumn("_used", used.cast("long"))
    spans = spans.withColumn("_power", F.when(F.col("_used") > 1, F.length(F.bin(F.col("_used") - 1))).otherwise(0).cast("int"))
    spans = spans.withColumn("_b", F.expr("shiftleft(1L, _power - _power div 2)"))
    d = samples.withColumn("_rate", rate_column(rate_hz)).join(spans.drop("_n"), list(KEY)).where(F.col("idx") < F.col("_used"))
    d = d.select(*KEY, F.expr(f"(idx % _b) div {columns}").alias("_part"), "idx", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"), "_used", "_power", "_rate")
    middle = T.StructType([*keys, *(T.StructField(c, t) for c, t in (("_rows", T.LongType()), ("_part", T.LongType()), ("_used", T.LongType()), ("_power", T.IntegerType()), ("_rate", T.DoubleType()), ("cells", T.BinaryType())))])

    def by_columns(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        idx, value = table.column("idx").to_numpy(), table.column("value").to_numpy()
        part, used, power = (table.column(c).to_numpy()[first] for c in ("_part", "_used", "_power"))
        wide = np.minimum(columns, (1 << power.astype(np.int64) - power // 2) - part * columns)
        of = np.repeat(np.arange(len(first)), np.diff([*first, len(idx)]))
        for n, w in {*zip(power.tolist(), wide.tolist(), strict=True)}:  # parts of one shape side by side
            a, b, own = 1 << n // 2, 1 << n - n // 2, np.flatnonzero((power == n) & (wide == w))
            place = np.full(len(first), -1)
            place[own] = np.arange(len(own))
            rows = np.flatnonzero(place[of] >= 0)
            o, i = of[rows], idx[rows]
            x = np.zeros((len(own), a, w))
            x[place[o], i // b, i % b - part[o] * columns] = value[rows] * window_at(window, i, used[o])
            at = part[own, None] * columns + np.arange(w)
            turned = np.fft.fft(x, axis=1) * np.exp(-2j * np.pi / (1 << n) * (np.arange(a)[None, :, None] * at[:, None, :]))
            kept_ = table.take(pa.array(first[own])).select([*KEY, "_part", "_used", "_power", "_rate"])
            for r in range(0, a, columns):
                cells = pa.array([c.tobytes() for c in turned[:, r : r + columns]], pa.binary())
                made = kept_.append_column("_rows", pa.array([r // columns] * len(own), pa.int64())).append_column("cells", cells)
                yield from made.select(middle.fieldNames()).to_batches()

    out = T.StructType([*keys, *(T.StructField(c, t) for c, t in (("k", T.IntegerType()), ("freq_hz", T.DoubleType()), ("magnitude_db", T.DoubleType()), ("phase_rad", T.DoubleType())))])

    def by_rows(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        part, cells = table.column("_part").to_numpy(), table.column("cells")
        used, power, rows, rate = (table.column(c).to_numpy()[first] for c in ("_used", "_power", "_rows", "_rate"))
        tall, ends = np.minimum(columns, (1 << power.astype(np.int64) // 2) - rows * columns), [*first[1:], len(part)]
        for n, t in {*zip(power.tolist(), tall.tolist(), strict=True)}:
            a, b, own = 1 << n // 2, 1 << n - n // 2, np.flatnonzero((power == n) & (tall == t))
            x = np.zeros((len(own), t, b), complex)
            for i, g in enumerate(own):
                for j in range(first[g], ends[g]):
                    block = np.frombuffer(cells[j].as_buffer(), complex).reshape(t, -1)
                    x[i, :, part[j] * columns : part[j] * columns + block.shape[1]] = block
            x = np.fft.fft(x, axis=2)
            k = (rows[own, None] * columns + np.arange(t))[:, :, None] + a * np.arange(b)
            half = k <= (1 << n) // 2
            of, x, k = own[np.nonzero(half)[0]], x[half], k[half]
            size_db = np.abs(x) / np.array([window_sum(window, u) for u in used.tolist()])[of]
            size_db[(k > 0) & (k < (1 << n) / 2)] *= 2
            db = np.maximum(20 * np.log10(np.maximum(size_db, 1e-300)), -300)
            found = table.select(list(KEY)).take(pa.array(first[of]))
            for name, c in (("k", pa.array(k, pa.int32())), ("freq_hz", pa.array(k * (rate[of] / (1 << n)))), ("magnitude_db", pa.array(db)), ("phase_rad", pa.array(np.angle(x)))):
                found = found.append_column(name, c)
            yield from found.to_batches()

    turned = in_whole_groups(d, [*KEY, "_part"], by_columns, middle)
    return in_whole_groups(turned, [*KEY, "_rows"], by_rows, out)


def spectrum_metrics(spectra: DataFrame) -> DataFrame:
    """peak_hz, peak_db, peak_phase_rad and fft_size of each signal's spectrum; of equal peaks the lowest."""
    best = F.max_by(F.struct("freq_hz", "magnitude_db", "phase_rad"), F.struct("magnitude_db", (-F.col("k")).alias("k")))
    out = spectra.groupBy(*KEY).agg(best.alias("b"), F.max("k").alias("top"))
    return out.select(*KEY, F.col("b.freq_hz").alias("peak_hz"), F.col("b.magnitude_db").alias("peak_db"), F.col("b.phase_rad").alias("peak_phase_rad"), F.greatest(F.col("top") * 2, F.lit(1)).alias("fft_size"))


def threshold(samples: DataFrame, level: float, hysteresis: float = 0.0, min_width_s: float = 0.0, period_s: float | str | DataFrame | None = None, falling: bool = False) -> DataFrame:
    """Detections: start_s, end_s and peak of each stay at or past `level`, left past level less hysteresis; NaN ends one.

    period_s: what the last sample lasts, a number, a column with each signal's own (null: nothing) or a table of the signals
    (group_id, signal_id, period_s) that counts for those alone. Samples aren't shuffled, unless for such a column; a long
    signal is read by many tasks (see stretches.stays).
    """
    s = -1.0 if falling else 1.0

    def decide(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = values * s
        with np.errstate(invalid="ignore"):
            out = np.where(v < s * level if hysteresis == 0 else v <= s * level - hysteresis, 0, -1)
            out[v >= s * level] = 1
        out[np.isnan(v)] = 0
        return v, out

    found = stays(by_stretch(samples, KEY, ["t_s", "value"], runs_of(decide), RUNS), KEY)
    if isinstance(period_s, str):
        period_s = samples.groupBy(*KEY).agg(F.first(period_s).alias("period_s"))
    if isinstance(period_s, DataFrame):
        found = found.join(period_s.select(*KEY, F.col("period_s").alias("_p")), list(KEY)).withColumn("end_s", F.col("end_s") + F.coalesce("_p", F.lit(0.0))).drop("_p")
    elif period_s is not None:
        found = found.withColumn("end_s", F.col("end_s") + period_s)
    return found.withColumn("peak", F.col("peak") * s).where(F.col("end_s") - F.col("start_s") + 1e-12 >= min_width_s)


def slice_levels(samples: DataFrame, level: float, hysteresis: float = 0.0, invert: bool = False, block: int = 1 << 16) -> DataFrame:
    """samples with bit: 1 above the band around level, 0 below it, as before inside it; 0 at first; NaN holds.

    A block of `block` indexes holds its own last decision, or that of the nearest block before it that has one; so a long
    signal is read by many tasks.
    """
    v, by = F.col("value"), [*KEY, "_block"]
    raw = F.when(F.isnan(v), None).when(v > level + hysteresis / 2, 1).when(v < level - hysteresis / 2, 0)
    d = samples.withColumns({"_block": F.floor(F.col("idx") / block), "_raw": raw})
    last = d.groupBy(*by).agg(F.max_by("_raw", F.when(F.col("_raw").isNotNull(), F.col("idx"))).alias("_last"))
    before = last.select(*by, F.last("_last", ignorenulls=True).over(W.partitionBy(*KEY).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_in"))
    own = F.last("_raw", ignorenulls=True).over(W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_own", own).join(before, by)
    bit = F.coalesce("_own", "_in", F.lit(0))
    return d.withColumn("bit", (1 - bit) if invert else bit).drop("_block", "_raw", "_own", "_in")


def slice_metrics(sliced: DataFrame) -> DataFrame:
    d = sliced.withColumn("_before", F.lag("bit").over(by_signal()))
    return d.groupBy(*KEY).agg(F.count_if(F.col("_before") != F.col("bit")).alias("transitions"), F.avg("bit").alias("duty"))


def symbols(samples: DataFrame, symbol_rate_hz: float, rate_hz: float | str, nominals: list[float], phase: float = 0.5, align: str = "start") -> DataFrame:
    """symbol and margin at each symbol's instant; boundaries lie midway between nominal levels. rate_hz: a number or a column."""
    if not isinstance(rate_hz, str) and symbol_rate_hz > rate_hz:
        raise ValueError("symbol_rate_hz: not above the sample rate")
    bounds = [(a + b) / 2 for a, b in zip(nominals, nominals[1:], strict=False)]
    ratio, start = F.col("_ratio"), F.lit(0.0)
    s = samples.withColumn("_ratio", rate_column(rate_hz) / symbol_rate_hz)
    if align == "first-edge":
        mid = bounds[len(bounds) // 2]
        high = F.col("value") >= mid
        edge = s.withColumn("_e", high != F.lag(high).over(by_signal())).groupBy(*KEY).agg(F.min(F.when(F.col("_e"), F.col("idx"))).alias("_edge"))
        s, start = s.join(edge, list(KEY)), F.coalesce(F.col("_edge") % ratio, F.lit(0.0))
    k = F.ceil((F.col("idx") - start) / ratio - phase).cast("long")
    s = s.withColumn("k", k).where((F.col("k") >= 0) & (F.floor(start + (F.col("k") + phase) * ratio) == F.col("idx")) & finite(F.col("value")))
    symbol, margin = F.lit(0), F.lit(float("inf"))
    for b in bounds:
        symbol, margin = symbol + (F.col("value") > b).cast("int"), F.least(margin, F.abs(F.col("value") - b))
    return s.select(*KEY, "k", "t_s", symbol.alias("symbol"), margin.alias("margin"))


def pack_bits(symbols_: DataFrame, width: int = 8, bits_per_symbol: int = 1, msb_first: bool = True, invert: bool = False) -> DataFrame:
    """word, value, hex and bits: symbols' bits, or their opposites, in words of `width`; a short last word is right-justified."""
    bits = symbols_.select(*KEY, "k", F.greatest("symbol", F.lit(0)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(bits_per_symbol - 1))).alias("b"))
    bits = bits.select(*KEY, (F.col("k") * bits_per_symbol + F.col("b")).alias("at"), F.expr(f"(s >> ({bits_per_symbol - 1} - b)) & 1").alias("bit")).withColumn("bit", 1 - F.col("bit") if invert else F.col("bit")).withColumn("word", F.floor(F.col("at") / width))
    n = F.count("*").over(W.partitionBy(*KEY, "word"))
    place = F.col("at") % width
    shift = (n - 1 - place) if msb_first else place
    bits = bits.withColumn("part", F.col("bit") * F.pow(F.lit(2.0), shift).cast("long"))
    out = bits.groupBy(*KEY, "word").agg(F.sum("part").alias("value"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda x: x["bit"].cast("string")), "").alias("bits"))
    return out.withColumn("hex", F.lpad(F.lower(F.hex("value")), -(-width // 4), "0"))


def pulse_properties(metrics: DataFrame) -> DataFrame:
    """group_id, key and value of the properties prf_hz and duty that pulse_metrics() writes back, where it has them."""
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("prf_hz", "duty")]))
    return metrics.select("group_id", p.alias("p")).select("group_id", "p.*").where("value IS NOT NULL")


def longest_signal(samples: DataFrame, rate_hz: float | str) -> DataFrame:
    """group_id and duration_s of each group's longest signal; rate_hz: a number or a column, null for irregular signals, which span their times."""
    each = samples.withColumn("_rate", rate_column(rate_hz)).groupBy(*KEY).agg(F.coalesce((F.max("idx") + 1) / F.first("_rate"), F.max("t_s") - F.min("t_s")).alias("d"))
    return each.groupBy("group_id").agg(F.max("d").alias("duration_s"))


def pulse_metrics(detections: DataFrame, duration_s: float | DataFrame) -> DataFrame:
    """Per group: pulses, widths, intervals between starts within a signal, rate, duty and the highest peak.

    duration_s: that of the groups' longest signals, a number or a table as longest_signal() gives it; then groups without
    detections have pulses 0 and nothing else.
    """
    if isinstance(duration_s, DataFrame):
        out = pulse_metrics(detections, 1.0)
        out = duration_s.select("group_id", F.col("duration_s").alias("_d")).join(out, "group_id", "left")
        return out.withColumns({"pulses": F.coalesce("pulses", F.lit(0)), "duty": F.col("duty") / F.col("_d")}).drop("_d")
    d = detections.withColumn("width", F.col("end_s") - F.col("start_s")).withColumn("pri", F.col("start_s") - F.lag("start_s").over(W.partitionBy(*KEY).orderBy("start_s")))
    out = d.groupBy("group_id").agg(F.count("*").alias("pulses"), F.avg("width").alias("width_mean"), F.min("width").alias("width_min"), F.max("width").alias("width_max"), F.stddev_samp("width").alias("width_jitter"), F.avg("pri").alias("pri_mean"), F.stddev_samp("pri").alias("pri_jitter"), (F.sum("width") / duration_s).alias("duty"), F.max("peak").alias("peak_max"))
    return out.withColumn("prf_hz", 1 / F.col("pri_mean"))


def peaks(signals: DataFrame, rate_hz: float | str, min_prominence: float = 0.0, min_distance_s: float = 0.0, max_count: int | None = None, falling: bool = False, window_s: float | None = None) -> DataFrame:
    """time_s, amplitude and prominence of each signal's peaks (values as arrays), by time.

    A plateau is one peak at its middle; ends are none; NaN never rises. Prominence is the height over the higher of
    the lowest grounds on the way to higher ground or an end, found with a stack in one pass each way. Of peaks nearer than
    min_distance_s the higher stays. falling: dips, with their depth as prominence. window_s: only so much of the signal on
    either side of a peak counts for its prominence. rate_hz: a number or a column; without a rate (null) the column times,
    if there is one, has the samples' times, and neither distance nor window hold.
    """
    sign = -1.0 if falling else 1.0

    def near(v: np.ndarray, i: int, reach: int) -> float:
        """The lowest ground on the left, up to higher ground or `reach` places."""
        x = v[max(0, i - reach) : i + 1][::-1]
        higher = np.flatnonzero(x > x[0])
        return float(x[: higher[0] if len(higher) else len(x)].min())

    def ground(v: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(v)), []
        for i, x in enumerate(v):
            low = x
            while stack and stack[-1][0] <= x:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((x, low))
        return out

    @F.pandas_udf("array<struct<time_s:double,amplitude:double,prominence:double>>")
    def run(column: pd.Series, rates: pd.Series, times: pd.Series) -> pd.Series:
        def one(values, rate, own):
            rate = None if rate is None or np.isnan(rate) else rate
            reach = None if window_s is None or rate is None else max(1, math.floor(window_s * rate + 0.5))
            v = np.array([np.nan if x is None else x for x in values], float) * sign
            v = np.where(np.isnan(v), -np.inf, v)
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            end = np.append(start[1:], len(v)) - 1
            top = [(a + b) // 2 for a, b in zip(start, end, strict=True) if a > 0 and b < len(v) - 1 and v[a - 1] < v[a] and v[b + 1] < v[b]]
            if reach is None:
                left, right = ground(v), ground(v[::-1])[::-1]
                found = [(i, v[i], v[i] - max(left[i], right[i])) for i in top]
            else:
                found = [(i, v[i], v[i] - max(near(v, i, reach), near(v[::-1], len(v) - 1 - i, reach))) for i in top]
            apart, chosen = 0 if rate is None else math.ceil(min_distance_s * rate), []
            for p in sorted((p for p in found if p[2] >= min_prominence), key=lambda p: (-p[1], p[0])):
                if max_count is not None and len(chosen) == max_count:
                    break
                if all(abs(p[0] - c[0]) >= apart for c in chosen):
                    chosen.append(p)
            return [{"time_s": float(own[i]) if own is not None else i / rate, "amplitude": float(a * sign), "prominence": float(h)} for i, a, h in sorted(chosen)]

        return pd.Series([[] if v is None or len(v) == 0 else one(v, r, t) for v, r, t in zip(column, rates, times, strict=True)], dtype=object)

    times = F.col("times") if "times" in signals.columns else F.lit(None).cast("array<double>")
    return signals.select(*KEY, F.explode(run("values", rate_column(rate_hz), times)).alias("p")).select(*KEY, "p.*")


def resample(samples: DataFrame, from_hz: float, to_hz: float) -> DataFrame:
    """Linear interpolation at to_hz, between each sample and the next; nothing after the last sample."""
    d = samples.withColumn("_next", F.lead("value").over(by_signal()))
    ratio = to_hz / from_hz
    first = F.ceil(F.col("idx") * ratio).cast("long")
    last = F.when(F.col("_next").isNull(), F.floor(F.col("idx") * ratio)).otherwise(F.ceil((F.col("idx") + 1) * ratio) - 1).cast("long")
    d = d.where(first <= last).select(*KEY, "idx", "value", "_next", F.explode(F.sequence(first, last)).alias("k"))
    share = F.col("k") / ratio - F.col("idx")
    return d.select(*KEY, F.col("k").alias("idx"), (F.col("k") / to_hz).alias("t_s"), F.coalesce(F.col("value") + (F.col("_next") - F.col("value")) * share, "value").alias("value"))


def uniform(key, idx, stream: int):
    """A number in [0, 1) drawn from a key and an index by MD5, the same on any partitioning and in any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), idx.cast("string"), F.lit(str(stream))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def add_noise(samples: DataFrame, snr_db: float, seed: int = 1) -> DataFrame:
    """Gaussian noise added to each signal at snr_db, both powers measured over the whole signal; silence stays silent."""
    u, x = uniform(F.col("signal_id"), F.col("idx"), 2 * seed), uniform(F.col("signal_id"), F.col("idx"), 2 * seed + 1)
    noisy = samples.withColumn("_n", F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * x))
    w = whole_signal()
    power, drawn = (F.avg(F.col(c) * F.col(c)).over(w) for c in ("value", "_n"))
    scale = F.when(power > 0, F.sqrt(power / math.pow(10, snr_db / 10) / drawn)).otherwise(0.0)
    return noisy.withColumn("value", F.col("value") + scale * F.col("_n")).drop("_n")


def envelope_tukey(samples: DataFrame, duration_s: float, taper: float) -> DataFrame:
    """Each signal times a window that rises and falls as a cosine over `taper` of its duration."""
    edge = duration_s * taper / 2
    t = F.least(F.col("t_s"), duration_s - F.col("t_s"))
    return samples.withColumn("value", F.col("value") * F.when(t >= edge, 1.0).otherwise(0.5 * (1 - F.cos(math.pi * F.greatest(t, F.lit(0.0)) / edge))))


def modulate_am(samples: DataFrame, carrier_hz: float, depth: float) -> DataFrame:
    return samples.withColumn("value", F.sin(2 * math.pi * carrier_hz * F.col("t_s")) * (1 + depth * F.col("value")))
