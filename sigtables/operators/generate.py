"""Synthetic sources: samples and pulses that are functions of a table of specs and the index, the same on any partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.model import spread
from sigtables.operators.stages import by_signal, uniform


def grid(specs: DataFrame, rate_hz: float, duration_s: float) -> DataFrame:
    """Each spec's row once for each sample, with idx and t_s. Specs are dealt out first: a few bytes of them make many samples."""
    n = round(duration_s * rate_hz)
    if n < 1:
        raise ValueError("duration_s: at least one sample")
    d = spread(specs).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return d.withColumn("t_s", F.col("idx") / rate_hz)


def tone(shape: str, freq_hz: Column, t: Column, phase_rad: float = 0.0, duty: float = 0.5) -> Column:
    """A sine, square, triangle or sawtooth wave of amplitude 1."""
    cycles = freq_hz * t + phase_rad / (2 * math.pi)
    r = cycles - F.floor(cycles)
    if shape == "sine":
        return F.sin(2 * math.pi * r)
    if shape == "square":
        return F.when(r < duty, 1.0).otherwise(-1.0)
    if shape == "triangle":
        return F.asin(F.sin(2 * math.pi * r)) * (2 / math.pi)
    if shape == "sawtooth":
        return 2 * r - 1
    raise ValueError("shape: sine, square, triangle or sawtooth")


def trapezoid(t: Column, period_s: float, rise_s: float, flat_s: float, fall_s: float) -> Column:
    """A pulse that rises, stays and falls within each period; 0 between pulses."""
    if rise_s + flat_s + fall_s > period_s:
        raise ValueError("period_s: not shorter than its pulse")
    r = t - F.floor(t / period_s) * period_s
    falling = 1 - (r - rise_s - flat_s) / fall_s if fall_s else F.lit(0.0)
    rising = r / rise_s if rise_s else F.lit(1.0)
    return F.when(r < rise_s, rising).when(r < rise_s + flat_s, 1.0).when(r < rise_s + flat_s + fall_s, falling).otherwise(0.0)


def chirp(t: Column, f0_hz: Column, f1_hz: Column, duration_s: float, law: str = "linear") -> Column:
    """A sine whose frequency goes from f0 to f1 over the duration, by the closed form of its phase."""
    if law == "linear":
        cycles = f0_hz * t + (f1_hz - f0_hz) * t * t / (2 * duration_s)
    elif law == "quadratic":
        cycles = f0_hz * t + (f1_hz - f0_hz) * t * t * t / (3 * duration_s**2)
    elif law == "log":
        ratio = F.log(f1_hz / f0_hz)
        cycles = F.when(ratio == 0, f0_hz * t).otherwise(f0_hz * duration_s / ratio * (F.exp(ratio * t / duration_s) - 1))
    else:
        raise ValueError("law: linear, quadratic or log")
    return F.sin(2 * math.pi * cycles)


def basic(shape: str, t: Column, level: Column, at_s: float = 0.0) -> Column:
    """dc, a ramp of slope `level`, or a step from 0 to `level` at at_s."""
    if shape == "dc":
        return level
    if shape == "ramp":
        return level * t
    if shape == "step":
        return F.when(t < at_s, 0.0).otherwise(level)
    raise ValueError("shape: dc, ramp or step")


def gaussian(key: Column, idx: Column, seed: int = 1) -> Column:
    """A standard normal number drawn from a key and an index."""
    return F.sqrt(-2 * F.log(1 - uniform(key, idx, 2 * seed))) * F.cos(2 * math.pi * uniform(key, idx, 2 * seed + 1))


def coloured(key: Column, idx: Column, colour: str = "pink", octaves: int = 16, seed: int = 1) -> Column:
    """Pink or brown noise of power 1: a sum of normal numbers, each held for 1, 2, 4 and so on samples, weighted alike or by octave."""
    if colour not in ("pink", "brown"):
        raise ValueError("colour: pink or brown")
    weights = [1.0 if colour == "pink" else 2.0**o for o in range(octaves)]
    total = F.lit(0.0)
    for o, w in enumerate(weights):
        total = total + w * gaussian(key, F.shiftright(idx, o), seed + o)
    return total / math.sqrt(sum(w * w for w in weights))


def modulate_pm(samples: DataFrame, carrier_hz: float, deviation_rad: float) -> DataFrame:
    return samples.withColumn("value", F.sin(2 * math.pi * carrier_hz * F.col("t_s") + deviation_rad * F.col("value")))


def modulate_fm(samples: DataFrame, carrier_hz: float, deviation_hz: float, rate_hz: float) -> DataFrame:
    """A carrier whose phase gains the running sum of the signal over the sample rate, without the sample itself."""
    before = F.coalesce(F.sum("value").over(by_signal().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / rate_hz
    return samples.withColumn("value", F.sin(2 * math.pi * (carrier_hz * F.col("t_s") + deviation_hz * before)))


def delay(samples: DataFrame, by: int) -> DataFrame:
    """Each signal later by whole samples, 0 before its first."""
    if by < 0:
        raise ValueError("by: not negative")
    return samples.withColumn("value", F.coalesce(F.lag("value", by).over(by_signal()), F.lit(0.0)) if by else F.col("value"))


def clip(samples: DataFrame, lo: float, hi: float) -> DataFrame:
    return samples.withColumn("value", F.when(F.isnan("value"), F.col("value")).otherwise(F.least(F.greatest("value", F.lit(lo)), F.lit(hi))))


def pulse_train(specs: DataFrame, count: int, intervals_s: Sequence[float], drift_s: float = 0.0, jitter_s: float = 0.0) -> DataFrame:
    """specs (group_id) with pulse_idx and toa_s of `count` pulses each.

    Intervals repeat in turn (one: fixed, several: stagger); each next interval is longer by drift_s; jitter moves a pulse
    by up to jitter_s either way and doesn't add up. All is closed in the index.
    """
    if count < 1 or not intervals_s or min(intervals_s) <= 0:
        raise ValueError("count and intervals_s: positive")
    n, sums = len(intervals_s), [sum(intervals_s[:k]) for k in range(len(intervals_s))]
    i = F.col("pulse_idx")
    start = F.floor(i / n) * sum(intervals_s) + F.element_at(F.array(*map(F.lit, sums)), (i % n + 1).cast("int")) + drift_s * i * (i - 1) / 2
    out = spread(specs).withColumn("pulse_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return out.withColumn("toa_s", start + jitter_s * (2 * uniform(F.col("group_id"), i, 7) - 1) if jitter_s else start)


def impulse(idx: Column, level: Column, at_s: float, rate_hz: float) -> Column:
    """`level` on the sample nearest to at_s, 0 elsewhere."""
    return F.when(idx == math.floor(at_s * rate_hz + 0.5), level).otherwise(0.0)


def uniform_noise(key: Column, idx: Column, lo: float = -1.0, hi: float = 1.0, seed: int = 1) -> Column:
    return lo + (hi - lo) * uniform(key, idx, 2 * seed)


def total(terms: Sequence[Column]) -> Column:
    """The sum of sources on one grid; 0 for none."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def product(terms: Sequence[Column]) -> Column:
    """The product of sources on one grid; 1 for none."""
    return reduce(lambda a, b: a * b, terms, F.lit(1.0))


def concat(idx: Column, rate_hz: float, parts: Sequence[tuple[Callable[[Column, Column], Column], float]]) -> Column:
    """Sources one after the other, each a function of its own index and time and a duration; 0 after the last.

    Parts begin on samples: where the durations before, rounded to samples, end.
    """
    out, begin_s = None, 0.0
    for source, duration_s in parts:
        first, begin_s = math.floor(begin_s * rate_hz + 0.5), begin_s + max(duration_s, 0.0)
        last = math.floor(begin_s * rate_hz + 0.5)
        own = idx - first
        inside = (idx >= first) & (idx < last)
        out = (F if out is None else out).when(inside, source(own, own / rate_hz))
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def envelope(t: Column, shape: str, duration_s: float, attack_s: float = 0.0, decay_s: float = 0.0, sustain: float = 1.0, release_s: float = 0.0, centre_s: float = 0.0, sigma_s: float = 0.0) -> Column:
    """The gain at t of an adsr (attack, decay, sustain, release) or gaussian envelope; stages.envelope_tukey has the third kind."""
    if shape == "gaussian":
        z = (t - centre_s) / sigma_s if sigma_s > 0 else None
        return F.lit(0.0) if z is None else F.exp(-0.5 * z * z)
    if shape != "adsr":
        raise ValueError("shape: adsr or gaussian")
    release_at = max(duration_s - release_s, 0.0)
    out = F.when(t < 0, 0.0)
    if attack_s > 0:
        out = out.when(t < attack_s, t / attack_s)
    if decay_s > 0:
        out = out.when(t < attack_s + decay_s, 1.0 + (sustain - 1.0) * (t - attack_s) / decay_s)
    out = out.when(t < release_at, sustain)
    if release_s > 0:
        out = out.when(t < duration_s, sustain * (1.0 - (t - release_at) / release_s))
    return out.otherwise(0.0)


#: Exponents of a primitive polynomial of each order (with x^order and 1 they make the whole of it).
PRBS_EXPONENTS: dict[int, tuple[int, ...]] = {
    2: (1,), 3: (2,), 4: (3,), 5: (3,), 6: (5,), 7: (6,), 8: (6, 5, 4), 9: (5,), 10: (7,), 11: (9,), 12: (6, 4, 1), 13: (4, 3, 1),
    14: (5, 3, 1), 15: (14,), 16: (15, 13, 4), 17: (14,), 18: (11,), 19: (6, 2, 1), 20: (17,), 21: (19,), 22: (21,), 23: (18,),
    24: (23, 22, 17), 25: (22,), 26: (6, 2, 1), 27: (5, 2, 1), 28: (25,), 29: (27,), 30: (6, 4, 1), 31: (28,), 32: (22, 2, 1),
}


def prbs_lags(order: int, taps: int | None = None) -> list[int]:
    """The bit at i + order is the parity of the bits at i + lag: the tapped places of the register, the bit that goes out first."""
    if not 2 <= order <= 32:
        raise ValueError("order: 2 to 32")
    mask = (taps or 0) & ((1 << order) - 1) or sum(1 << (order - e) for e in (order, *PRBS_EXPONENTS[order]))
    return [i for i in range(order) if mask >> i & 1]


def _after(order: int, lags: list[int], steps: int) -> list[int]:
    """The bits of the register that began with ones, `steps` later: x^steps modulo the polynomial, by squaring."""
    low = sum(1 << i for i in lags)

    def reduced(p: int) -> int:
        while (d := p.bit_length() - 1) >= order:
            p ^= (1 << d) | low << (d - order)
        return p

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a * (b & 1)
            a, b = a << 1, b >> 1
        return reduced(out)

    power, square = 1, reduced(2)
    while steps:
        if steps & 1:
            power = times(power, square)
        square, steps = times(square, square), steps >> 1
    bits = []
    for _ in range(order):  # the bit at n is the parity of the first bits, all ones, that x^n names
        bits.append(power.bit_count() & 1)
        power = reduced(power << 1)
    return bits


def prbs_block(order: int, lags: list[int], start: int, n: int) -> np.ndarray:
    """n bits from the index `start` on. The recurrence also holds at twice its lags, so ever longer stretches come at once."""
    bits = np.zeros(max(n, order), np.uint8)
    bits[:order] = _after(order, lags, start)
    have, k = order, 1
    while have < n:
        while 2 * k * order <= have:
            k *= 2
        m = min(k * (order - lags[-1]), n - have)
        first = have - k * order
        bits[have : have + m] = np.bitwise_xor.reduce([bits[first + k * lag : first + k * lag + m] for lag in lags])
        have += m
    return bits[:n]


def prbs(specs: DataFrame, order: int, samples: int, rate_hz: float, taps: int | None = None, amplitude: float = 1.0, block: int = 1 << 14) -> DataFrame:
    """specs with idx, t_s and value: a maximal-length bit sequence, a bit a sample, as plus or minus `amplitude`.

    Blocks of samples are made apart from each other: a block's register comes from a jump, so tasks share nothing.
    """
    lags = prbs_lags(order, taps)
    blocks = spread(specs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((samples - 1) // block).cast("long")))))

    @F.pandas_udf("array<double>")
    def bits(column: pd.Series) -> pd.Series:
        made = {b: (prbs_block(order, lags, b * block, min(block, samples - b * block)) * 2.0 - 1) * amplitude for b in set(column)}
        return column.map(made)

    out = blocks.select("*", F.posexplode(bits("_block")).alias("_at", "value")).withColumn("idx", F.col("_block") * block + F.col("_at"))
    return out.withColumn("t_s", F.col("idx") / rate_hz).drop("_block", "_at")


#: Rungs of one sweep at most.
MOST_RUNGS = 4096


def rungs(values: Sequence[float] | None = None, start: float = 0.0, stop: float = 0.0, step: float = 1.0) -> list[float]:
    """The values of a sweep: a list, or from start to stop with both ends, counted before they are made."""
    if values is not None:
        out = [float(v) for v in values]
        if not out or not all(map(math.isfinite, out)):
            raise ValueError("values: finite numbers, one at least")
    else:
        if not all(map(math.isfinite, (start, stop, step))) or step == 0 or (stop - start) * step < 0:
            raise ValueError("step: finite, not 0, towards stop")
        n = math.floor(abs(stop - start) / abs(step)) + 1
        out = [start + step * i for i in range(min(n, MOST_RUNGS + 1))]
    if len(out) > MOST_RUNGS:
        raise ValueError(f"values: {MOST_RUNGS} at most")
    return out


def sweep(samples: DataFrame, param: str, values: Sequence[float], layout: str = "one-group", whole: bool = False) -> DataFrame:
    """Each row once for each rung, with columns rung and `param`, its value, rounded if it is to be whole.

    layout one-group keeps group_id and numbers signals signal_id * rungs + rung; group-per-rung makes the rung the group_id.
    """
    if layout not in ("one-group", "group-per-rung"):
        raise ValueError("layout: one-group or group-per-rung")
    table = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(float(math.floor(v + 0.5)) if whole else v).alias("v")) for i, v in enumerate(values)])
    out = samples.withColumn("_r", F.explode(table)).withColumns({"rung": F.col("_r.rung"), param: F.col("_r.v")}).drop("_r")
    if layout == "one-group":
        return out.withColumn("signal_id", F.col("signal_id") * len(values) + F.col("rung"))
    return out.withColumn("group_id", F.col("rung").cast("long"))


def train_field(kind: str, index: Column, pulses: int, key: Column | None = None, seed: int = 1, **p: float | Sequence[float]) -> Column:
    """A field's value of a pulse by its index over the whole train of `pulses`.

    constant(value), uniform(lo, hi), gaussian(mean, sigma), ramp(start, end), sequence(values) or scan(mean, amp, period_pulses).
    """
    key = F.lit("train") if key is None else key
    if kind == "constant":
        return F.lit(float(p["value"]))
    if kind == "uniform":
        return uniform_noise(key, index, p["lo"], p["hi"], seed)
    if kind == "gaussian":
        return p["mean"] + p["sigma"] * gaussian(key, index, seed)
    if kind == "ramp":
        return F.lit(float(p["start"])) if pulses <= 1 else p["start"] + (p["end"] - p["start"]) * index / (pulses - 1)
    if kind == "sequence":
        values = list(p["values"])
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index % len(values) + 1).cast("int")) if values else F.lit(float("nan"))
    if kind == "scan":
        return F.lit(float(p["mean"])) if p["period_pulses"] <= 0 else p["mean"] + p["amp"] * F.sin(2 * math.pi * index / p["period_pulses"])
    raise ValueError("kind: constant, uniform, gaussian, ramp, sequence or scan")


def align(sources: DataFrame, rate_hz: float, n: int, t0_s: float = 0.0) -> DataFrame:
    """Each signal on the grid t0_s + i / rate_hz, i < n, by absolute time: linear between its samples, 0 outside of them.

    sources may be irregular; rows with a null or NaN time are left out. Each pair of neighbouring samples gives the grid points from the first
    up to the second, so a signal is read once and never joined with the grid's times.
    """
    s = sources.where(F.col("t_s").isNotNull() & ~F.isnan("t_s"))
    at = W.partitionBy("group_id", "signal_id").orderBy("t_s", "idx")
    s = s.withColumns({"_t": F.lead("t_s").over(at), "_v": F.lead("value").over(at)})
    place = lambda t: (t - t0_s) * rate_hz
    first = F.greatest(F.ceil(place(F.col("t_s"))), F.lit(0)).cast("long")
    last = F.least(F.coalesce(F.ceil(place(F.col("_t"))) - 1, F.floor(place(F.col("t_s")))), F.lit(n - 1)).cast("long")
    d = s.where(first <= last).select("group_id", "signal_id", "t_s", "value", "_t", "_v", F.explode(F.sequence(first, last)).alias("idx"))
    share = (t0_s + F.col("idx") / rate_hz - F.col("t_s")) / (F.col("_t") - F.col("t_s"))
    inside = d.select("group_id", "signal_id", "idx", F.coalesce(F.col("value") + (F.col("_v") - F.col("value")) * share, "value").alias("value"))
    grid_ = sources.select("group_id", "signal_id").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("idx"))
    return grid_.join(inside, ["group_id", "signal_id", "idx"], "left").select("group_id", "signal_id", "idx", (t0_s + F.col("idx") / rate_hz).alias("t_s"), F.coalesce("value", F.lit(0.0)).alias("value"))
