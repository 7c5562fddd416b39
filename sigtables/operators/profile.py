"""Aggregates over signals: summaries, histograms, crossings, pyramids and viewport cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.functions.scalars import finite
from sigtables.model import placed
from sigtables.operators.stretches import by_stretch, changes

#: Samples in a cell of pyramid level 0.
BASE = 64


def summarise(samples: DataFrame, *by: str) -> DataFrame:
    """count, non_finite, min, max, mean, rms, peak_to_peak, variance and std of the finite values; nulls where there are none."""
    v = F.when(finite(F.col("value")), F.col("value"))
    out = samples.groupBy(*by).agg(F.count(v).alias("count"), F.count_if(~finite(F.col("value"))).alias("non_finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.greatest(F.var_pop(v), F.lit(0.0)).alias("variance"))
    return out.withColumns({"peak_to_peak": F.coalesce(F.col("max") - F.col("min"), F.lit(0.0)), "std": F.sqrt("variance")})


def histogram(samples: DataFrame, bins: int, lo: float, hi: float, *by: str) -> DataFrame:
    """n of each bin from lo to hi, hi included; bin -1 is below, `bins` above, null not finite. Bins without a value have no row."""
    if not (math.isfinite(lo) and math.isfinite(hi)):
        lo, hi = -0.5, 0.5
    elif not lo < hi:
        lo, hi = min(lo, hi) - 0.5, max(lo, hi) + 0.5
    v = F.col("value")
    k = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return samples.withColumn("bin", F.when(~finite(v), None).when(v < lo, -1).when(v > hi, bins).otherwise(k).cast("long")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def zero_crossings(samples: DataFrame, *by: str) -> DataFrame:
    """Sign changes between neighbouring finite values that are not zero: those inside stretches, and those from one stretch to the next."""
    d = by_stretch(samples, by, ["value"], changes, "n long, begins byte, ends byte")
    before = F.last("ends", ignorenulls=True).over(W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_before", before).where("begins IS NOT NULL")
    return d.groupBy(*by).agg((F.sum("n") + F.count_if(F.col("_before") != F.col("begins"))).alias("crossings"))


def pyramid(samples: DataFrame, base: int, levels: int | None, *by: str) -> DataFrame:
    """level, cell, low and high: level 0 has cells of `base` samples, each next level half as many; levels None: up to one cell.

    Samples are aggregated once, to the cells of level 0. Each of those then counts for its cell on every level, in one more
    aggregation: two shuffles, the second of a base-th of the rows, however many levels there are.
    """
    v = F.when(finite(F.col("value")), F.col("value"))
    return rolled_up(samples.groupBy(*by, F.floor(F.col("idx") / base).alias("cell")).agg(F.min(v).alias("low"), F.max(v).alias("high")), levels, *by)


def rolled_up(cells: DataFrame, levels: int | None, *by: str) -> DataFrame:
    """A pyramid of level 0's cells (cell, low, high), as a stream writes them too."""
    if levels is None:
        last = F.max("cell").over(W.partitionBy(*by))
        top = F.when(last > 0, F.floor(F.log2(last)).cast("int") + 1).otherwise(0)
    else:
        top = F.lit(levels - 1)
    cells = cells.withColumn("_top", top).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top")))).drop("_top")
    at = F.expr("shiftright(cell, level)")
    return cells.groupBy(*by, "level", at.alias("cell")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def level_for(samples_per_pixel: float, levels: int) -> int | None:
    """The pyramid level to draw from; None: raw samples."""
    if samples_per_pixel < BASE:
        return None
    return max(0, min(levels - 1, int(samples_per_pixel).bit_length() - 1 - 6))


def viewport(samples: DataFrame, t0: float, t1: float, width: int, *by: str, gain: float = 1.0, offset: float = 0.0, shift: float = 0.0, rate_hz: float | None = None) -> DataFrame:
    """low and high of each pixel column of a view from t0 to t1, of signals moved by `shift` seconds; a negative gain swaps them.

    With a sample rate of less than a sample a pixel the raw points are returned instead: px, low and high of each.
    """
    v = F.when(finite(F.col("value")), F.col("value") * gain + offset)
    t = F.col("t_s") + shift
    px = F.least(F.floor((t - t0) / (t1 - t0) * width), F.lit(width - 1)).cast("long")
    inside = samples.where((F.col("t_s") >= t0 - shift) & (F.col("t_s") < t1 - shift))
    if rate_hz is not None and (t1 - t0) * rate_hz < width:
        return inside.select(*by, px.alias("px"), v.alias("low"), v.alias("high"))
    return inside.groupBy(*by, px.alias("px")).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def viewport_cells(pyramid_: DataFrame, rate_hz: float, base: int, t0: float, t1: float, width: int, *by: str, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """The same view from a stored pyramid: of the level whose cells are no wider than a pixel, each cell counts for every pixel it touches."""
    samples_per_pixel = (t1 - t0) * rate_hz / width
    level = max(0, math.floor(math.log2(max(samples_per_pixel / base, 1.0))))
    cell_s = base * 2**level / rate_hz
    per_px = (t1 - t0) / width
    d = pyramid_.where((F.col("level") == level) & (F.col("cell") >= math.floor(t0 / cell_s)) & (F.col("cell") * cell_s < t1))
    first = F.greatest(F.floor((F.col("cell") * cell_s - t0) / per_px), F.lit(0))
    last = F.least(F.ceil(((F.col("cell") + 1) * cell_s - t0) / per_px) - 1, F.lit(width - 1))
    a, b = F.col("low") * gain + offset, F.col("high") * gain + offset
    d = d.where(first <= last).select(*by, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("px"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return d.groupBy(*by, "px").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def extent(cells: DataFrame, *by: str) -> DataFrame:
    """low and high over cells (low, high) of several traces, empty ones left out."""
    low, high = (F.when(finite(F.col(c)), F.col(c)) for c in ("low", "high"))
    return cells.groupBy(*by).agg(F.min(low).alias("low"), F.max(high).alias("high"))


def column_profile(samples: DataFrame, bins: int, lo: float, hi: float, *by: str) -> DataFrame:
    """summarise() with crossings and histogram, an array of bins + 2 counts: below, each bin, above."""
    h = histogram(samples, bins, lo, hi, *by).where("bin IS NOT NULL").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_h"))
    counts = F.transform(F.sequence(F.lit(-1).cast("long"), F.lit(bins).cast("long")), lambda k: F.coalesce(F.try_element_at("_h", k), F.lit(0).cast("long")))
    out = summarise(samples, *by).join(zero_crossings(samples, *by), list(by), "left").join(h, list(by), "left")
    return out.withColumns({"crossings": F.coalesce("crossings", F.lit(0)), "histogram": counts}).drop("_h")


def artifact_aggregate(rows: DataFrame, field: str, *by: str) -> DataFrame:
    """n (all rows), low, high, mean and total of a field over rows where it is a finite number."""
    v = F.when(finite(F.col(field).cast("double")), F.col(field).cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.sum(v).alias("total"))


def logic_lane(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.withColumn("lane", F.when(F.col("low").isNull(), "unknown").when(F.col("low") >= threshold, "high").when(F.col("high") < threshold, "low").otherwise("transition"))


def numbered_groups(groups: DataFrame) -> DataFrame:
    """group_id and place, from 0 in the order of ids of any kind (see model.placed)."""
    return placed(groups.select("group_id").distinct(), "place", "group_id")


def metric_curve(metrics: DataFrame, rungs: DataFrame) -> DataFrame:
    """group_id, metric, x and value: x is the rung if every group has one of the same key, else the group's place.

    A metric of the rung's own name becomes `<name> (rung)`.
    """
    groups = metrics.select("group_id").distinct()
    gate = groups.join(rungs, "group_id", "left").agg((F.count("*") == F.count("rung")).alias("all"), (F.count_distinct("key") == 1).alias("same"), F.max("key").alias("rung_key"))
    m = metrics.join(numbered_groups(metrics), "group_id").join(rungs.select("group_id", "rung"), "group_id", "left").crossJoin(F.broadcast(gate))  # one row
    by_rung = F.col("all") & F.col("same")
    name = F.when(by_rung & (F.col("metric") == F.col("rung_key")), F.concat("metric", F.lit(" (rung)"))).otherwise(F.col("metric"))
    return m.select("group_id", name.alias("metric"), F.when(by_rung, F.col("rung")).otherwise(F.col("place").cast("double")).alias("x"), "value")
