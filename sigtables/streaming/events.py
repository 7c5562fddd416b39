"""Structured Streaming forms of the event queries, of threshold detection and of a watched folder."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigtables.functions.scalars import finite
from sigtables.model import kept
from sigtables.operators.catalog import search_pulses
from sigtables.sources.pulse_csv import Profile, read_rows, tables_of


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events in Parquet files under path as they arrive, with ts as an instant in UTC."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("string").cast("timestamp"), "UTC"))


def windowed_stats(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """count, min, max and mean of each event type and time window; rows later than `late` are left out.

    In append mode a window is written once, when no row of it can come any more, and its state goes.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def pyramid_cells(samples: DataFrame, base: int, rate_hz: float, late: str = "10 seconds") -> DataFrame:
    """group_id, signal_id, cell, low and high of a pyramid's level 0, of a stream of samples (idx, value) at a rate.

    A cell's time is that of its end. In append mode it is written once, when the watermark, `late` behind the latest
    cell, has passed it, and its state goes; so only open cells are kept. profile.rolled_up() makes the levels of what is written.
    """
    v = F.when(finite(F.col("value")), F.col("value"))
    d = samples.withColumn("cell", F.floor(F.col("idx") / base))
    d = d.withColumn("at", F.timestamp_micros(((F.col("cell") + 1) * (base / rate_hz * 1e6)).cast("long"))).withWatermark("at", late)
    return d.groupBy("group_id", "signal_id", "cell", "at").agg(F.min(v).alias("low"), F.max(v).alias("high")).drop("at")


def matching(events: DataFrame, predicates) -> DataFrame:
    """Pulses inside all ranges, as they arrive; nothing is kept."""
    return search_pulses(events, predicates)


DETECTIONS = "group_id long, signal_id long, start_s double, end_s double, peak double"
#: What is kept of a bucket of signals: of each its key, is a detection open, its start, peak and last time, how far samples were used and until when
#: (in seconds of the watermark) that is kept; of samples not yet used their signal's place, time, value and event time.
STATE = "nulls array<int>, groups array<long>, signals array<long>, open array<boolean>, start array<double>, peak array<double>, last array<double>, used array<double>, until array<double>, of array<int>, times array<double>, values array<double>, at array<double>"
#: Seconds of the watermark for which a signal without samples is kept.
KEPT_S = 3600.0


def detections(samples: DataFrame, level: float, hysteresis: float, period_s: float, late: str = "10 seconds", buckets: int = 1 << 10) -> DataFrame:
    """Detections of a stream of samples (group_id, signal_id, t_s, value, ts), as stages.threshold() finds them in a table.

    Samples are used in the order of t_s once the watermark on ts has passed them, whatever order they come in; those that
    come later than that are left out (the query's progress counts them). A detection is written when it ends, or when the
    watermark has passed the last sample that its signal has. Between batches a signal keeps one open detection and the
    samples that the watermark hasn't passed. Signals are dealt to `buckets` by the hash of their keys; a bucket is one state,
    so that many short signals don't each cost a call; more buckets for states that are too large for a row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, out = state.getCurrentWatermarkMs() / 1000, []
        nulls, groups, signals, *machine, until, of, times, values, at = (list(c) for c in state.get) if state.exists else ([] for _ in range(13))
        machines, fresh = [list(m) for m in zip(*machine, strict=True)], set()  # open, start, peak, last, used
        place = {k: i for i, k in enumerate(zip(nulls, groups, signals, strict=True))}
        for f in frames:
            event_s = f["ts"].map(lambda x: x.timestamp())
            for n, g, s, t, v, ts in zip(*(c.tolist() for c in (f["nulls"], f["group_id"], f["signal_id"], f["t_s"], f["value"], event_s)), strict=True):
                i = place.setdefault((n, g, s), len(machines))
                if i == len(machines):
                    machines.append([False, 0.0, 0.0, 0.0, float("-inf")])
                    until.append(0.0)
                fresh.add(i)
                if t > machines[i][4]:
                    of.append(i)
                    times.append(t)
                    values.append(v)
                    at.append(ts)
        keys, waiting, due = list(place), {}, []

        def ended(i: int) -> None:
            m = machines[i]
            out.append((keys[i], m[1], m[3] + period_s, m[2]))
            m[0] = False

        for j in sorted(range(len(times)), key=times.__getitem__):
            i, t, v = of[j], times[j], values[j]
            if at[j] > mark:
                waiting.setdefault(i, []).append(j)
                continue
            m = machines[i]
            nan = v is None or v != v
            if m[0] and (nan or (v < level if hysteresis == 0 else v <= level - hysteresis)):
                ended(i)
            elif m[0]:
                m[2], m[3] = max(m[2], v), t
            elif not nan and v >= level:
                m[:4] = True, t, v, t
            m[4] = t
        stay = []
        for i, m in enumerate(machines):
            if i in waiting:
                due.append(max(at[j] for j in waiting[i]))
                until[i] = 0.0
            else:
                if m[0]:
                    ended(i)
                if i in fresh:
                    until[i] = max(mark, 0) + KEPT_S
                if until[i] <= mark:
                    continue
                due.append(until[i])
            stay.append(i)
        if stay:
            left = [(n, j) for n, i in enumerate(stay) for j in waiting.get(i, [])]
            of = [n for n, _ in left]
            times, values, at = ([x[j] for _, j in left] for x in (times, values, at))
            own = ([c[i] for i in stay] for c in (*map(list, zip(*keys, strict=True)), *map(list, zip(*machines, strict=True)), until))
            state.update((*own, of, times, values, at))
            state.setTimeoutTimestamp(int(max(min(due), mark) * 1000) + 1)
        elif state.exists:
            state.remove()
        found = {c: pd.array([None if k[0] & bit else k[at] for k, *_ in out], dtype="Int64") for c, bit, at in (("group_id", 1, 1), ("signal_id", 2, 2))}
        yield pd.DataFrame(found | {c: pd.Series([r[n] for r in out], dtype=float) for n, c in enumerate(("start_s", "end_s", "peak"), 1)})

    none = F.lit(0).cast("long")
    marked = samples.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("group_id", "signal_id"), F.lit(buckets)).alias("bucket"),
        (F.col("group_id").isNull().cast("int") + 2 * F.col("signal_id").isNull().cast("int")).alias("nulls"),
        F.coalesce(F.col("group_id").cast("long"), none).alias("group_id"), F.coalesce(F.col("signal_id").cast("long"), none).alias("signal_id"), "t_s", "value", "ts",
    )
    return marked.groupBy("bucket").applyInPandasWithState(step, DETECTIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_now(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what has arrived and returns what it wrote as Parquet."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return stream.sparkSession.read.parquet(out)


LEDGER = "path string, length long, modified timestamp, state string, message string"


def scan_folder(spark: SparkSession, folder: str, ledger: str, out: str, profile: Profile = Profile(), adopt_before: datetime | None = None) -> DataFrame:
    """One look at a watched folder: takes in the files that have settled and returns the new ledger.

    Only csv, txt and tsv files of the folder itself count. Files older than adopt_before are adopted without being read. A
    file is read when its length and time are what they were at the last look, all such files by one job; its groups and pulses are appended under
    out. One that fails is noted with its message and doesn't keep others from being read; one that vanishes is
    forgotten, so that it counts as new when it comes back. The ledger (path, length, modified, state, message) is a
    table of its own for each look, the latest of which counts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,txt,tsv}").option("recursiveFileLookup", "false").load(folder)
    seen = files.select("path", "length", F.col("modificationTime").alias("modified"))
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    looks = sorted(int(f.getPath().getName()) for f in fs.listStatus(root)) if fs.exists(root) else []
    before = spark.read.parquet(f"{ledger}/{looks[-1]}") if looks else spark.createDataFrame([], LEDGER)
    old = before.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("state").alias("_s"), "message")
    same = (F.col("length") == F.col("_l")) & (F.col("modified") == F.col("_m"))
    adopted = F.lit(False) if adopt_before is None else F.col("_s").isNull() & (F.col("modified") < F.lit(adopt_before))
    state = F.when(adopted, "adopted").when(F.col("_s").isin("adopted", "read", "failed") & same, F.col("_s")).when(same & (F.col("_s") == "seen"), "settled").otherwise("seen")
    now = kept(seen.join(old, "path", "left").select("path", "length", "modified", state.alias("state"), "message"))
    settled = [r.path for r in now.where("state = 'settled'").select("path").collect()]  # names, as a listing has them
    told = spark.createDataFrame([], "path string, error string")
    if settled:
        rows = kept(read_rows(spark, settled, profile, noted=True))
        told = rows.where("error IS NOT NULL").select("path", "error")
        groups, pulses, _ = tables_of(rows.join(told.select("path"), "path", "left_anti"), profile)
        groups.write.mode("append").parquet(f"{out}/groups")
        pulses.write.mode("append").parquet(f"{out}/pulses")
    done = F.when(F.col("state") != "settled", F.col("state")).when(F.col("error").isNull(), "read").otherwise("failed")
    message = F.when(F.col("state") != "settled", F.col("message")).otherwise(F.substring("error", 1, 500))
    table = now.join(told, "path", "left").select("path", "length", "modified", done.alias("state"), message.alias("message"))
    number = looks[-1] + 1 if looks else 0
    table.coalesce(1).write.parquet(f"{ledger}/{number}")
    return spark.read.schema(LEDGER).parquet(f"{ledger}/{number}")


def stream_pulse_csv(spark: SparkSession, folder: str, checkpoint: str, out: str, every: str = "10 seconds", profile: Profile = Profile(), adopt_before: datetime | None = None) -> StreamingQuery:
    """A running query that looks at a folder again and again (see scan_folder)."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    look = lambda _df, _id: scan_folder(spark, folder, f"{checkpoint}/ledger", out, profile, adopt_before)
    return clock.writeStream.foreachBatch(look).option("checkpointLocation", f"{checkpoint}/clock").trigger(processingTime=every).start()
