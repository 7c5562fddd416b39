"""Pipelines: stages with checked parameters and ports over a bundle of tables, one plan for all groups."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.model import kept, stored
from sigtables.operators import generate, stages
from sigtables.operators.profile import summarise

KEY = ["group_id", "signal_id"]
#: Samples from which a signal is transformed by many tasks.
LONG = 1 << 18
#: A table that is told of artifacts by kind.
Told = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Bundle:
    """What a stage sees.

    samples: group_id, signal_id, idx, t_s, value; signals: group_id, signal_id, ordinal, name, domain, rate_hz, t0_s,
    attributes (map<string,string>); artifacts by kind; properties: group_id, key, value; summaries: summarise() of samples, if known.
    """

    samples: DataFrame
    signals: DataFrame
    artifacts: Mapping[str, DataFrame] = field(default_factory=dict)
    properties: DataFrame | None = None
    summaries: DataFrame | None = None

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Bundle:
        """A bundle of changed tables."""
        some = lambda df: None if df is None else change(df)
        return Bundle(change(self.samples), change(self.signals), {k: change(v) for k, v in self.artifacts.items()}, some(self.properties), some(self.summaries))

    def of_groups_without(self, failed: DataFrame) -> Bundle:
        return self.each(lambda df: df.join(failed.select("group_id"), "group_id", "left_anti"))

    def of_groups(self, chosen: DataFrame) -> Bundle:
        return self.each(lambda df: df.join(chosen.select("group_id"), "group_id", "left_semi"))

    def and_of(self, other: Bundle) -> Bundle:
        """The groups of both."""
        both = lambda a, b: b if a is None else a if b is None else a.unionByName(b)
        kinds = {**self.artifacts, **other.artifacts}
        return Bundle(both(self.samples, other.samples), both(self.signals, other.signals), {k: both(self.artifacts.get(k), other.artifacts.get(k)) for k in kinds}, both(self.properties, other.properties))


@dataclass(frozen=True)
class Outputs:
    """What a stage did. A signal is replaced (samples; all signals unless `only` has their keys), dropped or passed through.

    added: group_id, name, domain, idx, t_s, value; attributes: group_id, signal_id, set, remove; metrics: group_id, name,
    value; failed: group_id, message of groups that stop here; notes: group_id, message. metrics and properties may be functions
    of the artifacts instead, so that what they tell of is computed once.
    """

    replaced: DataFrame | None = None
    only: DataFrame | None = None
    dropped: DataFrame | None = None
    added: DataFrame | None = None
    attributes: DataFrame | None = None
    properties: DataFrame | Told | None = None
    artifacts: Mapping[str, DataFrame] = field(default_factory=dict)
    metrics: DataFrame | Told | None = None
    failed: DataFrame | None = None
    notes: DataFrame | None = None

    def settled(self) -> Outputs:
        """Outputs without functions."""
        return replace(self, **{n: told(self.artifacts) for n in ("metrics", "properties") if callable(told := getattr(self, n))})


def apply_outputs(bundle: Bundle, out: Outputs) -> tuple[Bundle, DataFrame]:
    """(what the next stage sees, dispositions). dispositions: group_id, signal_id, ordinal, name, disposition.

    Signals that stay keep their order and get ordinals without gaps; replaced ones keep name, domain and timebase; added
    ones come after them by name, with the timebase of the group's first signal and an id from the hash of group and
    name; dropped ones are last among the dispositions. Attributes are first removed, then set.
    """
    s, out = bundle.signals, out.settled()
    kind = F.lit("passthrough")
    if out.replaced is not None:
        s = s.join(out.only.select(*KEY).distinct().withColumn("_r", F.lit(True)), KEY, "left") if out.only is not None else s.withColumn("_r", F.lit(True))
        kind = F.when(F.col("_r"), "replaced").otherwise(kind)
    if out.dropped is not None:
        s = s.join(out.dropped.select(*KEY).distinct().withColumn("_d", F.lit(True)), KEY, "left")
        kind = F.when(F.col("_d"), "dropped").otherwise(kind)
    s = s.withColumn("disposition", kind).drop("_r", "_d")
    samples = bundle.samples
    if out.replaced is not None:
        rest = samples.join(out.only.select(*KEY).distinct(), KEY, "left_anti") if out.only is not None else None
        fresh = out.replaced.select(samples.columns)
        samples = fresh if rest is None else rest.unionByName(fresh)
    if out.dropped is not None:
        samples = samples.join(out.dropped.select(*KEY).distinct(), KEY, "left_anti")
    if out.attributes is not None:
        a = out.attributes.select(*KEY, F.col("set").alias("_set"), F.col("remove").alias("_remove"))
        s = s.join(a, KEY, "left")
        kept_ = F.map_filter("attributes", lambda k, _: ~F.coalesce(F.array_contains("_remove", k), F.lit(False)) & ~F.coalesce(F.map_contains_key("_set", k), F.lit(False)))
        s = s.withColumn("attributes", F.map_concat(kept_, F.coalesce("_set", F.create_map().cast("map<string,string>")))).drop("_set", "_remove")
    if out.added is not None:
        new_id = F.xxhash64("group_id", "name")
        first = bundle.signals.groupBy("group_id").agg(F.min_by(F.struct("rate_hz", "t0_s"), "ordinal").alias("_b"))
        names = out.added.select("group_id", "name", "domain").distinct().join(first, "group_id", "left")
        fresh = names.select("group_id", new_id.alias("signal_id"), F.lit(None).cast("int").alias("ordinal"), "name", "domain", F.col("_b.rate_hz").alias("rate_hz"), F.coalesce("_b.t0_s", F.lit(0.0)).alias("t0_s"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit("added").alias("disposition"))
        s = s.unionByName(fresh.select(s.columns))
        samples = samples.unionByName(out.added.withColumn("signal_id", new_id).select(samples.columns))
    if out.dropped is not None or out.added is not None:
        order = W.partitionBy("group_id").orderBy((F.col("disposition") == "dropped").cast("int"), F.col("ordinal").asc_nulls_last(), "name")
        s = s.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    properties = bundle.properties
    if out.properties is not None:
        fresh = out.properties.select("group_id", "key", "value")
        properties = fresh if properties is None else properties.join(fresh, ["group_id", "key"], "left_anti").unionByName(fresh)
    same = out.replaced is None and out.dropped is None and out.added is None
    after = Bundle(samples, s.where("disposition != 'dropped'").drop("disposition"), {**bundle.artifacts, **out.artifacts}, properties, bundle.summaries if same else None)
    return after, s.select(*KEY, "ordinal", "name", "disposition")


@dataclass(frozen=True)
class Param:
    """kind: float, int, bool, text or enum (one of `options`)."""

    name: str
    kind: str = "float"
    default: object = None
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()
    required: bool = False


@dataclass(frozen=True)
class Descriptor:
    """A stage's kind: its function of (bundle, parameters), parameters, artifacts it needs and gives, version, and whether equal input gives equal output.

    domains: those of signals that it reads, one of which there must be (none: any signals); adds: those that it adds; summaries:
    whether it reads the bundle's summaries. begin(bundle, parameters) is called before a run's stages; end(bundle that the stage
    left, parameters) gives artifacts of the run as a whole, by port. salt: more that a stage's results depend on, as a version of
    what it loads.
    """

    kind: str
    run: Callable[..., Outputs]
    params: tuple[Param, ...] = ()
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    version: int = 1
    pure: bool = True
    domains: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()
    summaries: bool = False
    begin: Callable[..., None] | None = None
    end: Callable[..., Mapping[str, DataFrame]] | None = None
    salt: str = ""


def named(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """group_id, name and value from metrics (group_id, signal_id, metric, value): a signal's metrics are <signal>.<metric>."""
    m = metrics.join(signals.select(*KEY, F.col("name").alias("_s")), KEY)
    return m.select("group_id", F.concat_ws(".", "_s", "metric").alias("name"), F.col("value").cast("double").alias("value"))


def long(df: DataFrame, *names: str, by: Sequence[str] = KEY) -> DataFrame:
    """by, metric and value of each named column, without nulls."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*by, F.explode(cells).alias("m")).select(*by, "m.*").where("value IS NOT NULL")


def _of(b: Bundle, signal: str | None) -> DataFrame:
    """Samples of the signals of a name, or of all."""
    return b.samples if not signal else b.samples.join(b.signals.where(F.col("name") == signal).select(*KEY), KEY)


def _without(b: Bundle, signal: str | None) -> DataFrame | None:
    """Groups that lack the named signal, as failures."""
    if not signal:
        return None
    groups = b.signals.groupBy("group_id").agg(F.bool_or(F.col("name") == signal).alias("_has"))
    return groups.where(~F.col("_has")).select("group_id", F.lit(f"no signal {signal}").alias("message"))


def _gain(b: Bundle, gain: float) -> Outputs:
    return Outputs(stages.gain(b.samples, gain), metrics=named(stages.conditioning_metrics(b.samples, "peak", gain), b.signals))


def _detrend(b: Bundle, mode: str) -> Outputs:
    return Outputs(stages.detrend(b.samples, mode), metrics=named(stages.conditioning_metrics(b.samples, "offset_removed"), b.signals))


def _normalise(b: Bundle, mode: str, target: float) -> Outputs:
    m = stages.conditioning_metrics(b.samples, f"scale_{mode}", target)
    quiet = m.where("metric = 'left_as_is'").select("group_id", F.lit("a signal is all but zero and stays").alias("message"))
    return Outputs(stages.normalise(b.samples, mode, target), metrics=named(m.where("metric = 'scale'"), b.signals), notes=quiet)


def _rated(samples: DataFrame, signals: DataFrame) -> DataFrame:
    """samples with each signal's own rate as _rate, null for irregular ones."""
    return samples.join(signals.select(*KEY, F.col("rate_hz").alias("_rate")), KEY)


def _irregular(signals: DataFrame, what: str) -> DataFrame:
    return signals.where("rate_hz IS NULL").select("group_id", F.concat(F.lit("'"), "name", F.lit(f"' has no regular sample rate, so {what}")).alias("message"))


def _filter(b: Bundle, response: str, cutoff_hz: float, q: float, sections: int) -> Outputs:
    """Each signal by the section for its own rate. Groups with a signal whose half rate is at or below the cutoff fail; irregular ones stay as they are."""
    s = b.signals
    failed = s.where(F.col("rate_hz") / 2 <= cutoff_hz).select("group_id", F.lit("the cutoff is not below half the sample rate").alias("message")).distinct()
    good = s.where(F.col("rate_hz") / 2 > cutoff_hz)
    out = stages.filter_samples(_rated(b.samples, good), response, cutoff_hz, "_rate", q, sections)
    return Outputs(out, only=good.select(*KEY), failed=failed, notes=_irregular(s, "it was not filtered"))


def _fft(b: Bundle, signal: str, window: str, size: int) -> Outputs:
    """Signals of up to LONG samples are transformed in one row each, longer ones by many tasks."""
    rated = _rated(_of(b, signal), b.signals.where("rate_hz IS NOT NULL"))
    spans = rated.groupBy(*KEY).agg((F.max("idx") >= LONG).alias("_long"))
    rated = rated.join(spans, KEY)
    arrays = stages.to_blocks(rated.where("NOT _long"), 1 << 40, "_rate").select(*KEY, "values", "_rate")
    spectra = stages.spectrum(arrays, "_rate", window, size).unionByName(stages.long_spectrum(rated.where("_long").drop("_long"), "_rate", window, size))
    metrics = lambda a: named(long(stages.spectrum_metrics(a["spectrum"]), "peak_hz", "peak_db", "peak_phase_rad", "fft_size"), b.signals)
    return Outputs(artifacts={"spectrum": spectra}, metrics=metrics, failed=_without(b, signal), notes=_irregular(b.signals, "no spectrum was computed"))


def _statistics(b: Bundle, write_back: bool) -> Outputs:
    """From the summaries that the bundle has of its samples, which aren't read."""
    s = stages.statistics(b.summaries)
    back = s.select(*KEY, F.create_map(F.lit("rms"), F.col("rms").cast("string")).alias("set"), F.array().cast("array<string>").alias("remove"))
    return Outputs(artifacts={"statistics": s}, metrics=named(long(s, "rms", "peak_to_peak"), b.signals), attributes=back if write_back else None)


def _threshold(b: Bundle, level: float, polarity: str, hysteresis: float, min_width_s: float) -> Outputs:
    """A detection lasts to the end of its last sample, by the signal's own rate; in an irregular signal to its time."""
    periods = b.signals.select(*KEY, (1 / F.col("rate_hz")).alias("period_s"))
    d = stages.threshold(b.samples, level, hysteresis, min_width_s, periods, polarity == "falling")

    def totals(artifacts: Mapping[str, DataFrame]) -> DataFrame:
        m = artifacts["detections"].groupBy("group_id").agg(F.count("*").alias("detections"), F.max(F.col("end_s") - F.col("start_s")).alias("widest_s"))
        return b.signals.select("group_id").distinct().join(m, "group_id", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))

    count = lambda a: totals(a).select("group_id", F.lit("detection_count").alias("key"), F.col("detections").cast("double").alias("value"))
    metrics = lambda a: long(totals(a), "detections", "widest_s", by=["group_id"]).withColumnRenamed("metric", "name")
    return Outputs(artifacts={"detections": d}, metrics=metrics, properties=count)


def _peaks(b: Bundle, polarity: str, min_prominence: float, min_distance_s: float, max_count: int, window_s: float) -> Outputs:
    """Times are the samples' own; distance and window hold by the signal's rate, and not in irregular ones."""
    rated = _rated(b.samples, b.signals)
    times = rated.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t_s"))), lambda x: x["t_s"]).alias("times"))
    arrays = stages.to_blocks(rated, 1 << 40, "_rate").select(*KEY, "values", "_rate").join(times, KEY)
    p = stages.peaks(arrays, "_rate", min_prominence, min_distance_s, max_count or None, polarity == "falling", window_s or None)
    m = lambda a: a["peaks"].groupBy("group_id").agg(F.count("*").alias("peaks"), F.max("prominence").alias("strongest"))
    return Outputs(artifacts={"peaks": p}, metrics=lambda a: long(m(a), "peaks", "strongest", by=["group_id"]).withColumnRenamed("metric", "name"))


def _slice(b: Bundle, level: float, hysteresis: float, invert: bool, name: str, signal: str) -> Outputs:
    """Adds a logic signal of the first, or the named, signal of each group; a group without it gets a note."""
    first = b.signals.groupBy("group_id").agg(F.min_by("signal_id", F.struct(F.col("name") != signal, "ordinal") if signal else F.struct("ordinal")).alias("signal_id"))
    if signal:
        first = first.join(b.signals.where(F.col("name") == signal).select(*KEY), KEY)
    bits = stages.slice_levels(b.samples.join(first, KEY), level, hysteresis, invert)
    added = bits.select("group_id", F.lit(name).alias("name"), F.lit("digital_logic").alias("domain"), "idx", "t_s", F.col("bit").cast("double").alias("value"))
    m = stages.slice_metrics(bits)
    lacking = _without(b, signal)
    return Outputs(added=added, metrics=long(m, "transitions", "duty", by=["group_id"]).withColumnRenamed("metric", "name"), notes=lacking)


def _symbols(b: Bundle, symbol_rate_hz: float, format: str, level: float, spacing: float, align: str, phase: float) -> Outputs:
    """By each signal's own rate; groups with an irregular signal, or one slower than the symbols, fail."""
    nominals = [level - spacing / 2, level + spacing / 2] if format == "nrz" else [level + spacing * (k - 1.5) for k in range(4)]
    slow = F.when(F.col("rate_hz").isNull(), "symbols need a regular timebase").when(F.col("rate_hz") < symbol_rate_hz, "the symbol rate is above the sample rate")
    failed = b.signals.select("group_id", slow.alias("message")).where("message IS NOT NULL")
    good = b.signals.where(F.col("rate_hz") >= symbol_rate_hz)
    d = stages.symbols(_rated(b.samples, good), symbol_rate_hz, "_rate", nominals, phase, align)
    m = lambda a: a["symbols"].groupBy(*KEY).agg(F.count("*").alias("symbols"), F.min("margin").alias("worst_margin"), F.avg("margin").alias("mean_margin"))
    return Outputs(artifacts={"symbols": d}, metrics=lambda a: named(long(m(a), "symbols", "worst_margin", "mean_margin"), b.signals), failed=failed)


def _bits(b: Bundle, width: int, bits_per_symbol: int, msb_first: bool, invert: bool) -> Outputs:
    return Outputs(artifacts={"bits": stages.pack_bits(b.artifacts["symbols"], width, bits_per_symbol, msb_first, invert)})


def _pulse_metrics(b: Bundle, write_back: bool) -> Outputs:
    m = stages.pulse_metrics(b.artifacts["detections"], stages.longest_signal(_rated(b.samples, b.signals), "_rate"))
    names = [c for c in m.columns if c != "group_id"]
    rows = long(m, *names, by=["group_id"]).withColumnRenamed("metric", "name")
    return Outputs(artifacts={"metrics": rows}, metrics=lambda a: a["metrics"], properties=stages.pulse_properties(m) if write_back else None)


POLARITY = Param("polarity", "enum", "rising", options=("rising", "falling"))
STAGES: dict[str, Descriptor] = {
    d.kind: d
    for d in (
        Descriptor("passthrough", lambda b: Outputs()),
        Descriptor("gain", _gain, (Param("gain", default=1.0),)),
        Descriptor("detrend", _detrend, (Param("mode", "enum", "mean", options=("mean", "linear")),)),
        Descriptor("normalise", _normalise, (Param("mode", "enum", "peak", options=("peak", "rms")), Param("target", default=1.0, low=0.0))),
        Descriptor("filter", _filter, (Param("response", "enum", "low", options=("low", "high", "band", "notch")), Param("cutoff_hz", low=0.0, required=True), Param("q", default=math.sqrt(0.5), low=1e-3), Param("sections", "int", 1, 1, 8))),
        Descriptor("fft", _fft, (Param("signal", "text", ""), Param("window", "enum", "hann", options=tuple(stages.WINDOWS)), Param("size", "int", 0, 0)), gives=("spectrum",)),
        Descriptor("statistics", _statistics, (Param("write_back", "bool", False),), gives=("statistics",), summaries=True),
        Descriptor("threshold", _threshold, (Param("level", required=True), POLARITY, Param("hysteresis", default=0.0, low=0.0), Param("min_width_s", default=0.0, low=0.0)), gives=("detections",)),
        Descriptor("peaks", _peaks, (POLARITY, Param("min_prominence", default=0.0, low=0.0), Param("min_distance_s", default=0.0, low=0.0), Param("max_count", "int", 0, 0), Param("window_s", default=0.0, low=0.0)), gives=("peaks",)),
        Descriptor("slice", _slice, (Param("level", default=0.0), Param("hysteresis", default=0.0, low=0.0), Param("invert", "bool", False), Param("name", "text", "logic"), Param("signal", "text", "")), adds=("digital_logic",)),
        Descriptor("symbols", _symbols, (Param("symbol_rate_hz", low=0.0, required=True), Param("format", "enum", "nrz", options=("nrz", "pam4")), Param("level", default=0.0), Param("spacing", default=2.0, low=0.0), Param("align", "enum", "first-edge", options=("first-edge", "start")), Param("phase", default=0.5, low=0.0, high=1.0)), gives=("symbols",)),
        Descriptor("bits", _bits, (Param("width", "int", 8, 1, 62), Param("bits_per_symbol", "int", 1, 1, 2), Param("msb_first", "bool", True), Param("invert", "bool", False)), needs=("symbols",), gives=("bits",)),
        Descriptor("pulse_metrics", _pulse_metrics, (Param("write_back", "bool", False),), needs=("detections",), gives=("metrics",)),
        Descriptor("noise", lambda b, snr_db, seed: Outputs(stages.add_noise(b.samples, snr_db, seed)), (Param("snr_db", required=True), Param("seed", "int", 1))),
        Descriptor("am", lambda b, carrier_hz, depth: Outputs(stages.modulate_am(b.samples, carrier_hz, depth)), (Param("carrier_hz", low=0.0, required=True), Param("depth", required=True))),
        Descriptor("clip", lambda b, lo, hi: Outputs(generate.clip(b.samples, lo, hi)), (Param("lo", required=True), Param("hi", required=True))),
        Descriptor("resample", lambda b, from_hz, to_hz: Outputs(stages.resample(b.samples, from_hz, to_hz)), (Param("from_hz", low=0.0, required=True), Param("to_hz", low=0.0, required=True))),
        Descriptor("drop", lambda b, signal: Outputs(dropped=b.signals.where(F.col("name") == signal)), (Param("signal", "text", required=True),)),
    )
}


def register_stage(kind: str, run: Callable[..., Outputs], params: Sequence[Param] = (), needs: Sequence[str] = (), gives: Sequence[str] = (), version: int = 1, pure: bool = True, domains: Sequence[str] = (), adds: Sequence[str] = (), begin: Callable[..., None] | None = None, end: Callable[..., Mapping[str, DataFrame]] | None = None, salt: str = "") -> None:
    """A user's stage, from a bundle and parameters to outputs; its kind begins with ext. and is new."""
    if not kind.startswith("ext.") or kind in STAGES:
        raise ValueError(f"{kind}: a user's stage begins with ext. and is new")
    STAGES[kind] = Descriptor(kind, run, tuple(params), tuple(needs), tuple(gives), version, pure, tuple(domains), tuple(adds), False, begin, end, salt)


def per_group(kind: str, function: Callable, schema: str, params: Sequence[Param] = (), version: int = 1) -> None:
    """A user's stage that runs apart for each group: function(samples of a group as a pandas frame, **parameters) gives its samples.

    A group where it raises stops there with the error as its message; the others go on.
    """

    def run(b: Bundle, **given: object) -> Outputs:
        def safely(table):
            try:
                return function(table, **given).assign(_error=None)
            except Exception as e:  # what a user's function raises is the group's failure, not the job's
                return table.head(1).assign(_error=f"{type(e).__name__}: {e}")

        out = kept(b.samples.groupBy("group_id").applyInPandas(safely, f"{schema}, _error string"))  # the function runs once
        failed = out.where("_error IS NOT NULL").select("group_id", F.col("_error").alias("message"))
        return Outputs(out.where("_error IS NULL").drop("_error"), failed=failed)

    register_stage(kind, run, params, version=version)


@dataclass(frozen=True)
class Stage:
    kind: str
    params: Mapping[str, object] = field(default_factory=dict)
    enabled: bool = True
    retention: str = "always"


KINDS = {"float": (int, float), "int": (int,), "bool": (bool,), "text": (str,), "enum": (str,)}


def resolved(stage: Stage) -> tuple[dict[str, object], list[str]]:
    """(all parameters with their defaults, what is wrong with the given ones)."""
    d = STAGES.get(stage.kind)
    if d is None:
        return {}, [f"no kind {stage.kind}"]
    known, out, wrong = {p.name: p for p in d.params}, {}, []
    wrong += [f"no parameter {n}" for n in stage.params if n not in known]
    for p in d.params:
        if p.name not in stage.params:
            if p.required:
                wrong.append(f"{p.name} is missing")
            out[p.name] = p.default
            continue
        v = out[p.name] = stage.params[p.name]
        if not isinstance(v, KINDS[p.kind]) or isinstance(v, bool) and p.kind != "bool":
            wrong.append(f"{p.name}: a {p.kind} is needed")
        elif p.kind == "enum" and v not in p.options:
            wrong.append(f"{p.name}: one of {', '.join(p.options)}")
        elif p.kind in ("float", "int"):
            if not math.isfinite(v) or p.low is not None and v < p.low or p.high is not None and v > p.high:
                wrong.append(f"{p.name}: out of range")
            out[p.name] = float(v) if p.kind == "float" else v
    return out, wrong


def issues(pipeline: Sequence[Stage], artifacts: Sequence[str] = (), domains: Sequence[str] | None = None) -> list[str]:
    """All that is wrong with a pipeline, before any job starts: kinds, parameters, and what no earlier stage gives.

    artifacts and domains: of the bundle that it will run on; domains None: not known, so any may be there.
    """
    out, have = [] if any(s.enabled for s in pipeline) else ["no stage is enabled"], set(artifacts)
    there = None if domains is None else set(domains)
    for i, s in enumerate(pipeline):
        out += [f"stage {i}: {w}" for w in resolved(s)[1]]
        if s.retention not in ("always", "on_failure", "never"):
            out.append(f"stage {i}: retention: always, on_failure or never")
        if s.enabled and (d := STAGES.get(s.kind)):
            out += [f"stage {i}: needs {n}, which no stage before it gives" for n in d.needs if n not in have]
            if d.domains and there is not None and not there & set(d.domains):
                out.append(f"stage {i}: needs {' or '.join(d.domains)} signals, which neither the bundle nor a stage before it has")
            have |= set(d.gives)
            if there is not None:
                there |= set(d.adds)
    return out


def stage_keys(pipeline: Sequence[Stage], salt: str = "") -> list[str]:
    """A key of each enabled stage and all before it: equal keys on equal input give equal output, so an edit renews the keys from it on.

    A key is of the kinds, versions and parameters with their defaults. From an impure stage on keys are empty: nothing is reused.
    """
    out, above, pure = [], salt, True
    for s in pipeline:
        if s.enabled:
            d = STAGES[s.kind]
            pure = pure and d.pure
            above = hashlib.sha256(json.dumps([above, s.kind, d.version, resolved(s)[0], *([d.salt] if d.salt else [])], sort_keys=True).encode()).hexdigest()
            out.append(above if pure else "")
    return out


def pipeline_hash(pipeline: Sequence[Stage]) -> str:
    return hashlib.sha256(json.dumps([[s.kind, STAGES[s.kind].version, resolved(s)[0]] for s in pipeline if s.enabled], sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Run:
    """What a run leaves: the last bundle and, per stage (-1: the source), its records.

    groups: group_id, status, failed_stage, message; signals: stage_ordinal, group_id, signal_id, ordinal, name, disposition and
    a summary; metrics: stage_ordinal, group_id, name, value; notes: stage_ordinal, group_id, message; artifacts by stage;
    bundles: what each stage left to the next; whole: artifacts of the run as a whole, by stage and port.
    """

    last: Bundle
    groups: DataFrame
    signals: DataFrame
    metrics: DataFrame | None
    notes: DataFrame | None
    artifacts: Mapping[tuple[int, str], DataFrame]
    bundles: Mapping[int, Bundle]
    keys: Sequence[str] = ()
    whole: Mapping[tuple[int, str], DataFrame] = field(default_factory=dict)


SUMMARY = ("min", "max", "mean", "rms", "peak_to_peak")


def _recorded(stage: int, dispositions: DataFrame, bundle: Bundle) -> DataFrame:
    s = (bundle.summaries if bundle.summaries is not None else summarise(bundle.samples, *KEY)).select(*KEY, F.col("count").alias("samples"), *SUMMARY)
    return dispositions.join(s, KEY, "left").withColumn("stage_ordinal", F.lit(stage))


def union(parts: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def run_groups(bundle: Bundle, pipeline: Sequence[Stage], joining: Mapping[int, Bundle] | None = None, keep: bool = True) -> Run:
    """All enabled stages over all groups. A group that fails at a stage has no later ones; the other groups go on.

    What a stage leaves of samples and summaries is written once (`keep`), so each stage's plan begins there and is as long
    as its own work. joining: bundles of more groups, by the stage after which they join in (-1: the source).
    """
    joining = dict(joining or {})
    enabled = [p for p in pipeline if p.enabled]
    domains = None
    if any(STAGES[s.kind].domains for s in enabled if s.kind in STAGES):
        domains = [r[0] for b in (bundle, *joining.values()) for r in b.signals.select("domain").distinct().collect()]
    if found := issues(pipeline, tuple({k for b in (bundle, *joining.values()) for k in b.artifacts}), domains):
        raise ValueError("; ".join(found))
    for s in enabled:
        if STAGES[s.kind].begin:
            STAGES[s.kind].begin(bundle, **resolved(s)[0])
    everyone = union([b.signals.select("group_id") for b in (bundle, *joining.values())]).distinct()
    source = bundle.signals.select(*KEY, "ordinal", "name", F.lit("source").alias("disposition"))
    records, metrics, notes, failures, artifacts, bundles, whole = [_recorded(-1, source, bundle)], [], [], [], {}, {-1: bundle}, {}
    if -1 in joining:
        bundle = bundle.and_of(joining[-1])
    for i, s in enumerate(enabled):
        if STAGES[s.kind].summaries and bundle.summaries is None:
            sums = summarise(bundle.samples, *KEY)
            bundle = replace(bundle, summaries=stored(sums) if keep else sums)
        out = STAGES[s.kind].run(bundle, **resolved(s)[0])
        left = lambda df: df
        if out.failed is not None:
            bad = out.failed.groupBy("group_id").agg(F.min("message").alias("message"), F.lit(i).alias("failed_stage"))
            bad = stored(bad) if keep else bad
            failures.append(bad)
            bundle = bundle.of_groups_without(bad)

            def left(df: DataFrame | None, bad: DataFrame = bad) -> DataFrame | None:
                return None if df is None else df.join(bad.select("group_id"), "group_id", "left_anti")

        artifacts_ = {k: left(v) for k, v in out.artifacts.items()}
        out = replace(out, artifacts={k: kept(v) for k, v in artifacts_.items()} if keep else artifacts_).settled()
        out = replace(out, **{n: left(getattr(out, n)) for n in ("replaced", "only", "dropped", "added", "attributes", "properties", "metrics", "notes")})
        if keep and out.properties is not None:
            out = replace(out, properties=stored(out.properties))
        changed = out.replaced is not None or out.added is not None or out.dropped is not None or out.failed is not None
        bundle, dispositions = apply_outputs(bundle, out)
        if changed and keep:
            bundle = replace(bundle, samples=stored(bundle.samples), signals=stored(bundle.signals))
        records.append(_recorded(i, dispositions, bundle))
        artifacts |= {(i, k): v for k, v in out.artifacts.items()}
        if out.metrics is not None:
            metrics.append(out.metrics.select(F.lit(i).alias("stage_ordinal"), "group_id", "name", "value"))
        if out.notes is not None:
            notes.append(out.notes.select(F.lit(i).alias("stage_ordinal"), "group_id", "message"))
        bundles[i] = bundle
        if i in joining:
            bundle = bundle.and_of(joining[i])
        if STAGES[s.kind].end:
            whole |= {(i, k): v for k, v in STAGES[s.kind].end(bundle, **resolved(s)[0]).items()}
    failed = union(failures)
    groups = everyone.join(failed, "group_id", "left") if failed is not None else everyone.withColumns({"message": F.lit(None).cast("string"), "failed_stage": F.lit(None).cast("int")})
    groups = groups.select("group_id", F.when(F.col("failed_stage").isNull(), "ok").otherwise("failed").alias("status"), "failed_stage", "message")
    return Run(bundle, groups, union(records), union(metrics), union(notes), artifacts, bundles, stage_keys(pipeline), whole)


TABLES = ("groups", "signals", "metrics", "notes", "artifacts", "samples", "states", "properties", "keys")


def write_run(result: Run, path: str, run_id: str, pipeline: Sequence[Stage], hashes: DataFrame | None = None, copied: Mapping[str, DataFrame] | None = None, begun: DataFrame | None = None) -> None:
    """Appends a run's records under path, partitioned by run_id: run_groups, run_signals, run_metrics, run_notes, run_artifacts,
    run_samples, run_states (the signals that a stage left), run_properties and run_keys.

    Artifacts are rows of JSON by port, with their schema; those of the run as a whole have no group. Samples, states and properties of a stage are written as its
    retention says: always, on_failure (of groups that failed) or never; the records of signals stay whatever happens to
    samples. hashes: input_hashes() of the source; with them run_keys says from which stages another run can go on. copied:
    more records of some tables, by name, as another run has them; begun: group_id and stage of groups that began after a stage.
    """
    copied, found = dict(copied or {}), {n: [] for n in TABLES}

    def add(name: str, df: DataFrame | None) -> None:
        if df is not None:
            found[name].append(df)

    add("groups", result.groups)
    add("signals", result.signals)
    add("metrics", result.metrics)
    add("notes", result.notes)
    for (stage, port), df in result.artifacts.items():
        rest = [c for c in df.columns if c != "group_id"]
        kind = df.select(*rest).schema.simpleString()
        add("artifacts", df.select("group_id", F.lit(stage).alias("stage_ordinal"), F.lit(port).alias("port"), F.to_json(F.struct(*rest)).alias("payload"), F.lit(kind).alias("schema")))
    for (stage, port), df in result.whole.items():
        none = F.lit(None).cast(result.groups.schema["group_id"].dataType).alias("group_id")
        add("artifacts", df.select(none, F.lit(stage).alias("stage_ordinal"), F.lit(port).alias("port"), F.to_json(F.struct(*df.columns)).alias("payload"), F.lit(df.schema.simpleString()).alias("schema")))
    bad = result.groups.where("status = 'failed'").select("group_id")
    policies = {-1: "never"} | {i: s.retention for i, s in enumerate(s for s in pipeline if s.enabled)}
    for stage, bundle in result.bundles.items():
        for name, df in (("samples", bundle.samples), ("states", bundle.signals), ("properties", bundle.properties)):
            if policies[stage] != "never" and df is not None:
                own = df if policies[stage] == "always" else df.join(bad, "group_id", "left_semi")
                add(name, own.withColumn("stage_ordinal", F.lit(stage)))
    if hashes is not None:
        always = [i for i, p in policies.items() if p == "always" and i >= 0]
        good = hashes.join(bad, "group_id", "left_anti")
        fresh = cache_keys(good, result.keys).where(F.col("stage_ordinal").isin(always) & F.col("cache_key").isNotNull())
        if begun is not None:
            fresh = fresh.join(begun.select("group_id", "stage"), "group_id", "left").where(F.col("stage_ordinal") > F.coalesce("stage", F.lit(-1))).drop("stage")
        add("keys", fresh)
    for name, parts in found.items():
        parts = [*parts, *([copied[name]] if name in copied else [])]
        if parts:
            rows = union(parts)
            if re.fullmatch(r"[\w.-]+", run_id, re.ASCII):  # one run's folder by its name: partitionBy would sort all rows by one value
                rows.write.mode("append").parquet(f"{path}/run_{name}/run_id={run_id}")
            else:  # Spark knows how to write such a name
                rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/run_{name}")


def input_hashes(bundle: Bundle) -> DataFrame:
    """group_id and input_hash: of the names and exact contents of a group's signals and of the artifacts that come with it.

    An irregular signal's contents are its times too; samples meet their signals only where there is one. Samples are hashed by sums that don't depend on order, so no group is gathered; artifacts by the same of their rows.
    """
    what, samples = ["idx", F.coalesce(F.col("value").cast("string"), F.lit("null"))], bundle.samples
    if not bundle.signals.where("rate_hz IS NULL").isEmpty():
        what, samples = [*what, F.when(F.col("_rate").isNull(), F.col("t_s").cast("string"))], _rated(samples, bundle.signals)
    bits, more = F.xxhash64(*what), F.xxhash64(F.lit(17), *what)
    content = samples.groupBy(*KEY).agg(F.bit_xor(bits).alias("x"), F.sum(more.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = bundle.signals.join(content, KEY, "left").select("group_id", F.xxhash64("name", "ordinal", "domain", "rate_hz", "t0_s", "x", "s", "n").alias("h"))
    for kind, df in sorted(bundle.artifacts.items()):
        rest = [c for c in df.columns if c != "group_id"]
        rows = rows.unionByName(df.select("group_id", F.xxhash64(F.lit(kind), F.to_json(F.struct(*rest))).alias("h")))
    return rows.groupBy("group_id").agg(F.sha2(F.concat_ws("|", F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.count("*")), 256).alias("input_hash"))


def cache_keys(hashes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """group_id, stage_ordinal and cache_key (null from an impure stage on) of each group and stage."""
    stages_ = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_ordinal"), F.lit(k).alias("k")) for i, k in enumerate(keys)])).alias("s")
    d = hashes.select("group_id", "input_hash", stages_)
    return d.select("group_id", "s.stage_ordinal", F.when(F.col("s.k") != "", F.sha2(F.concat_ws("|", "s.k", "input_hash"), 256)).alias("cache_key"))


def plan_incremental(hashes: DataFrame, keys: Sequence[str], cache: DataFrame) -> DataFrame:
    """group_id, stage_ordinal, cache_key and hit: which stages of a group a cache (cache_key) has for its input.

    Keys hold all stages before, so hits of a group are a run of stages from the first on, and the rest is run again.
    """
    d = cache_keys(hashes, keys).join(cache.select("cache_key", F.lit(True).alias("_hit")).distinct(), "cache_key", "left")
    before = W.partitionBy("group_id").orderBy("stage_ordinal").rowsBetween(W.unboundedPreceding, 0)
    return d.select("group_id", "stage_ordinal", "cache_key", F.bool_and(F.coalesce("_hit", F.lit(False))).over(before).alias("hit"))


def resumable(hashes: DataFrame, keys: Sequence[str], recorded: DataFrame) -> DataFrame:
    """group_id, stage and run_id: the last stage of each group whose outcome a run has recorded (run_keys), of several runs the latest.

    A key holds the input and all stages up to its own, so it says enough by itself; groups without any have no row.
    """
    d = cache_keys(hashes, keys).join(recorded.select("cache_key", "run_id"), "cache_key")
    return d.groupBy("group_id").agg(F.max(F.struct("stage_ordinal", "run_id")).alias("m")).select("group_id", F.col("m.stage_ordinal").alias("stage"), "m.run_id")


def stored_bundle(read: Callable[[str], DataFrame | None], chosen: DataFrame, stage: int) -> Bundle:
    """What a stage left to the next, for chosen groups (group_id, run_id), from run tables that read() gives."""

    def of(name: str) -> DataFrame | None:
        df = read(name)
        return None if df is None else df.where(F.col("stage_ordinal") <= stage).join(chosen, ["group_id", "run_id"], "left_semi").drop("run_id")

    samples, states, properties, rows = (of(n) for n in ("samples", "states", "properties", "artifacts"))
    here = lambda df: df.where(F.col("stage_ordinal") == stage).drop("stage_ordinal")
    artifacts = {}
    if rows is not None:  # of a port the last stage that gave it counts; ports and their schemas are a few
        rows = rows.join(rows.groupBy("group_id", "port").agg(F.max("stage_ordinal").alias("stage_ordinal")), ["group_id", "port", "stage_ordinal"], "left_semi")
        for port, kind in rows.select("port", "schema").distinct().collect():
            artifacts[port] = rows.where(F.col("port") == port).select("group_id", F.from_json("payload", kind, {"allowNonNumericNumbers": "true"}).alias("p")).select("group_id", "p.*")
    return Bundle(here(samples), here(states), artifacts, None if properties is None else here(properties))


def run_incremental(bundle: Bundle, pipeline: Sequence[Stage], path: str, run_id: str) -> Run:
    """Runs a pipeline, each group from the stage after the last one that a run under path has recorded for its input, and records it.

    A group whose stages are all recorded isn't run; one with an edited stage n begins there, with the samples, signals,
    artifacts and properties that stage n - 1 left; new input begins at the source. All groups are one run: those that begin
    later join in at their stage. Records of the stages that aren't run are copied, so that the new run (run_id) has them all.
    The result holds the groups that were run.
    """
    spark, hashes = bundle.samples.sparkSession, stored(input_hashes(bundle))

    def read(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/run_{name}").withColumn("run_id", F.col("run_id").cast("string"))
        except AnalysisException:  # no run has written it
            return None

    keys, recorded = stage_keys(pipeline), read("keys")
    none = hashes.where("false").select("group_id", F.lit(None).cast("int").alias("stage"), F.lit(None).cast("string").alias("run_id"))
    found = stored(resumable(hashes, keys, recorded)) if recorded is not None else none
    begins = [r[0] for r in found.select("stage").distinct().collect()]  # a number of stages at most
    last = len(keys) - 1
    joining = {k: stored_bundle(read, found.where(F.col("stage") == k).select("group_id", "run_id"), k) for k in begins if k < last}
    result = run_groups(bundle.of_groups_without(found), pipeline, joining)
    copied = {}
    if begins:
        for name in ("signals", "metrics", "notes", "artifacts", "samples", "states", "properties"):
            if (df := read(name)) is not None:
                copied[name] = df.join(found, ["group_id", "run_id"]).where(F.col("stage_ordinal") <= F.col("stage")).drop("stage", "run_id")
        reused = cache_keys(hashes, keys).join(found, "group_id").where(F.col("stage_ordinal") <= F.col("stage"))
        copied["keys"] = reused.join(recorded.select("cache_key").distinct(), "cache_key", "left_semi").select("group_id", "stage_ordinal", "cache_key")
        copied["groups"] = found.where(F.col("stage") == last).select("group_id", F.lit("ok").alias("status"), F.lit(None).cast("int").alias("failed_stage"), F.lit(None).cast("string").alias("message"))
    write_run(result, path, run_id, pipeline, hashes.join(found.where(F.col("stage") == last), "group_id", "left_anti"), copied, found)
    return result


def run(samples: DataFrame, pipeline: Sequence[Stage]) -> DataFrame:
    """The samples that a pipeline of stages makes of samples alone; signals are named by their ids."""
    signals = samples.groupBy(*KEY).agg(F.min("t_s").alias("t0_s"))
    order = W.partitionBy("group_id").orderBy("signal_id")
    signals = signals.select(*KEY, (F.row_number().over(order) - 1).cast("int").alias("ordinal"), F.col("signal_id").cast("string").alias("name"), F.lit("analog").alias("domain"), F.lit(None).cast("double").alias("rate_hz"), "t0_s", F.create_map().cast("map<string,string>").alias("attributes"))
    return run_groups(Bundle(samples, signals), pipeline, keep=False).last.samples
