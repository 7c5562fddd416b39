"""The registered queries of the signal operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.functions.expressions import expression
from sigtables.functions.scalars import normalise_key, r6
from sigtables.model import RATE_HZ, pulses, samples, shared_folder, signals, table
from sigtables.operators import catalog, generate, library, profile, regress, specs, stages, transaction
from sigtables.plans import comparison, pipeline
from sigtables.sources import pulse_csv
from sigtables.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S = "s AS (SELECT label AS group_id, vec_id AS signal_id, i - 1 AS idx, (i - 1) / 64.0::DOUBLE AS t_s, embedding[i]::DOUBLE AS value FROM embeddings CROSS JOIN range(1, 65) r(i))"
P = "p AS (SELECT user_id AS group_id, event_id AS pulse_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/1e6::DOUBLE AS toa_s, event_type, value, (props::JSON->>'k')::DOUBLE AS k FROM events)"
DET = "dec AS (SELECT *, coalesce(last_value(CASE WHEN value >= 0.1 THEN 1 WHEN value <= 0.05 THEN 0 END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS o FROM s), edge AS (SELECT *, sum(CASE WHEN o = 1 AND prev = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY signal_id ORDER BY idx), 0) AS prev FROM dec)), det AS (SELECT group_id, signal_id, min(t_s) AS start_s, max(t_s) + 1/64.0::DOUBLE AS end_s, max(value) AS peak FROM edge WHERE o = 1 GROUP BY group_id, signal_id, isl)"


def r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0::DOUBLE"


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


STATS = ("min", "max", "mean", "rms", "variance", "peak_to_peak", "std")


@query(f'SELECT group_id, signal_id, count(value) AS count, 0::BIGINT AS non_finite, {", ".join(f"{r(e)} AS {n}" for n, e in zip(STATS, ("min(value)", "max(value)", "avg(value)", "sqrt(avg(value*value))", "var_pop(value)", "max(value)-min(value)", "stddev_pop(value)")))} FROM s GROUP BY ALL', S)
def signal_stats(spark, d):
    return rounded(profile.summarise(samples(spark, d), "group_id", "signal_id"), *STATS)


@query("SELECT group_id, (CASE WHEN value < -0.5 THEN -1 WHEN value > 0.5 THEN 64 ELSE least(floor((value + 0.5) / 1.0::DOUBLE * 64), 63) END)::BIGINT AS bin, count(*) AS n FROM s GROUP BY ALL", S)
def histogram(spark, d):
    return profile.histogram(samples(spark, d), 64, -0.5, 0.5, "group_id")


@query("SELECT signal_id, count(*) FILTER (prev <> sg) AS crossings FROM (SELECT signal_id, sign(value) AS sg, lag(sign(value)) OVER (PARTITION BY signal_id ORDER BY idx) AS prev FROM s WHERE value <> 0) GROUP BY ALL", S)
def zero_crossings(spark, d):
    return profile.zero_crossings(samples(spark, d), "signal_id")


@query(f"SELECT signal_id, level, idx >> (3 + level) AS cell, {r('min(value)')} AS low, {r('max(value)')} AS high FROM s CROSS JOIN (SELECT range::INTEGER AS level FROM range(4)) GROUP BY ALL", S)
def pyramid(spark, d):
    return rounded(profile.pyramid(samples(spark, d), 8, 4, "signal_id"), "low", "high")


@query(f"SELECT signal_id, least(floor((t_s - 0.25) / 0.5 * 10), 9)::BIGINT AS px, {r('min(value * -2 + 1)')} AS low, {r('max(value * -2 + 1)')} AS high FROM s WHERE t_s >= 0.25 AND t_s < 0.75 GROUP BY ALL", S)
def viewport_minmax(spark, d):
    return rounded(profile.viewport(samples(spark, d), 0.25, 0.75, 10, "signal_id", gain=-2.0, offset=1.0), "low", "high")


@query("SELECT signal_id, idx >> 3 AS cell, CASE WHEN min(value) >= 0 THEN 'high' WHEN max(value) < 0 THEN 'low' ELSE 'transition' END AS lane FROM s GROUP BY ALL", S)
def logic_lane(spark, d):
    return profile.logic_lane(profile.pyramid(samples(spark, d), 8, 1, "signal_id"), 0.0).select("signal_id", "cell", "lane")


def _stage(df):
    return rounded(df, "value").select("signal_id", "idx", "value")


@query(f"SELECT signal_id, idx, {r('value * 2.5')} AS value FROM s", S)
def gain(spark, d):
    return _stage(stages.gain(samples(spark, d), 2.5))


@query(f"SELECT signal_id, idx, {r('value - avg(value) OVER (PARTITION BY signal_id)')} AS value FROM s", S)
def detrend_mean(spark, d):
    return _stage(stages.detrend(samples(spark, d)))


@query(f"SELECT s.signal_id, idx, {r('value - m - sl * (idx - c)')} AS value FROM s JOIN (SELECT signal_id, avg(value) AS m, regr_slope(value, idx) AS sl, avg(idx) AS c FROM s GROUP BY ALL) f USING (signal_id)", S)
def detrend_linear(spark, d):
    return _stage(stages.detrend(samples(spark, d), "linear"))


@query(f"SELECT signal_id, idx, {r('value / max(abs(value)) OVER (PARTITION BY signal_id)')} AS value FROM s", S)
def normalise(spark, d):
    return _stage(stages.normalise(samples(spark, d)))


def _biquad_sql(response: str, cutoff_hz: float, q: float, rows: str) -> str:
    b0, b1, b2, a1, a2 = (f"CAST({c!r} AS DOUBLE)" for c in stages.biquad_coefficients(response, cutoff_hz, RATE_HZ, q))
    cell = "coalesce(CASE WHEN y.idx >= {k} THEN e.embedding[y.idx + 1 - {k}]::DOUBLE END, 0)"
    step = f"{b0} * {cell.format(k=0)} + {b1} * {cell.format(k=1)} + {b2} * {cell.format(k=2)} - {a1} * y.y1 - {a2} * y.y2"
    return f"WITH RECURSIVE y(signal_id, idx, y1, y2) AS (SELECT vec_id, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM embeddings UNION ALL SELECT y.signal_id, y.idx + 1, {step}, y.y1 FROM y JOIN embeddings e ON e.vec_id = y.signal_id WHERE y.idx < 64) {rows}"


@query(_biquad_sql("low", 8.0, 0.5**0.5, f"SELECT signal_id, {r('y1')} AS last_value FROM y WHERE idx = 64"))
def biquad_lowpass(spark, d):
    out = stages.filter_signals(signals(spark, d), "low", 8.0, RATE_HZ)
    return out.select("signal_id", r6(F.element_at("values", -1)).alias("last_value"))


def _filtered(spark, d, response, cutoff_hz, q):
    """Every sample, filtered in blocks of 16."""
    return _stage(stages.filter_samples(samples(spark, d), response, cutoff_hz, RATE_HZ, q, block=16))


@query(_biquad_sql("high", 4.0, 0.9, f"SELECT signal_id, idx - 1 AS idx, {r('y1')} AS value FROM y WHERE idx > 0"))
def biquad_highpass(spark, d):
    return _filtered(spark, d, "high", 4.0, 0.9)


@query(_biquad_sql("band", 10.0, 2.0, f"SELECT signal_id, idx - 1 AS idx, {r('y1')} AS value FROM y WHERE idx > 0"))
def biquad_bandpass(spark, d):
    return _filtered(spark, d, "band", 10.0, 2.0)


@query(_biquad_sql("notch", 12.0, 1.5, f"SELECT signal_id, idx - 1 AS idx, {r('y1')} AS value FROM y WHERE idx > 0"))
def biquad_notch(spark, d):
    return _filtered(spark, d, "notch", 12.0, 1.5)


@query("SELECT signal_id, k::INTEGER AS k, k::DOUBLE AS freq_hz, round(20 * log10(greatest(sqrt(pow(sum(value * w * cos(2 * pi() * k * idx / 64)), 2) + pow(sum(value * w * sin(2 * pi() * k * idx / 64)), 2)) / 32 * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END), 1e-15)), 3) + 0.0::DOUBLE AS magnitude_db FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * idx / 64) AS w FROM s) CROSS JOIN range(0, 33) b(k) GROUP BY signal_id, k", S)
def spectrum(spark, d):
    out = stages.spectrum(signals(spark, d), RATE_HZ)
    return out.select("signal_id", "k", "freq_hz", (F.round("magnitude_db", 3) + F.lit(0.0)).alias("magnitude_db"))


@query("SELECT signal_id, k::INTEGER AS k, k::DOUBLE AS freq_hz, round(20 * log10(greatest(sqrt(pow(sum(value * w * cos(2 * pi() * k * idx / 64)), 2) + pow(sum(value * w * sin(2 * pi() * k * idx / 64)), 2)) / 32 * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END), 1e-15)), 3) + 0.0::DOUBLE AS magnitude_db FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * idx / 64) AS w FROM s) CROSS JOIN range(0, 33) b(k) GROUP BY signal_id, k", S)
def spectrum_long(spark, d):
    """By tasks that hold two columns or rows of a signal's matrix each."""
    out = stages.long_spectrum(samples(spark, d), RATE_HZ, columns=2)
    return out.select("signal_id", "k", "freq_hz", (F.round("magnitude_db", 3) + F.lit(0.0)).alias("magnitude_db"))


def _window_sql(window: str) -> str:
    w = " + ".join(f"({(-1) ** i * a!r})::DOUBLE * cos(2 * pi() * {i} * idx / 64)" for i, a in enumerate(stages.WINDOWS[window]))
    half = "(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END)"
    power = "pow(sum(value * w * cos(2 * pi() * k * idx / 64)), 2) + pow(sum(value * w * sin(2 * pi() * k * idx / 64)), 2)"
    return f"SELECT signal_id, k::INTEGER AS k, round(20 * log10(greatest(sqrt({power}) / sum(w) * {half}, 1e-15)), 3) + 0.0::DOUBLE AS magnitude_db FROM (SELECT *, {w} AS w FROM s) CROSS JOIN range(0, 33) b(k) GROUP BY signal_id, k"


def _spectrum(spark, d, window):
    return stages.spectrum(signals(spark, d), RATE_HZ, window).select("signal_id", "k", (F.round("magnitude_db", 3) + F.lit(0.0)).alias("magnitude_db"))


@query(_window_sql("rect"), S)
def spectrum_rect(spark, d):
    return _spectrum(spark, d, "rect")


@query(_window_sql("hamming"), S)
def spectrum_hamming(spark, d):
    return _spectrum(spark, d, "hamming")


@query(_window_sql("blackman-harris"), S)
def spectrum_blackman_harris(spark, d):
    return _spectrum(spark, d, "blackman-harris")


@query(_window_sql("flat-top"), S)
def spectrum_flat_top(spark, d):
    return _spectrum(spark, d, "flat-top")


@query(f"SELECT signal_id, k / 1.0::DOUBLE AS peak_hz, round(db, 3) + 0.0::DOUBLE AS peak_db, 64 AS fft_size FROM (SELECT signal_id, k, 20 * log10(greatest(sqrt(pow(sum(value * w * cos(2 * pi() * k * idx / 64)), 2) + pow(sum(value * w * sin(2 * pi() * k * idx / 64)), 2)) / 32 * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END), 1e-15)) AS db FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * idx / 64) AS w FROM s) CROSS JOIN range(0, 33) b(k) GROUP BY signal_id, k) QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY db DESC, k) = 1", S)
def spectrum_peak(spark, d):
    m = stages.spectrum_metrics(stages.spectrum(signals(spark, d), RATE_HZ))
    return m.select("signal_id", "peak_hz", (F.round("peak_db", 3) + F.lit(0.0)).alias("peak_db"), "fft_size")


def _detections(spark, d):
    return stages.threshold(samples(spark, d), 0.1, 0.05, period_s=1 / RATE_HZ)


@query(f"SELECT group_id, signal_id, {r('start_s')} AS start_s, {r('end_s')} AS end_s, {r('peak')} AS peak FROM det", S, DET)
def threshold(spark, d):
    return rounded(_detections(spark, d), "start_s", "end_s", "peak")


@query(f"SELECT group_id, count(*) AS pulses, {r('avg(w)')} AS width_mean, {r('min(w)')} AS width_min, {r('max(w)')} AS width_max, {r('stddev_samp(w)')} AS width_jitter, {r('avg(pri)')} AS pri_mean, {r('stddev_samp(pri)')} AS pri_jitter, {r('sum(w)')} AS duty, {r('max(peak)')} AS peak_max, {r('1/avg(pri)')} AS prf_hz FROM (SELECT *, end_s - start_s AS w, start_s - lag(start_s) OVER (PARTITION BY signal_id ORDER BY start_s) AS pri FROM det) GROUP BY group_id", S, DET)
def pulse_metrics(spark, d):
    return rounded(stages.pulse_metrics(_detections(spark, d), 1.0), "width_mean", "width_min", "width_max", "width_jitter", "pri_mean", "pri_jitter", "duty", "peak_max", "prf_hz")


@query(f"SELECT group_id, signal_id, count(*) FILTER (prev <> bit) AS transitions, {r('avg(bit)')} AS duty FROM (SELECT *, lag(bit) OVER (PARTITION BY signal_id ORDER BY idx) AS prev FROM (SELECT *, coalesce(last_value(CASE WHEN value > 0.025 THEN 1 WHEN value < -0.025 THEN 0 END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS bit FROM s)) GROUP BY ALL", S)
def slice(spark, d):
    return rounded(stages.slice_metrics(stages.slice_levels(samples(spark, d), 0.0, 0.05)), "duty")


SYM = "sym AS (SELECT group_id, signal_id, (idx - 2) // 4 AS k, (value > -0.1)::INTEGER + (value > 0)::INTEGER + (value > 0.1)::INTEGER AS symbol, least(abs(value + 0.1), abs(value), abs(value - 0.1)) AS margin FROM s WHERE idx % 4 = 2)"


def _symbols(spark, d):
    return stages.symbols(samples(spark, d), 16.0, RATE_HZ, [-0.15, -0.05, 0.05, 0.15])


@query(f"SELECT signal_id, k, symbol, {r('margin')} AS margin FROM sym", S, SYM)
def symbols(spark, d):
    return rounded(_symbols(spark, d), "margin").select("signal_id", "k", "symbol", "margin")


@query("SELECT signal_id, place // 8 AS word, sum(bit * pow(2, 7 - place % 8))::BIGINT AS value, string_agg(bit::VARCHAR, '' ORDER BY place) AS bits FROM (SELECT signal_id, k * 2 + b AS place, (symbol >> (1 - b)) & 1 AS bit FROM sym CROSS JOIN (SELECT range::INTEGER AS b FROM range(2))) GROUP BY ALL", S, SYM)
def bitpack(spark, d):
    return stages.pack_bits(_symbols(spark, d), 8, 2).select("signal_id", "word", "value", "bits")


PEAKS = "top AS (SELECT * FROM (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY idx)) WHERE value > p AND value > n), ground AS (SELECT t.group_id, t.signal_id, t.idx, t.t_s, t.value, max(CASE WHEN s.idx < t.idx AND s.value > t.value THEN s.idx END) AS l, min(CASE WHEN s.idx > t.idx AND s.value > t.value THEN s.idx END) AS r FROM top t JOIN s USING (signal_id) GROUP BY ALL), prom AS (SELECT g.group_id, g.signal_id, g.idx, g.t_s, g.value, g.value - greatest(min(CASE WHEN s.idx <= g.idx AND s.idx > coalesce(g.l, -1) THEN s.value END), min(CASE WHEN s.idx >= g.idx AND s.idx < coalesce(g.r, 64) THEN s.value END)) AS h FROM ground g JOIN s USING (signal_id) GROUP BY g.group_id, g.signal_id, g.idx, g.t_s, g.value, g.l, g.r)"


@query(f"SELECT group_id, signal_id, {r('t_s')} AS time_s, {r('value')} AS amplitude, {r('h')} AS prominence FROM prom WHERE h >= 0.1", S, PEAKS)
def peaks(spark, d):
    return rounded(stages.peaks(signals(spark, d), RATE_HZ, 0.1), "time_s", "amplitude", "prominence")


@query(f"SELECT group_id, signal_id, {r('t_s')} AS time_s, {r('value')} AS amplitude, {r('h')} AS prominence FROM prom QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY value DESC, idx) <= 3", S, PEAKS)
def peaks_topk(spark, d):
    return rounded(stages.peaks(signals(spark, d), RATE_HZ, max_count=3), "time_s", "amplitude", "prominence")


@query(f"SELECT group_id, signal_id, {r('t_s')} AS time_s, {r('-value')} AS amplitude, {r('h')} AS prominence FROM prom WHERE h >= 0.2", S.replace("embedding[i]::DOUBLE AS value", "-embedding[i]::DOUBLE AS value"), PEAKS)
def peaks_falling(spark, d):
    return rounded(stages.peaks(signals(spark, d), RATE_HZ, 0.2, falling=True), "time_s", "amplitude", "prominence")


@query(f"SELECT signal_id, idx, {r('value + (nx - value) * f')} AS value FROM (SELECT s.signal_id, k AS idx, value, nx, k * 2.0::DOUBLE / 3 - s.idx AS f FROM (SELECT *, lead(value) OVER (PARTITION BY signal_id ORDER BY idx) AS nx FROM s) s JOIN range(0, 96) g(k) ON s.idx = floor(k * 2 / 3.0::DOUBLE)) WHERE nx IS NOT NULL", S)
def resample(spark, d):
    return _stage(stages.resample(samples(spark, d), 64.0, 96.0))


def _u(stream: int) -> str:
    return f"(('0x' || substr(md5(signal_id::VARCHAR || '|' || idx::VARCHAR || '|{stream}'), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


@query(f"SELECT signal_id, idx, {r('value + sqrt(pw / 10 / q) * n')} AS value FROM (SELECT *, avg(value * value) OVER w AS pw, avg(n * n) OVER w AS q FROM (SELECT *, sqrt(-2 * ln(1 - {_u(2)})) * cos(2 * pi() * {_u(3)}) AS n FROM s) WINDOW w AS (PARTITION BY signal_id))", S)
def awgn(spark, d):
    return _stage(stages.add_noise(samples(spark, d), 10.0))


@query(f"SELECT signal_id, idx, {r('sin(2 * pi() * 4 * t_s) * (1 + 0.5 * value)')} AS value FROM s", S)
def modulate_am(spark, d):
    return _stage(stages.modulate_am(samples(spark, d), 4.0, 0.5))


@query(f"SELECT signal_id, idx, {r('value * (CASE WHEN least(t_s, 1 - t_s) >= 0.125 THEN 1 ELSE 0.5 * (1 - cos(pi() * greatest(least(t_s, 1 - t_s), 0) / 0.125)) END)')} AS value FROM s", S)
def envelope(spark, d):
    return _stage(stages.envelope_tukey(samples(spark, d), 1.0, 0.25))


@query(f"SELECT group_id, signal_id, rung::INTEGER AS rung, {r('0.5 + 0.25 * rung')} AS gain, {r('max(abs(value)) * (0.5 + 0.25 * rung)')} AS peak FROM s CROSS JOIN range(0, 5) g(rung) GROUP BY group_id, signal_id, rung", S)
def sweep_rungs(spark, d):
    s = generate.sweep(samples(spark, d), "gain", generate.rungs(start=0.5, stop=1.5, step=0.25))
    s = s.groupBy("group_id", F.expr("signal_id div 5").alias("signal_id"), "rung", "gain").agg(F.max(F.abs(F.col("value") * F.col("gain"))).alias("peak"))
    return rounded(s, "gain", "peak").select("group_id", "signal_id", "rung", "gain", "peak")


@query(f"SELECT rung AS group_id, {r('0.5 + 0.25 * rung')} AS gain, count(*) AS samples, {r('max(abs(value)) * (0.5 + 0.25 * rung)')} AS peak FROM s CROSS JOIN range(0, 5) g(rung) GROUP BY rung", S)
def sweep_ladder(spark, d):
    s = generate.sweep(samples(spark, d), "gain", generate.rungs([0.5, 0.75, 1.0, 1.25, 1.5]), "group-per-rung")
    s = s.groupBy("group_id", "gain").agg(F.count("*").alias("samples"), F.max(F.abs(F.col("value") * F.col("gain"))).alias("peak"))
    return rounded(s, "gain", "peak")


@query("SELECT group_id, pulse_id FROM p WHERE value BETWEEN 20 AND 80 AND k >= 50", P)
def pulse_search(spark, d):
    return catalog.search_pulses(pulses(spark, d), [("value", 20.0, 80.0), ("k", 50.0, None)]).select("group_id", "pulse_id")


@query("SELECT group_id FROM p GROUP BY group_id HAVING max(value) >= 200 AND min(k) <= 3", P)
def zone_map_prune(spark, d):
    return catalog.candidate_groups(catalog.zone_maps(pulses(spark, d), ["value", "k"]), [("value", 200.0, None), ("k", None, 3.0)])


def _properties(spark, d):
    """Attributes of mixed types for each event: a number, a text, a boolean, a text that looks like a number, a null and an array."""
    e = table(spark, d, "events")
    code = F.lpad(F.col("event_id").cast("string"), 8, "0")
    attributes = F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"), (F.col("value") > 50).alias("high"), code.alias("code"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user"), F.array(F.col("event_id") % 5).alias("list"))
    return e.select("event_id", F.to_json(attributes, {"ignoreNullFields": "false"}).alias("attributes"))


PROPS = "props AS (SELECT event_id AS id, unnest(['k', 'type', 'high', 'code', 'user', 'list']) AS key, unnest([(props::JSON->>'k')::DOUBLE, NULL, (value > 50)::INTEGER, NULL, CASE WHEN event_id % 3 = 0 THEN user_id END, NULL]::DOUBLE[]) AS num_value, unnest([NULL, event_type, NULL, lpad(event_id::VARCHAR, 8, '0'), NULL, '[' || event_id % 5 || ']']) AS txt_value FROM events)"


def _index(spark, d):
    return catalog.property_index(_properties(spark, d), "event_id", "attributes")


@query("SELECT id, key, num_value, txt_value FROM props WHERE num_value IS NOT NULL OR txt_value IS NOT NULL", PROPS)
def property_index(spark, d):
    return _index(spark, d)


@query("SELECT id FROM props WHERE key = 'k' AND num_value BETWEEN 10 AND 20", PROPS)
def property_filter(spark, d):
    return catalog.find_signals(_index(spark, d), "k", catalog.PropertyTest(10, 20))


@query("SELECT id FROM props WHERE key = 'type' AND txt_value = 'click'", PROPS)
def property_equals(spark, d):
    return catalog.find_signals(_index(spark, d), "type", catalog.PropertyTest(equals="click"))


@query("SELECT id FROM props WHERE key = 'user' AND num_value IS NOT NULL", PROPS)
def property_exists(spark, d):
    return catalog.find_signals(_index(spark, d), "user")


FORMS = {"": "num_value IS NOT NULL", "12": "num_value = 12", ">= 90": "num_value >= 90", ">90": "num_value >= 90", "<=5": "num_value <= 5", "<5": "num_value <= 5", "10..12": "num_value BETWEEN 10 AND 12", "97..": "num_value >= 97", "=7": "num_value = 7", "word": "txt_value = 'word'"}


@query("SELECT form, count(*) FILTER (ok) AS n FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in FORMS) + "]) AS form, unnest([" + ", ".join(f"coalesce({c}, false)" for c in FORMS.values()) + "]) AS ok FROM props WHERE key = 'k') GROUP BY form", PROPS)
def property_query_forms(spark, d):
    index = _index(spark, d)
    parts = [catalog.find_signals(index, "k", form).agg(F.lit(form).alias("form"), F.count("*").alias("n")).select("form", "n") for form in FORMS]
    return pipeline.union(parts)


@query("SELECT key, count(*) AS n FROM props WHERE num_value IS NOT NULL OR txt_value IS NOT NULL GROUP BY key", PROPS)
def property_key_counts(spark, d):
    return catalog.property_key_counts(_index(spark, d))


@query("SELECT event_id AS id, 'value' AS key, CASE WHEN value < 1 THEN 'too_low' ELSE 'too_high' END AS error FROM events WHERE value < 1 OR value > 100 UNION ALL SELECT event_id, 'k', 'too_high' FROM events WHERE (props::JSON->>'k')::DOUBLE > 90")
def property_validate(spark, d):
    rows = table(spark, d, "events").withColumn("attributes", F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")))
    return catalog.validate_properties(rows, "event_id", "attributes", [catalog.Property("value", "number", 1.0, 100.0), catalog.Property("k", "integer", 0, 90)])


@query("SELECT id, key, num_value, txt_value FROM (SELECT event_id AS id, unnest(['value', 'flag', 'type', 'owner']) AS key, unnest([value, (event_id % 2)::DOUBLE, NULL, NULL]) AS num_value, unnest([NULL, NULL, CASE WHEN event_type IN ('click', 'view') THEN event_type END, 'nobody']) AS txt_value FROM events) WHERE num_value IS NOT NULL OR txt_value IS NOT NULL")
def property_types(spark, d):
    flag = F.when(F.col("event_id") % 2 == 1, " Yes ").otherwise("off")
    rows = table(spark, d, "events").withColumn("attributes", F.create_map(F.lit("value"), F.concat(F.lit(" "), F.col("value").cast("string")), F.lit("flag"), flag, F.lit("type"), F.col("event_type"), F.lit("owner"), F.lit("")))
    kinds = [catalog.Property("value", "number"), catalog.Property("flag", "bool"), catalog.Property("type", "enum", options=("click", "view")), catalog.Property("owner", "text", default="nobody")]
    return catalog.typed_properties(rows, "event_id", "attributes", kinds)


TEXT = f"words AS (SELECT p_partkey AS id, list_filter(list_concat(string_split(lower(p_name), ' '), list_concat(string_split(replace(lower(p_brand), '#', ' '), ' '), string_split(lower(p_type), ' '))), lambda x: x <> '') AS w FROM part), tf AS (SELECT id, len(w) AS words, len(list_filter(w, lambda x: starts_with(x, 'sm'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'e'))) AS b FROM words), whole AS (SELECT count(*) AS n, avg(words) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf)"


@query(f"SELECT id, a + b AS matches, {r('ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))')} AS score FROM tf CROSS JOIN whole WHERE a > 0 AND b > 0", TEXT)
def text_search(spark, d):
    return rounded(catalog.text_search(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], "SM e"), "score")


def _tags(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.col("p_brand"), F.col("p_type"), F.element_at(F.split("p_name", " "), 1))).alias("tag"))


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'ECONOMY' AND string_split(p_name, ' ')[1] = 'small'")
def all_tags(spark, d):
    return catalog.all_tags(_tags(spark, d), ["ECONOMY", "small"])


@query("SELECT tag, count(*) FILTER (own) AS n FROM (SELECT unnest(list_distinct([p_brand, p_type, string_split(p_name, ' ')[1]])) AS tag, p_size >= 10 AS own FROM part) GROUP BY ALL")
def tag_counts(spark, d):
    known = _tags(spark, d)
    used = known.join(table(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("id")), "id")
    return catalog.tag_counts(used, known)


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'ECONOMY' AND list_bool_or(list_transform(string_split(lower(p_name), ' '), lambda x: starts_with(x, 'r'))) AND p_size BETWEEN 5 AND 30")
def library_filter(spark, d):
    part = table(spark, d, "part")
    out = part.where("p_size BETWEEN 5 AND 30").select(F.col("p_partkey").alias("id"))
    return out.join(catalog.all_tags(_tags(spark, d), ["ECONOMY"]), "id", "left_semi").join(catalog.text_search(part, "p_partkey", "p_name", "r"), "id", "left_semi")


@query("SELECT 'region' AS entity, count(*) AS n, sum(8 + strlen(r_name))::BIGINT AS bytes FROM region UNION ALL SELECT 'events', count(*), sum(8 + 8 + strlen(event_type) + 8)::BIGINT FROM events UNION ALL SELECT 'embeddings', count(*), sum(8 + 64 * 4 + 4)::BIGINT FROM embeddings")
def library_summary(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    embeddings = table(spark, d, "embeddings").select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("int"))
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("long"), "r_name")
    return library.summary({"region": region, "events": events, "embeddings": embeddings})


@query("SELECT lower(replace(replace(p_brand, '#', '_'), ' ', '_')) AS key, count(*) AS n FROM part GROUP BY ALL")
def normalised_keys(spark, d):
    return table(spark, d, "part").groupBy(normalise_key(F.col("p_brand")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS copies, min(vec_id) AS signal_id FROM embeddings CROSS JOIN range(0, 2) c(k) GROUP BY CASE WHEN k = 1 AND vec_id % 3 = 0 THEN 'x' || vec_id ELSE embedding::VARCHAR END")
def content_dedupe(spark, d):
    """Each signal twice; of the second copies every third differs in its first value by 1e-11."""
    s = signals(spark, d)
    moved = F.transform("values", lambda v, i: F.when(i == 0, v + 1e-11).otherwise(v))
    twice = s.unionByName(s.withColumn("values", F.when(F.col("signal_id") % 3 == 0, moved).otherwise(F.col("values"))))
    return catalog.content_classes(twice).select("copies", "signal_id")


@query(f"SELECT signal_id, idx, {r('value')} AS value FROM s WHERE idx BETWEEN 16 AND 31", S)
def value_page(spark, d):
    return _stage(library.pages(samples(spark, d), 1, 16))


@query(f"SELECT signal_id, idx, {r('value * 2 + 1')} AS value FROM s WHERE signal_id = 7 AND idx BETWEEN 10 AND 40", S)
def read_range(spark, d):
    folder = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    stored, _ = library.write_signals(samples(spark, d), folder)
    return _stage(library.read_range(stored, 7, 10, 41, 2.0, 1.0))


@query(f"SELECT signal_id, count(*) AS count, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('avg(value)')} AS mean FROM s GROUP BY signal_id", S)
def library_signals(spark, d):
    _, kept = library.write_signals(samples(spark, d), f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")
    return rounded(kept.select("signal_id", "count", "min", "max", "mean"), "min", "max", "mean")


@query("SELECT group_id, key, min(v) AS low, max(v) AS high FROM (SELECT group_id, unnest(['value', 'k']) AS key, unnest([value, k]) AS v FROM p) GROUP BY ALL", P)
def library_fields(spark, d):
    p = pulses(spark, d).withColumnRenamed("pulse_id", "idx")
    return library.write_pulses(p, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}", ["value", "k"])[1]


@query("SELECT group_id, pulse_id AS idx, value, k FROM p WHERE pulse_id = (SELECT max(pulse_id) FROM p WHERE group_id = 3) AND group_id = 3", P)
def read_record(spark, d):
    p = pulses(spark, d).withColumnRenamed("pulse_id", "idx")
    last = p.where("group_id = 3").agg(F.max("idx")).first()[0]
    return library.read_record(p, 3, last).select("group_id", "idx", "value", "k")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_name) DESC, p_partkey) AS place FROM part")
def sort_by_text(spark, d):
    return _numbered(catalog.places(table(spark, d, "part"), "p_name", False, "p_partkey"))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY CASE WHEN p_size % 7 <> 0 THEN p_size END ASC NULLS LAST, p_partkey) AS place FROM part")
def sort_by_number(spark, d):
    part = table(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    return _numbered(catalog.places(part, "p_size", True, "p_partkey"))


def _numbered(df):
    return df.select(F.col("p_partkey").alias("id"), (F.col("place") + 1).alias("place"))


@query("SELECT o_orderkey AS group_id, o_custkey AS train_id, c_nationkey AS train_ord FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def groups_of_dataset(spark, d):
    trains = table(spark, d, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("train_id"), F.col("c_nationkey").alias("train_ord"))
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("train_id"), F.col("o_orderdate").alias("group_ord"))
    return library.groups_of_dataset(trains, groups, "BUILDING").select("group_id", "train_id", "train_ord")


@query("SELECT event_type AS kind, count(*) AS contents, sum(user_id)::BIGINT AS bytes, sum(CASE WHEN event_id % 4 = 0 THEN user_id ELSE 0 END)::BIGINT AS unreferenced_bytes FROM events GROUP BY event_type")
def storage_by_kind(spark, d):
    e = table(spark, d, "events")
    return library.storage(e.select(F.col("event_type").alias("kind"), F.col("user_id").alias("byte_len"), (F.col("event_id") % 4).alias("refcount")))


def _stored(spark, d):
    """contents of parts, references to them from three tables, and their data, with faults that ids decide."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    raw = F.col("p_name").cast("binary")
    n = F.col("p_partkey")
    checksum = F.when(n % 11 == 0, F.concat(F.lit("pending:"), n.cast("string"))).when(n % 13 == 0, F.lit("0")).otherwise(F.sha2(raw, 256))
    contents = part.select(n.alias("content"), (F.octet_length(raw) + F.when(n % 17 == 0, 1).otherwise(0)).cast("long").alias("byte_len"), checksum.alias("checksum"), F.when(n % 5 == 0, 2).otherwise(1).cast("long").alias("refcount"))
    data = part.select(n.alias("content"), raw.alias("data"))
    signal_ = part.where("p_partkey % 7 != 0").select(n.alias("id"), F.when(n % 19 == 0, -n).otherwise(n).alias("content"), F.lit(None).cast("long").alias("time_content"))
    fields = part.where("p_partkey % 10 = 0").select(n.alias("id"), n.alias("content"))
    return contents, library.references({"signals": signal_, "fields": fields}), data


REFS = "refs AS (SELECT 'signals.content' AS source, p_partkey::VARCHAR AS row_id, CASE WHEN p_partkey % 19 = 0 THEN -p_partkey ELSE p_partkey END AS content FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'fields.content', p_partkey::VARCHAR, p_partkey FROM part WHERE p_partkey % 10 = 0)"


@query("SELECT source, row_id, content FROM refs", REFS)
def content_references(spark, d):
    return _stored(spark, d)[1]


@query("SELECT -content AS content, 'dangling' AS fault FROM (SELECT -content AS content FROM refs WHERE content < 0) UNION ALL SELECT n, CASE WHEN n % 11 = 0 THEN 'pending' WHEN coalesce(c, 0) = 0 THEN 'unreferenced' ELSE 'refcount' END FROM (SELECT p_partkey AS n, (SELECT count(*) FROM refs WHERE content = p_partkey) AS c, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS f FROM part) WHERE n % 11 = 0 OR c = 0 OR c <> f UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'length' ELSE 'checksum' END FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 17 = 0 OR p_partkey % 13 = 0)", REFS)
def verify_refs(spark, d):
    return library.verify(*_stored(spark, d)).select("content", "fault")


@query("SELECT content, count(*) AS refcount FROM refs WHERE content > 0 AND content % 11 <> 0 GROUP BY content", REFS)
def repaired_refs(spark, d):
    contents, refs, _ = _stored(spark, d)
    return library.repaired(contents, refs).select("content", "refcount")


def _runs(spark, d):
    base = samples(spark, d)
    return base, stages.gain(base, 1.001).where("signal_id % 10 != 3")


@query(f"SELECT group_id, signal_id, count(*) AS samples, {r('CASE WHEN signal_id % 10 = 3 THEN NULL ELSE max(abs(value - value * 1.001)) END')} AS max_abs, min(CASE WHEN signal_id % 10 = 3 OR abs(value - value * 1.001) > b THEN idx END) AS first_beyond FROM (SELECT *, greatest(0.0001, sqrt(avg(value * value) OVER (PARTITION BY signal_id)) * 0.002) AS b FROM s) GROUP BY group_id, signal_id", S)
def diff_signals(spark, d):
    out = regress.diff_samples(*_runs(spark, d), 1e-4, 2e-3)
    return out.select("group_id", "signal_id", "samples", F.when(F.col("max_abs") != float("inf"), r6(F.col("max_abs"))).alias("max_abs"), "first_beyond")


def _metrics(df):
    stats = profile.summarise(df, "group_id")
    return stats.select("group_id", F.explode(F.create_map(*[x for n in ("max", "mean", "rms") for x in (F.lit(n), F.col(n))])).alias("metric", "value"))


M = "m AS (SELECT group_id, unnest(['max', 'mean', 'rms']) AS metric, unnest([max(value), avg(value), sqrt(avg(value * value))]) AS value FROM s GROUP BY group_id)"


@query(f"SELECT group_id, metric, {r('value')} AS value FROM m", S, M)
def metric_long(spark, d):
    return rounded(_metrics(samples(spark, d)), "value")


@query(f"SELECT group_id, metric, {r('abs(value - value * 1.01::DOUBLE)')} AS difference, abs(value * 0.01::DOUBLE) <= greatest(0.002::DOUBLE, abs(value) * 0.001::DOUBLE) AS within FROM m", S, M)
def diff_metrics(spark, d):
    base = samples(spark, d)
    return rounded(regress.diff_metrics(_metrics(base), _metrics(stages.gain(base, 1.01)), 2e-3, 1e-3), "difference")


@query(f"SELECT group_id, metric, 0.5::DOUBLE * group_id AS x, {r('value')} AS value FROM m", S, M)
def metric_curve_rungs(spark, d):
    m = _metrics(samples(spark, d))
    rungs = m.select("group_id").distinct().select("group_id", F.lit("snr_db").alias("key"), (F.col("group_id") * 0.5).alias("rung"))
    return rounded(profile.metric_curve(m, rungs), "value")


@query(f"SELECT group_id, metric, (dense_rank() OVER (ORDER BY group_id) - 1)::DOUBLE AS x, {r('value')} AS value FROM m", S, M)
def metric_curve(spark, d):
    m = _metrics(samples(spark, d))
    rungs = m.select("group_id").distinct().where("group_id != 0").select("group_id", F.lit("snr_db").alias("key"), (F.col("group_id") * 0.5).alias("rung"))
    return rounded(profile.metric_curve(m, rungs), "value")


@query("SELECT group_id, CASE WHEN group_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS side FROM (SELECT DISTINCT group_id FROM s) WHERE group_id % 3 <> 2", S)
def diff_groups(spark, d):
    base = samples(spark, d)
    return regress.diff_groups(base.where("group_id % 2 = 0 OR group_id % 3 = 2"), base.where("group_id % 2 <> 0 OR group_id % 3 = 2"))


@query("SELECT o_custkey AS group_id, max(CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END) AS base_status, CASE WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM (SELECT o_custkey, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING (max(o_orderstatus) = 'F') <> (o_custkey % 2 <> 0)")
def diff_status(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.max("o_orderstatus").alias("s"))
    base = g.select("group_id", F.when(F.col("s") == "F", "failed").otherwise("ok").alias("status"))
    return regress.diff_status(base, g.select("group_id", F.when(F.col("group_id") % 2 == 0, "ok").otherwise("failed").alias("status")))


LINES = ("max >= 0.4", "rms < 0.12", "peak > 0", "rms within 1% of 0.125", "max >= baseline", "mean within 0.001 of baseline", "status == ok", "status < ok", "rms == baseline", "detections.count >= 400", "detections.peak.max < 0.6")


def _facts(spark, d, factor=1.0):
    s = stages.gain(samples(spark, d), factor)
    groups = s.select("group_id").distinct().withColumn("status", F.when(F.col("group_id") % 4 == 3, "failed").otherwise("ok"))
    m = _metrics(s).select("group_id", F.lit(0).alias("stage_ordinal"), F.col("metric").alias("name"), "value")
    detections = stages.threshold(s, 0.1, 0.05, period_s=1 / RATE_HZ)
    return groups, regress.facts(groups, m, artifacts={(1, "detections"): detections}, fields={"detections": ["peak"]})


AGG = "f AS (SELECT group_id, max(value) AS mx, avg(value) AS mean, sqrt(avg(value * value)) AS rms FROM s GROUP BY group_id), dd AS (SELECT group_id, count(*) AS n, max(peak) AS peak FROM det GROUP BY group_id), e AS (SELECT * FROM f LEFT JOIN dd USING (group_id))"
PF = "CASE WHEN {} THEN 'pass' ELSE 'fail' END"
STATUSES = [PF.format("mx >= 0.4"), PF.format("rms < 0.12"), "'not_applicable'", PF.format("abs(rms - 0.125::DOUBLE) <= 0.00125::DOUBLE"), "CASE WHEN group_id % 5 = 4 THEN 'error' " + PF.format("mx >= mx * 1.01::DOUBLE")[5:], "CASE WHEN group_id % 5 = 4 THEN 'error' " + PF.format("abs(mean - mean * 1.01::DOUBLE) <= 0.001::DOUBLE")[5:], PF.format("group_id % 4 <> 3"), "'error'", "CASE WHEN group_id % 5 = 4 THEN 'error' ELSE 'fail' END", PF.format("coalesce(n, 0) >= 400"), "CASE WHEN peak IS NULL THEN 'not_applicable' " + PF.format("peak < 0.6::DOUBLE")[5:]]
ASSERTED = f"checked AS (SELECT group_id, unnest(range(0, {len(LINES)}))::INTEGER AS ordinal, unnest([{', '.join(STATUSES)}]) AS status FROM e)"


@query("SELECT group_id, ordinal, status FROM checked", S, DET, AGG, ASSERTED)
def assertions(spark, d):
    groups, known = _facts(spark, d)
    base = _facts(spark, d, 1.01)[1].where("group_id % 5 != 4")
    return regress.check(groups, known, LINES, base).select("group_id", "ordinal", "status")


@query("SELECT run_id FROM (SELECT o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'O') WHERE n > 3")
def prune_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("pipeline"), (F.col("o_orderstatus") == "O").alias("exempt"))
    return regress.prune(runs, 3).select("run_id")


@query(f"SELECT signal_id, {r('max(abs(value - value * 1.5))')} AS max_abs, {r('min(CASE WHEN abs(value * 0.5) > 0 THEN t_s END)')} AS first_t FROM s GROUP BY ALL", S)
def residual_exact(spark, d):
    s = samples(spark, d)
    return rounded(regress.residual(s, stages.gain(s, 1.5)), "max_abs", "first_t").select("signal_id", "max_abs", "first_t")


@query(f"SELECT signal_id, idx, {r('v / max(abs(v)) OVER (PARTITION BY signal_id)')} AS value FROM (SELECT *, (value - avg(value) OVER (PARTITION BY signal_id)) * 2 AS v FROM s)", S)
def run_pipeline(spark, d):
    return _stage(pipeline.run(samples(spark, d), [pipeline.Stage("detrend"), pipeline.Stage("gain", {"gain": 2.0}), pipeline.Stage("normalise")]))


@query(f"SELECT group_id, count(*) AS pulses, {r('min(gap)')} AS least_gap, {r('avg(gap)')} AS mean_gap FROM (SELECT group_id, toa_s - lag(toa_s) OVER (PARTITION BY group_id ORDER BY toa_s, pulse_id) AS gap FROM p) GROUP BY ALL", P)
def pulse_gaps(spark, d):
    p = pulses(spark, d).withColumn("gap", F.col("toa_s") - F.lag("toa_s").over(W.partitionBy("group_id").orderBy("toa_s", "pulse_id")))
    return rounded(p.groupBy("group_id").agg(F.count("*").alias("pulses"), F.min("gap").alias("least_gap"), F.avg("gap").alias("mean_gap")), "least_gap", "mean_gap")


@query(f"SELECT event_type, count(*) AS count, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('avg(value)')} AS mean FROM events GROUP BY event_type, date_trunc('hour', ts)")
def stream_stats(spark, d):
    """In append mode: windows are written as the watermark passes them, the last ones when a row of the next year has come."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    later = e.groupBy().agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    e.unionByName(later, allowMissingColumns=True).write.parquet(f"{folder}/in")
    stream = streaming.windowed_stats(streaming.event_stream(spark, f"{folder}/in"))
    out = streaming.run_now(stream, f"{folder}/c", f"{folder}/out").where("event_type IS NOT NULL")
    return rounded(out.drop("window"), "min", "max", "mean")


@query(f"SELECT group_id, signal_id, {r('start_s')} AS start_s, {r('end_s')} AS end_s, {r('peak')} AS peak FROM det", S, DET)
def stream_threshold(spark, d):
    """Samples in any order, with their time as event time; a row of a signal -1 a day later lets the watermark pass them all."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s = samples(spark, d).select(F.col("group_id").cast("long").alias("group_id"), F.col("signal_id").cast("long").alias("signal_id"), "t_s", "value")
    beat = spark.range(1).select(F.lit(-1).cast("long").alias("group_id"), F.lit(-1).cast("long").alias("signal_id"), F.lit(2 * 86400.0).alias("t_s"), F.lit(0.0).alias("value"))
    s.unionByName(beat).withColumn("ts", F.timestamp_micros(((F.col("t_s") + 86400) * 1e6).cast("long"))).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    out = streaming.run_now(streaming.detections(stream, 0.1, 0.05, 1 / RATE_HZ), f"{folder}/c", f"{folder}/out")
    return rounded(out.where("signal_id >= 0"), "start_s", "end_s", "peak")


@query("SELECT event_id FROM events WHERE value BETWEEN 20 AND 80")
def stream_search(spark, d):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").write.parquet(f"{folder}/in")
    found = streaming.matching(streaming.event_stream(spark, f"{folder}/in"), [("value", 20.0, 80.0)])
    return streaming.run_now(found.select("event_id"), f"{folder}/c", f"{folder}/out")


def _csv(spark, d):
    """The events as a folder of grouped-block CSV files: a group for each user, with names that need quotes and some empty cells."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    p = pulses(spark, d).withColumn("idx", F.row_number().over(W.partitionBy("group_id").orderBy("toa_s", "pulse_id")) - 1)
    p = p.select(F.col("group_id").alias("group_ord"), "idx", F.round(F.col("toa_s") * 1e3).alias("ms"), F.when(F.col("k") != 7, F.col("k")).alias("k"), "event_type", "value")
    groups = p.select("group_ord").distinct().select("group_ord", F.concat(F.lit('user, "'), F.col("group_ord").cast("string"), F.lit('"')).alias("name"))
    pulse_csv.write_pulse_csv(groups, p, folder, ["k", "event_type", "value"], time="ms", whole=True)
    return folder, pulse_csv.Profile(toa_unit="ms", pulse_rules={"event_type": pulse_csv.Rule(text=True, key="type"), "value": pulse_csv.Rule(skip=True)})


CSV = "c AS (SELECT 'user, \"' || group_id || '\"' AS name, group_id, row_number() OVER (PARTITION BY group_id ORDER BY toa_s, pulse_id) - 1 AS idx, round(toa_s * 1000) AS ms, CASE WHEN k <> 7 THEN k END AS k, event_type FROM p)"


@query(f"SELECT name, idx::INTEGER AS idx, {r('ms / 1000')} AS toa_s, coalesce(k, -1)::DOUBLE AS k, event_type AS type FROM c", P, CSV)
def csv_frame(spark, d):
    path, rules = _csv(spark, d)
    groups, pulses_, _ = pulse_csv.read_pulse_csv(spark, path, rules)
    out = pulse_csv.typed_fields(pulses_, rules, ["k", "type"]).join(groups.select("path", "group_ord", "name"), ["path", "group_ord"])
    return out.select("name", "idx", r6(F.col("toa_s")).alias("toa_s"), F.when(F.isnan("k"), -1.0).otherwise(F.col("k")).alias("k"), "type")


@query(f"SELECT name, count(*) AS actual_count, count(*)::INTEGER AS declared_count, {r('min(ms) / 1000')} AS t0_s FROM c GROUP BY name", P, CSV)
def csv_groups(spark, d):
    path, rules = _csv(spark, d)
    groups = pulse_csv.read_pulse_csv(spark, path, rules)[0]
    return rounded(groups.select("name", "actual_count", F.col("declared_count").cast("int").alias("declared_count"), "t0_s"), "t0_s")


@query("SELECT group_id AS group_ord, event_type AS type, dense_rank() OVER (PARTITION BY group_id ORDER BY f) - 1 AS code, n FROM (SELECT group_id, event_type, min(idx) AS f, count(*) AS n FROM c GROUP BY ALL)", P, CSV)
def csv_text_codes(spark, d):
    p = pulses(spark, d).withColumn("idx", F.row_number().over(W.partitionBy("group_id").orderBy("toa_s", "pulse_id")) - 1)
    coded = pulse_csv.text_codes(p.select(F.col("group_id").alias("group_ord"), "idx", F.col("event_type").alias("type")), "type", "group_ord")
    return coded.groupBy("group_ord", "type", F.col("type_code").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, key, num_value, txt_value, warning FROM (SELECT event_id, unnest(['value', 'type', 'limit', 'none']) AS key, unnest([value, NULL, CASE WHEN value <= 50 THEN value END, NULL]) AS num_value, unnest([NULL, event_type, CASE WHEN value > 50 THEN 'v' END, NULL]) AS txt_value, unnest([NULL, NULL, CASE WHEN value > 50 THEN 'too_high' END, NULL]) AS warning FROM events)")
def csv_attributes(spark, d):
    v = F.col("value").cast("string")
    rows = table(spark, d, "events").withColumn("attributes", F.create_map(F.lit("value"), F.concat(F.lit(" "), v), F.lit("type"), F.col("event_type"), F.lit("limit"), v, F.lit("none"), F.lit("N/A")))
    out = pulse_csv.typed_attributes(rows, [catalog.Property("limit", "number", high=50.0)], "event_id")
    return out.select(F.col("event_id").alias("id"), "key", "num_value", F.when(F.col("warning").isNotNull(), "v").otherwise(F.col("txt_value")).alias("txt_value"), "warning")


def _specs(spark, d):
    """A spec of a source for each part: its size gives the frequency."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("signal_id"), (F.col("p_size") % 8 + 1).cast("double").alias("freq_hz"))


def _made(spark, d, *values):
    g = generate.grid(_specs(spark, d), RATE_HZ, 0.5)
    return g.select("signal_id", "idx", *[r6(v).alias(n) for n, v in values])


G = "g AS (SELECT p_partkey AS signal_id, (p_size % 8 + 1)::DOUBLE AS f, i AS idx, i / 64.0::DOUBLE AS t FROM part CROSS JOIN range(0, 32) x(i))"


@query(f"SELECT signal_id, idx, {r('sin(2 * pi() * f * t)')} AS sine, {r('CASE WHEN f * t - floor(f * t) < 0.5 THEN 1 ELSE -1 END')} AS square, {r('asin(sin(2 * pi() * f * t)) * 2 / pi()')} AS triangle, {r('2 * (f * t - floor(f * t)) - 1')} AS sawtooth FROM g", G)
def gen_tones(spark, d):
    return _made(spark, d, *[(n, generate.tone(n, F.col("freq_hz"), F.col("t_s"))) for n in ("sine", "square", "triangle", "sawtooth")])


@query(f"SELECT signal_id, idx, {r('f * (CASE WHEN q < 0.0625 THEN q / 0.0625 WHEN q < 0.125 THEN 1 WHEN q < 0.1875 THEN 1 - (q - 0.125) / 0.0625 ELSE 0 END)')} AS value FROM (SELECT *, t - floor(t / 0.25) * 0.25 AS q FROM g)", G)
def gen_pulse(spark, d):
    return _made(spark, d, ("value", F.col("freq_hz") * generate.trapezoid(F.col("t_s"), 0.25, 0.0625, 0.0625, 0.0625)))


@query(f"SELECT signal_id, idx, {r('sin(2 * pi() * (f * t + f * t * t))')} AS linear, {r('sin(2 * pi() * (f * t + f * t * t * t / 0.75))')} AS quadratic, {r('sin(2 * pi() * f * 0.5 / ln(2) * (exp(ln(2) * t / 0.5) - 1))')} AS log FROM g", G)
def gen_chirp(spark, d):
    return _made(spark, d, *[(n, generate.chirp(F.col("t_s"), F.col("freq_hz"), 2 * F.col("freq_hz"), 0.5, n)) for n in ("linear", "quadratic", "log")])


@query(f"SELECT signal_id, idx, {r('f')} AS dc, {r('f * t')} AS ramp, {r('CASE WHEN t < 0.25 THEN 0 ELSE f END')} AS step FROM g", G)
def gen_basic(spark, d):
    return _made(spark, d, *[(n, generate.basic(n, F.col("t_s"), F.col("freq_hz"), 0.25)) for n in ("dc", "ramp", "step")])


@query(f"SELECT c_custkey AS group_id, i AS pulse_idx, {r('(i // 3) * 0.0045 + [0, 0.001, 0.0025][i % 3 + 1] + 0.00001 * i * (i - 1) / 2')} AS toa_s FROM customer CROSS JOIN range(0, 12) x(i)")
def pulse_train(spark, d):
    specs = table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"))
    return rounded(generate.pulse_train(specs, 12, [0.001, 0.0015, 0.002], drift_s=1e-5), "toa_s")


@query(f"SELECT signal_id, idx, {r('sin(2 * pi() * 4 * t_s + 2 * value)')} AS value FROM s", S)
def modulate_pm(spark, d):
    return _stage(generate.modulate_pm(samples(spark, d), 4.0, 2.0))


@query(f"SELECT signal_id, idx, {r('sin(2 * pi() * (8 * t_s + 3 * coalesce(sum(value) OVER (PARTITION BY signal_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 64))')} AS value FROM s", S)
def modulate_fm(spark, d):
    return _stage(generate.modulate_fm(samples(spark, d), 8.0, 3.0, RATE_HZ))


@query(f"SELECT signal_id, idx, {r('least(greatest(coalesce(lag(value, 3) OVER (PARTITION BY signal_id ORDER BY idx), 0), -0.1), 0.1)')} AS value FROM s", S)
def delay_clip(spark, d):
    return _stage(generate.clip(generate.delay(samples(spark, d), 3), -0.1, 0.1))


@query("SELECT signal_id, count, coalesce(crossings, 0) AS crossings, histogram FROM (SELECT signal_id, count(*) AS count, list_transform(range(-1, 9), lambda b: len(list_filter(list(CASE WHEN value < -0.5 THEN -1 WHEN value > 0.5 THEN 8 ELSE least(floor((value + 0.5::DOUBLE) * 8), 7) END), lambda x: x = b)))::VARCHAR AS histogram FROM s GROUP BY ALL) LEFT JOIN (SELECT signal_id, count(*) FILTER (prev <> sg) AS crossings FROM (SELECT signal_id, sign(value) AS sg, lag(sign(value)) OVER (PARTITION BY signal_id ORDER BY idx) AS prev FROM s WHERE value <> 0) GROUP BY ALL) USING (signal_id)", S)
def column_profile(spark, d):
    out = profile.column_profile(samples(spark, d), 8, -0.5, 0.5, "signal_id")
    return out.select("signal_id", "count", "crossings", F.concat(F.lit("["), F.array_join(F.col("histogram").cast("array<string>"), ", "), F.lit("]")).alias("histogram"))


@query(f"SELECT group_id, count(*) AS n, {r('min(start_s)')} AS low, {r('max(start_s)')} AS high, {r('avg(start_s)')} AS mean, {r('sum(start_s)')} AS total FROM det GROUP BY group_id", S, DET)
def artifact_agg(spark, d):
    return rounded(profile.artifact_aggregate(_detections(spark, d), "start_s", "group_id"), "low", "high", "mean", "total")


@query(f"SELECT signal_id, {r('max(start_s)')} AS start_s, {r('max_by(end_s, start_s)')} AS end_s FROM det WHERE start_s <= 0.5 GROUP BY signal_id", S, DET)
def row_at(spark, d):
    return rounded(regress.row_at(_detections(spark, d), 0.5, "signal_id"), "start_s", "end_s").select("signal_id", "start_s", "end_s")


@query(f"SELECT signal_id, px, {r('least(low - low * 1.5, high - high * 1.5)')} AS low, {r('greatest(low - low * 1.5, high - high * 1.5)')} AS high FROM (SELECT signal_id, least(floor((t_s - 0.25) / 0.5 * 10), 9)::BIGINT AS px, min(value) AS low, max(value) AS high FROM s WHERE t_s >= 0.25 AND t_s < 0.75 GROUP BY ALL)", S)
def residual_envelope(spark, d):
    a, b = (profile.viewport(samples(spark, d), 0.25, 0.75, 10, "signal_id", gain=g) for g in (1.0, 1.5))
    return rounded(regress.residual_envelope(a, b, "signal_id"), "low", "high")


@query("SELECT group_id, CASE WHEN len(why) = 0 THEN 'matches' ELSE 'deviates' END AS verdict, array_to_string(list_sort(why), ',') AS reasons FROM (SELECT group_id, list_filter([CASE WHEN abs(max(value)) * 0.01::DOUBLE > 0.003::DOUBLE THEN 'max' END, CASE WHEN abs(avg(value)) * 0.01::DOUBLE > 0.003::DOUBLE THEN 'mean' END, CASE WHEN sqrt(avg(value * value)) * 0.01::DOUBLE > 0.003::DOUBLE THEN 'rms' END], lambda x: x IS NOT NULL) AS why FROM s GROUP BY group_id)", S)
def baseline_verdicts(spark, d):
    base = samples(spark, d)
    return regress.verdicts(regress.diff_metrics(_metrics(base), _metrics(stages.gain(base, 1.01)), 3e-3, 0.0)).select("group_id", "verdict", "reasons")


@query("SELECT group_id, CASE WHEN len(why) = 0 THEN 'matches' ELSE 'deviates' END AS verdict, array_to_string(list_sort(why), ',') AS reasons FROM (SELECT group_id, CASE WHEN group_id = 9 THEN ['max', 'mean', 'only in candidate', 'rms'] ELSE list_filter([CASE WHEN abs(max(value)) * 0.01::DOUBLE > 0.0045::DOUBLE THEN 'max' END, CASE WHEN sqrt(avg(value * value)) * 0.01::DOUBLE > 0.0045::DOUBLE THEN 'rms' END], lambda x: x IS NOT NULL) END AS why FROM s GROUP BY group_id)", S)
def baseline_check(spark, d):
    """Promoted once for run a, then for b, then checked for c; b has no group 9."""
    base = samples(spark, d)
    runs = [("a", base), ("b", base.where("group_id != 9")), ("c", stages.gain(base, 1.01))]
    metrics = pipeline.union([_metrics(s).select(F.lit(n).alias("run_id"), "group_id", "metric", "value") for n, s in runs])
    named = spark.createDataFrame([], "name string, run_id string, abs_tol double, rel_tol double")
    named = regress.promote(regress.promote(named, "golden", "a", 1.0, 0.0), "golden", "b", 4.5e-3, 0.0)
    return regress.check_baseline(named, "golden", "c", metrics).select("group_id", "verdict", "reasons")


@query("SELECT ordinal, count(*) FILTER (status IN ('fail', 'error')) AS failures, count(*) AS groups FROM checked GROUP BY ordinal", S, DET, AGG, ASSERTED)
def failed_assertions(spark, d):
    return regress.failed_assertions(assertions(spark, d))


@query("SELECT o_orderkey AS output_id FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def retention(spark, d):
    policy = F.when(F.col("o_orderkey") % 3 == 0, "always").when(F.col("o_orderkey") % 3 == 1, "on_failure").otherwise("never")
    outputs = table(spark, d, "orders").select(F.col("o_orderkey").alias("output_id"), F.col("o_custkey").alias("group_id"), policy.alias("policy"), (F.col("o_orderstatus") == "F").alias("failed"))
    return regress.retained(outputs).select("output_id")


@query("SELECT event_type AS train, count(DISTINCT user_id) AS groups, count(*) AS pulses FROM events GROUP BY ALL")
def train_extent(spark, d):
    return library.train_extent(pulses(spark, d), "event_type")


@query("SELECT group_id, event_type AS kind, pulse_id AS latest FROM p QUALIFY row_number() OVER (PARTITION BY group_id, event_type ORDER BY toa_s DESC, pulse_id DESC) = 1", P)
def nearest_artifact(spark, d):
    return regress.nearest_artifact(pulses(spark, d).withColumnRenamed("event_type", "kind"), "pulse_id", ["toa_s", "pulse_id"], "group_id", "kind")


@query("SELECT id, key, error FROM (SELECT event_id AS id, 'value' AS key, CASE WHEN value < 1 THEN 'too_low' WHEN value > 100 THEN 'too_high' END AS error FROM events UNION ALL SELECT event_id, 'k', CASE WHEN (props::JSON->>'k')::DOUBLE > 50 THEN 'too_high' END FROM events UNION ALL SELECT event_id, 'type', CASE WHEN event_type NOT IN ('click', 'view') THEN 'option' END FROM events UNION ALL SELECT event_id, 'owner', 'missing' FROM events UNION ALL SELECT event_id, 'user', 'unknown' FROM events) WHERE error IS NOT NULL")
def property_definitions(spark, d):
    kinds = [catalog.Property("value", "number", 1.0, 100.0), catalog.Property("k", "frequency", high=50.0), catalog.Property("type", "enum", options=("click", "view")), catalog.Property("owner", "text", required=True)]
    pairs = {"value": "value", "k": F.get_json_object("props", "$.k"), "type": "event_type", "user": "user_id"}
    columns = [x for k, c in pairs.items() for x in (F.lit(k), (F.col(c) if isinstance(c, str) else c).cast("string"))]
    rows = table(spark, d, "events").withColumn("attributes", F.create_map(*columns))
    return catalog.validate_properties(rows, "event_id", "attributes", kinds)


@query("SELECT group_id, field, count(*) FILTER (bad) AS mismatches, min(CASE WHEN bad THEN row END) AS first_row FROM (SELECT group_id, row, field, dropped OR abs(v * 0.01) > 0.50305 AS bad FROM (SELECT group_id, pulse_id AS row, unnest(['value', 'k']) AS field, unnest([value, k]) AS v, pulse_id % 10 = 3 AS dropped FROM p)) GROUP BY group_id, field", P)
def diff_artifacts(spark, d):
    a = pulses(spark, d).withColumnRenamed("pulse_id", "row")
    b = a.withColumns({"value": F.col("value") * 1.01, "k": F.col("k") * 1.01}).where("row % 10 != 3")
    return regress.diff_artifacts(a, b, ["value", "k"], 0.50305, "group_id")


def _n(stream: int, at: str) -> str:
    u, w = (f"(('0x' || substr(md5(signal_id::VARCHAR || '|' || ({at})::VARCHAR || '|{k}'), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)" for k in (2 * stream, 2 * stream + 1))
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {w})"


@query(f"SELECT signal_id, idx, {r(_n(1, 'idx'))} AS white, {r(f"({' + '.join(_n(1 + o, f'idx >> {o}') for o in range(4))}) / 2")} AS pink, {r(f"({' + '.join(f'{2**o} * {_n(1 + o, f'idx >> {o}')}' for o in range(4))}) / sqrt(85)")} AS brown FROM g", G)
def gen_noise(spark, d):
    key, at = F.col("signal_id"), F.col("idx")
    return _made(spark, d, ("white", generate.gaussian(key, at)), *[(c, generate.coloured(key, at, c, 4)) for c in ("pink", "brown")])


@query(f"SELECT signal_id, idx, {r('f * (2 * ((s >> 0) & 1) - 1)')} AS value FROM (SELECT p_partkey AS signal_id, (p_size % 8 + 1)::DOUBLE AS f FROM part) CROSS JOIN lfsr WHERE idx < 200", "lfsr(idx, s) AS (SELECT 0, 127 UNION ALL SELECT idx + 1, (s >> 1) | ((bit_count(s & 3) & 1)::INTEGER << 6) FROM lfsr WHERE idx < 199)")
def gen_prbs(spark, d):
    out = generate.prbs(_specs(spark, d), 7, 200, RATE_HZ, block=64)
    return out.select("signal_id", "idx", r6(F.col("value") * F.col("freq_hz")).alias("value"))


ORACLES["gen_prbs"] = ORACLES["gen_prbs"].replace("WITH lfsr", "WITH RECURSIVE lfsr")


@query(f"SELECT signal_id, idx, {r('2 * sin(2 * pi() * f * t) - pow(t, 2) / (1 + f) + fmod(7 * t, 2) * greatest(abs(cos(f * t)) - 0.5::DOUBLE, 0)')} AS value, {r('CASE WHEN t > 0.25 THEN ln(t) ELSE sqrt(t) END')} AS bent FROM g", G)
def gen_expr(spark, d):
    v = expression("2 * sin(2 * pi * f * t) - t ^ 2 / (1 + f) + 7 * t % 2 * max(abs(cos(f * t)) - 0.5, 0)", t=F.col("t_s"), f=F.col("freq_hz"))
    bent = F.when(F.col("t_s") > 0.25, expression("ln(t)", t=F.col("t_s"))).otherwise(expression("sqrt(t)", t=F.col("t_s")))
    return _made(spark, d, ("value", v), ("bent", bent))


@query(f"SELECT signal_id, idx, {r('sin(2 * pi() * f * t) + f * t + 0.5')} AS total, {r('sin(2 * pi() * f * t) * f * t')} AS product, {r('CASE WHEN idx < 10 THEN sin(2 * pi() * f * idx / 64) WHEN idx < 20 THEN f * (idx - 10) / 64 ELSE 0 END')} AS joined, {r('CASE WHEN idx = 16 THEN f ELSE 0 END')} AS impulse FROM g", G)
def gen_combined(spark, d):
    f, t, i = F.col("freq_hz"), F.col("t_s"), F.col("idx")
    terms = [generate.tone("sine", f, t), f * t]
    parts = [(lambda _, x: generate.tone("sine", f, x), 10 / 64), (lambda _, x: f * x, 0.15625)]
    return _made(spark, d, ("total", generate.total([*terms, F.lit(0.5)])), ("product", generate.product(terms)), ("joined", generate.concat(i, RATE_HZ, parts)), ("impulse", generate.impulse(i, f, 0.2499, RATE_HZ)))


@query(f"SELECT signal_id, idx, {r('CASE WHEN t < 0.125 THEN t / 0.125 WHEN t < 0.25 THEN 1 - 0.4 * (t - 0.125) / 0.125 WHEN t < 0.375 THEN 0.6 WHEN t < 0.5 THEN 0.6 * (1 - (t - 0.375) / 0.125) ELSE 0 END * f')} AS adsr, {r('f * exp(-0.5 * pow((t - 0.25) / 0.1, 2))')} AS gaussian FROM g", G)
def gen_envelopes(spark, d):
    f, t = F.col("freq_hz"), F.col("t_s")
    return _made(spark, d, ("adsr", f * generate.envelope(t, "adsr", 0.5, 0.125, 0.125, 0.6, 0.125)), ("gaussian", f * generate.envelope(t, "gaussian", 0.5, centre_s=0.25, sigma_s=0.1)))


FM = "sin(2 * pi() * (8 * t + 2 * ({})))"


@query(f"SELECT signal_id, idx, {r(FM.format('(1 - cos(2 * pi() * 2 * t)) / (4 * pi())'))} AS sine, {r(FM.format('(CASE WHEN 2 * t - floor(2 * t) < 0.5 THEN 2 * t - floor(2 * t) ELSE 1 - (2 * t - floor(2 * t)) END) / 2'))} AS square, {r(FM.format('(pow(2 * t - floor(2 * t), 2) - (2 * t - floor(2 * t))) / 2'))} AS sawtooth, {r(FM.format('0.5 * t + 3 * t * t / 2 + greatest(t - 0.25, 0)'))} AS total FROM g", G)
def fm_closed_form(spark, d):
    tone = lambda kind: {"kind": kind, "freq_hz": 2.0}
    total = {"kind": "sum", "terms": [{"kind": "dc", "level": 0.5}, {"kind": "ramp", "slope": 3.0}, {"kind": "step", "at_s": 0.25}]}
    value = lambda node: specs.render({"kind": "fm", "carrier_hz": 8.0, "dev_hz": 2.0, "input": node}, F.col("idx"), RATE_HZ, 0.5, F.col("signal_id"))
    return _made(spark, d, *[(k, value(tone(k))) for k in ("sine", "square", "sawtooth")], ("total", value(total)))


@query(f"SELECT signal_id, k AS idx, {r('coalesce(v, 0)')} AS value FROM (SELECT vec_id AS signal_id, k, CASE WHEN (k - 8) / 48.0::DOUBLE * 64 BETWEEN 0 AND 63 THEN e[floor((k - 8) / 48.0::DOUBLE * 64)::INTEGER + 1] + (coalesce(e[floor((k - 8) / 48.0::DOUBLE * 64)::INTEGER + 2], 0) - e[floor((k - 8) / 48.0::DOUBLE * 64)::INTEGER + 1]) * ((k - 8) / 48.0::DOUBLE * 64 - floor((k - 8) / 48.0::DOUBLE * 64)) END AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) CROSS JOIN range(0, 80) g(k))")
def align_signals(spark, d):
    out = generate.align(samples(spark, d), 48.0, 80, -8 / 48.0)
    return _stage(out)


@query(f"SELECT c_custkey AS group_id, i AS pulse_idx, 2.5::DOUBLE AS level, {r('1 + 4 * (i / 11.0::DOUBLE)')} AS ramp, [1.0, 2.0, 5.0][i % 3 + 1]::DOUBLE AS steps, {r('10 + 2 * sin(2 * pi() * i / 8)')} AS scan, {r('-1 + 2 * ' + _u(4).replace('signal_id', chr(39) + 'train' + chr(39)).replace('idx', 'i'))} AS noise FROM customer CROSS JOIN range(0, 12) x(i)")
def train_fields(spark, d):
    i = F.col("pulse_idx")
    t = generate.pulse_train(table(spark, d, "customer").select(F.col("c_custkey").alias("group_id")), 12, [0.001])
    of = lambda kind, **p: generate.train_field(kind, i, 12, **p)
    t = t.select("group_id", "pulse_idx", of("constant", value=2.5).alias("level"), of("ramp", start=1.0, end=5.0).alias("ramp"), of("sequence", values=[1, 2, 5]).alias("steps"), of("scan", mean=10.0, amp=2.0, period_pulses=8).alias("scan"), of("uniform", lo=-1.0, hi=1.0, seed=2).alias("noise"))
    return rounded(t, "ramp", "scan", "noise")


@query(f"SELECT p_partkey AS signal_id, i AS idx, {r('0.5 * sin(2 * pi() * 1000 * i / 48000) + 0.5 * sin(2 * pi() * 1100 * i / 48000)')} AS value FROM part CROSS JOIN range(0, 96) x(i)")
def preset_two_tone(spark, d):
    keys = _specs(spark, d).select("signal_id", F.lit(0).alias("group_id"))
    return _stage(specs.make(keys, specs.put(specs.PRESETS["two-tone"], "/duration_s", 0.002)))


@query(f"SELECT signal_id, count(*) AS pairs, {r('max(abs(value - b))')} AS max_abs, {r('min(CASE WHEN value <> b THEN t_s END)')} AS first_t FROM (SELECT s.*, b.value * 1.5::DOUBLE AS b FROM s JOIN s b ON b.signal_id = s.signal_id AND b.idx = s.idx + s.idx % 2) GROUP BY signal_id", S)
def residual_nearest(spark, d):
    """Every sample against every second one, times 1.5 and a millisecond early: the nearest is the same or the next one, the last has none."""
    s = samples(spark, d)
    b = stages.gain(s, 1.5).where("idx % 2 = 0").withColumn("t_s", F.col("t_s") - F.lit(0.001))
    return rounded(regress.residual_nearest(s, b, "signal_id"), "max_abs", "first_t").select("signal_id", "pairs", "max_abs", "first_t")


@query("SELECT event_id AS id, unnest(['flag', 'name', 'count', 'level', 'span', 'rows', 'empty', 'first']) AS field, unnest(['bool', 'text', 'int', 'float', 'span', 'array', 'float', 'int']) AS kind FROM events")
def payload_schema(spark, d):
    e = table(spark, d, "events")
    pair = F.array(F.lit(0.25), F.lit(1.5))
    payload = F.struct(F.array(F.col("event_id") % 2 == 0).alias("flag"), F.array(F.col("event_type")).alias("name"), F.col("event_id").alias("count"), F.array(F.lit(None).cast("double"), F.lit(2.5)).alias("level"), F.array(pair).alias("span"), F.array(F.array(F.lit(1.5), F.lit(2.5), F.lit(3.5))).alias("rows"), F.array().cast("array<int>").alias("empty"), F.array(F.lit(None).cast("int"), F.lit(3)).alias("first"))
    return regress.payload_schema(e.select("event_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload")), "event_id", "payload")


@query(f"SELECT group_id, {r('min(low)')} AS low, {r('max(high)')} AS high FROM (SELECT group_id, signal_id, idx >> 3 AS cell, min(value) AS low, max(value) AS high FROM s GROUP BY ALL) GROUP BY group_id", S)
def trace_extent(spark, d):
    s = samples(spark, d)
    cells = profile.pyramid(s, 8, 1, "group_id", "signal_id")
    return rounded(profile.extent(cells, "group_id"), "low", "high")


@query(f"SELECT signal_id, px, {r('min(value)')} AS low, {r('max(value)')} AS high FROM (SELECT s.signal_id, s.value, p.px FROM s JOIN range(0, 4) p(px) ON ((idx // 8) * 8) / 64.0::DOUBLE < (p.px + 1) * 0.25::DOUBLE AND ((idx // 8) * 8 + 8) / 64.0::DOUBLE > p.px * 0.25::DOUBLE) GROUP BY signal_id, px", S)
def viewport_pyramid(spark, d):
    cells = profile.pyramid(samples(spark, d), 8, None, "signal_id")
    return rounded(profile.viewport_cells(cells, RATE_HZ, 8, 0.0, 1.0, 4, "signal_id"), "low", "high")


@query(f"SELECT signal_id, px, {r('value')} AS low, {r('value')} AS high FROM (SELECT signal_id, value, least(floor((t_s - 0.25) / 0.25 * 40), 39)::BIGINT AS px FROM s WHERE t_s >= 0.25 AND t_s < 0.5)", S)
def viewport_points(spark, d):
    return rounded(profile.viewport(samples(spark, d), 0.25, 0.5, 40, "signal_id", rate_hz=RATE_HZ), "low", "high")


def _bundle(spark, d):
    s = samples(spark, d)
    e = table(spark, d, "embeddings")
    order = F.row_number().over(W.partitionBy("group_id").orderBy("signal_id")) - 1
    named = e.select(F.col("label").alias("group_id"), F.col("vec_id").alias("signal_id")).withColumn("ordinal", order.cast("int"))
    named = named.select("*", F.concat(F.lit("s"), F.col("signal_id").cast("string")).alias("name"), F.lit("analog").alias("domain"), F.when(F.col("group_id") == 7, 8.0).otherwise(RATE_HZ).alias("rate_hz"), F.lit(0.0).alias("t0_s"), F.create_map(F.lit("source"), F.lit("embedding")).alias("attributes"))
    return pipeline.Bundle(s, named)


@query(f"SELECT group_id, name, {r('value')} AS value FROM (SELECT group_id, unnest(['s' || signal_id || '.rms', 's' || signal_id || '.peak_to_peak']) AS name, unnest([sqrt(avg(value * value)), max(value) - min(value)]) AS value FROM s GROUP BY group_id, signal_id)", S)
def statistics_stage(spark, d):
    run = pipeline.run_groups(_bundle(spark, d), [pipeline.Stage("statistics", {"write_back": True})])
    return rounded(run.metrics.select("group_id", "name", "value"), "value")


CHAIN = [("detrend", {}), ("threshold", {"level": 0.1, "hysteresis": 0.05}), ("pulse_metrics", {"write_back": True})]
CENTRED = "c AS (SELECT group_id, signal_id, idx, t_s, value - avg(value) OVER (PARTITION BY signal_id) AS value FROM s)"


@query(f"SELECT group_id, count(*)::DOUBLE AS pulses, {r('avg(end_s - start_s)')} AS width_mean, {r('sum(end_s - start_s)')} AS duty, {r('max(peak)')} AS peak_max FROM det GROUP BY group_id", S, CENTRED, DET.replace("FROM s)", "FROM c)"))
def detect_chain(spark, d):
    b = _bundle(spark, d)
    own = pipeline.Bundle(b.samples, b.signals.withColumn("rate_hz", F.lit(RATE_HZ)))  # that of the samples' times, in all groups
    run = pipeline.run_groups(own, [pipeline.Stage(k, p) for k, p in CHAIN])
    m = run.metrics.where("stage_ordinal = 2").groupBy("group_id").pivot("name", ["pulses", "width_mean", "duty", "peak_max"]).agg(F.first("value"))
    return rounded(m, "width_mean", "duty", "peak_max")


@query("SELECT group_id, ordinal::INTEGER AS ordinal, name, disposition FROM (SELECT label AS group_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 5 = 0, vec_id) - 1 + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS ordinal, 's' || vec_id AS name, CASE WHEN vec_id % 5 = 0 THEN 'dropped' WHEN vec_id % 5 = 1 THEN 'replaced' ELSE 'passthrough' END AS disposition FROM embeddings UNION ALL SELECT label, count(*) FILTER (vec_id % 5 <> 0), 'mean', 'added' FROM embeddings GROUP BY label)")
def dispositions(spark, d):
    b = _bundle(spark, d)
    mean = b.samples.groupBy("group_id", "idx", "t_s").agg(F.avg("value").alias("value")).select("group_id", F.lit("mean").alias("name"), F.lit("analog").alias("domain"), "idx", "t_s", "value")
    some = lambda k: b.signals.where(F.col("signal_id") % 5 == k)
    out = pipeline.Outputs(stages.gain(b.samples.where("signal_id % 5 = 1"), 2.0), only=some(1), dropped=some(0), added=mean)
    return pipeline.apply_outputs(b, out)[1].select("group_id", "ordinal", "name", "disposition")


@query("SELECT DISTINCT label AS group_id, CASE WHEN label = 7 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN label = 7 THEN 1 END AS failed_stage FROM embeddings")
def run_status(spark, d):
    """Group 7 has too low a rate for the filter and stops there; the others go on."""
    plan = [("gain", {"gain": 2.0}), ("filter", {"cutoff_hz": 8.0}), ("statistics", {})]
    return pipeline.run_groups(_bundle(spark, d), [pipeline.Stage(k, p) for k, p in plan]).groups.select("group_id", "status", "failed_stage")


@query(f"SELECT stage::INTEGER AS stage_ordinal, group_id, 's' || signal_id AS name, CASE WHEN stage = -1 THEN 'source' ELSE 'replaced' END AS disposition, count(*) AS samples, {r('max(value * pow(2, stage + 1))')} AS max FROM s CROSS JOIN range(-1, 2) x(stage) GROUP BY ALL", S)
def run_records(spark, d):
    """The recorded signals of a run of two gains, written and read again."""
    plan = [pipeline.Stage("gain", {"gain": 2.0}), pipeline.Stage("gain", {"gain": 2.0}, retention="never")]
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    pipeline.write_run(pipeline.run_groups(_bundle(spark, d), plan), folder, "r1", plan)
    kept = spark.read.parquet(f"{folder}/run_signals").where("run_id = 'r1'")
    return rounded(kept.select("stage_ordinal", "group_id", "name", "disposition", "samples", "max"), "max")


@query("SELECT DISTINCT label AS group_id, s::INTEGER AS stage_ordinal, label % 2 = 0 AND s < 1 AS hit FROM embeddings CROSS JOIN range(0, 3) x(s)")
def incremental_plan(spark, d):
    """A cache from a run with another second stage, over groups of which the odd ones had other samples."""
    b = _bundle(spark, d)
    before = pipeline.Bundle(b.samples.withColumn("value", F.when(F.col("group_id") % 2 == 1, F.col("value") + 1e-9).otherwise(F.col("value"))), b.signals)
    plan = lambda mode: [pipeline.Stage("gain", {"gain": 2.0}), pipeline.Stage("detrend", {"mode": mode}), pipeline.Stage("normalise")]
    nothing = spark.createDataFrame([], "cache_key string")
    cache = pipeline.plan_incremental(pipeline.input_hashes(before), pipeline.stage_keys(plan("linear")), nothing)
    return pipeline.plan_incremental(pipeline.input_hashes(b), pipeline.stage_keys(plan("mean")), cache).select("group_id", "stage_ordinal", "hit")


NAN = "v AS (SELECT *, CASE WHEN signal_id % 4 IN (1, 3) AND idx = 5 THEN 'NaN'::DOUBLE ELSE value END AS b, CASE WHEN signal_id % 4 IN (2, 3) AND idx = 5 THEN 'NaN'::DOUBLE ELSE value * 1.001 END AS c FROM s)"


def _nan_runs(spark, d):
    """Base and candidate of which every fourth signal has a NaN at its sixth sample on neither, one, the other or both sides."""
    s, nan = samples(spark, d), F.lit(float("nan"))
    at = lambda *k: F.col("idx").eqNullSafe(5) & (F.col("signal_id") % 4).isin(*k)
    return s.withColumn("value", F.when(at(1, 3), nan).otherwise(F.col("value"))), s.withColumn("value", F.when(at(2, 3), nan).otherwise(F.col("value") * 1.001))


@query(f"SELECT group_id, signal_id, CASE WHEN signal_id % 4 IN (1, 2) THEN NULL ELSE {r('max(CASE WHEN isnan(b) THEN 0 ELSE abs(b - c) END)')} END AS max_abs, min(CASE WHEN isnan(b) <> isnan(c) OR (NOT isnan(b) AND abs(b - c) > bound) THEN idx END) AS first_beyond, bool_and(isnan(b) = isnan(c) AND (isnan(b) OR abs(b - c) <= bound)) AS within FROM (SELECT *, greatest(0.0001, 0.002 * sqrt(avg(CASE WHEN NOT isnan(b) THEN b * b END) OVER (PARTITION BY signal_id))) AS bound FROM v) GROUP BY group_id, signal_id", S, NAN)
def diff_signals_nan(spark, d):
    out = regress.diff_samples(*_nan_runs(spark, d), 1e-4, 2e-3)
    return out.select("group_id", "signal_id", F.when(F.col("max_abs") != float("inf"), r6(F.col("max_abs"))).alias("max_abs"), "first_beyond", "within")


@query(f"SELECT signal_id, CASE WHEN signal_id % 4 IN (1, 2) THEN NULL ELSE {r('max(CASE WHEN isnan(b) THEN 0 ELSE abs(b - c) END)')} END AS max_abs FROM v GROUP BY signal_id", S, NAN)
def residual_nan(spark, d):
    out = regress.residual(*_nan_runs(spark, d))
    return out.select("signal_id", F.when(F.col("max_abs") != float("inf"), r6(F.col("max_abs"))).alias("max_abs"))


@query("SELECT group_id, stage_ordinal::INTEGER AS stage_ordinal, 'last' AS metric, CASE WHEN stage_ordinal = 1 THEN NOT (bool_or(isnan(b)) OR bool_or(isnan(c))) ELSE NOT bool_or(isnan(b)) END AS within FROM (SELECT * FROM v JOIN (SELECT max(signal_id) AS signal_id FROM s GROUP BY group_id) USING (signal_id)) CROSS JOIN range(0, 2) x(stage_ordinal) WHERE idx = 5 GROUP BY group_id, stage_ordinal", S, NAN)
def diff_metrics_nan(spark, d):
    """The sixth sample of each group's last signal as the metric of stage 1, and of the base against itself as that of stage 0."""
    base, candidate = _nan_runs(spark, d)
    last = base.groupBy("group_id").agg(F.max("signal_id").alias("signal_id"))
    of = lambda df, k: df.join(last, ["group_id", "signal_id"]).where("idx = 5").select("group_id", F.lit(k).alias("stage_ordinal"), F.lit("last").alias("metric"), "value")
    return regress.diff_metrics(of(base, 0).unionByName(of(base, 1)), of(base, 0).unionByName(of(candidate, 1)), 0.0, 2e-3).drop("difference")


@query("SELECT group_id, CASE WHEN len(why) = 0 THEN 'matches' ELSE 'deviates' END AS verdict, array_to_string(list_sort(list_distinct(why)), ',') AS reasons FROM (SELECT group_id, coalesce(list(reason) FILTER (reason IS NOT NULL), []) AS why FROM (SELECT group_id, unnest(CASE WHEN group_id = 9 THEN ['only in candidate'] WHEN group_id % 3 = 0 AND signal_id % 2 = 1 THEN ['signal s' || signal_id || ' at -1', 'signal s' || signal_id || ' at 0', CASE WHEN abs(max(abs(value + 0.01)) - max(abs(value))) * 2 > 0.001 THEN 'metric s' || signal_id || '.peak at 0' END, 'metric s' || signal_id || '.offset_removed at 1'] ELSE [NULL] END) AS reason FROM s GROUP BY group_id, signal_id) GROUP BY group_id)", S)
def run_verdicts(spark, d):
    """A recorded run, promoted, against one on other input: an offset on some signals, which the second stage (not kept) takes away, and one more group."""
    b, folder = _bundle(spark, d), f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    moved = F.when((F.col("group_id") % 3 == 0) & (F.col("signal_id") % 2 == 1), F.col("value") + 0.01).otherwise(F.col("value"))
    plan = [pipeline.Stage("gain", {"gain": 2.0}), pipeline.Stage("detrend", retention="never"), pipeline.Stage("threshold", {"level": 0.3})]
    pipeline.write_run(pipeline.run_groups(b.each(lambda df: df.where("NOT group_id <=> 9")), plan), folder, "before", plan)
    pipeline.write_run(pipeline.run_groups(pipeline.Bundle(b.samples.withColumn("value", moved), b.signals), plan), folder, "after", plan)
    named = regress.promote(spark.createDataFrame([], "name string, run_id string, abs_tol double, rel_tol double"), "golden", "before", 1e-3, 0.0)
    return comparison.check_baseline(spark, folder, named, "golden", "after").verdicts().select("group_id", "verdict", "reasons")


@query("SELECT label AS group_id, s::INTEGER AS stage_ordinal, CASE WHEN label % 2 = 1 THEN 'fresh' WHEN s <= 1 THEN 'copied' ELSE 'fresh' END AS origin, count(*) AS signals FROM embeddings CROSS JOIN range(0, 4) x(s) GROUP BY ALL")
def run_resumed(spark, d):
    """A run of four stages after its third was edited: even groups go on from it, odd ones have other input. origin: whether a stage's samples are the earlier run's."""
    b, folder = _bundle(spark, d), f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    plan = lambda g: [pipeline.Stage("detrend"), pipeline.Stage("threshold", {"level": 0.1}), pipeline.Stage("gain", {"gain": g}), pipeline.Stage("detrend", {"mode": "linear"})]
    before = pipeline.Bundle(b.samples.withColumn("value", F.when(F.col("group_id") % 2 == 1, F.col("value") + 0.5 * F.col("idx")).otherwise(F.col("value"))), b.signals)
    pipeline.run_incremental(before, plan(2.0), folder, "r1")
    again = pipeline.run_incremental(b, plan(3.0), folder, "r2")
    kept = spark.read.parquet(f"{folder}/run_signals").where("run_id = 'r2' AND stage_ordinal >= 0").groupBy("group_id", "stage_ordinal").agg(F.count("*").alias("signals"))
    ran = again.signals.where("stage_ordinal >= 0").select("group_id", "stage_ordinal", F.lit("fresh").alias("origin")).distinct()
    return kept.join(ran, ["group_id", "stage_ordinal"], "left").withColumn("origin", F.coalesce("origin", F.lit("copied"))).select("group_id", "stage_ordinal", "origin", "signals")


RATES = "q AS (SELECT group_id, signal_id, idx, value, CASE WHEN group_id % 2 = 1 THEN 128.0 ELSE 64.0 END::DOUBLE AS hz FROM s)"
RATED = "edge AS (SELECT *, sum(CASE WHEN o AND NOT prev THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, value >= 0.1 AS o, coalesce(lag(value >= 0.1) OVER (PARTITION BY signal_id ORDER BY idx), false) AS prev FROM q)), det AS (SELECT group_id, signal_id, any_value(hz) AS hz, min(idx) AS a, max(idx) + 1 AS b FROM edge WHERE o GROUP BY group_id, signal_id, isl)"


def _rates(spark, d):
    """The signals of odd groups at twice the rate."""
    b = _bundle(spark, d)
    fast = F.when(F.col("group_id") % 2 == 1, 2 * RATE_HZ).otherwise(RATE_HZ)
    return pipeline.Bundle(b.samples.withColumn("t_s", F.col("idx") / fast), b.signals.withColumn("rate_hz", fast))


@query(f"SELECT group_id, count(*)::DOUBLE AS detections, {r('max((b - a) / hz)')} AS widest_s, {r('avg((b - a) / hz)')} AS width_mean, {r('sum((b - a) / hz) / (64 / any_value(hz))')} AS duty FROM det GROUP BY group_id", S, RATES, RATED)
def rates_detections(spark, d):
    run = pipeline.run_groups(_rates(spark, d), [pipeline.Stage("threshold", {"level": 0.1}), pipeline.Stage("pulse_metrics")])
    m = run.metrics.groupBy("group_id").pivot("name", ["detections", "widest_s", "width_mean", "duty"]).agg(F.first("value"))
    return rounded(m, "widest_s", "width_mean", "duty")


@query(f"SELECT group_id, signal_id, {r('arg_max(k, (p, -k)) * any_value(hz) / 64')} AS peak_hz FROM (SELECT group_id, signal_id, k, any_value(hz) AS hz, round((pow(sum(value * cos(2 * pi() * k * idx / 64)), 2) + pow(sum(value * sin(2 * pi() * k * idx / 64)), 2)) * CASE WHEN k IN (0, 32) THEN 0.25 ELSE 1 END, 9) AS p FROM q CROSS JOIN range(0, 33) x(k) GROUP BY group_id, signal_id, k) GROUP BY group_id, signal_id", S, RATES)
def rates_spectrum(spark, d):
    run = pipeline.run_groups(_rates(spark, d), [pipeline.Stage("fft", {"window": "rect"})])
    return rounded(stages.spectrum_metrics(run.artifacts[0, "spectrum"]).select("group_id", "signal_id", "peak_hz"), "peak_hz")


@query(f"SELECT group_id, signal_id, count(*) AS symbols, {r('max(t)')} AS last_s, count(*) FILTER (value > 0) AS ones FROM (SELECT *, idx / hz AS t, hz / 16 AS ratio FROM q) WHERE floor((ceil(idx / ratio - 0.5) + 0.5) * ratio) = idx GROUP BY group_id, signal_id", S, RATES)
def rates_symbols(spark, d):
    """Sixteen symbols a second, of which signals at twice the rate have half as many."""
    run = pipeline.run_groups(_rates(spark, d), [pipeline.Stage("symbols", {"symbol_rate_hz": 16.0, "align": "start"})])
    out = run.artifacts[0, "symbols"].groupBy("group_id", "signal_id").agg(F.count("*").alias("symbols"), F.max("t_s").alias("last_s"), F.sum("symbol").alias("ones"))
    return rounded(out, "last_s")


@query("SELECT group_id, signal_id, count(*) AS peaks, round(min(idx / hz), 6)::DOUBLE AS first_s FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM q WINDOW w AS (PARTITION BY signal_id ORDER BY idx)) WHERE a < value AND b < value GROUP BY group_id, signal_id", S, RATES)
def rates_peaks(spark, d):
    run = pipeline.run_groups(_rates(spark, d), [pipeline.Stage("peaks")])
    return rounded(run.artifacts[0, "peaks"].groupBy("group_id", "signal_id").agg(F.count("*").alias("peaks"), F.min("time_s").alias("first_s")), "first_s")


@query(f"SELECT group_id, signal_id, {r('sum(value)')} AS total FROM (SELECT group_id, signal_id, value * CASE WHEN group_id % 2 = 1 THEN b128 ELSE b64 END AS value FROM q, (SELECT (1 - cos(2 * pi() * 8 / 64)) / 2 / (1 + sin(2 * pi() * 8 / 64) / sqrt(2)) AS b64, (1 - cos(2 * pi() * 8 / 128)) / 2 / (1 + sin(2 * pi() * 8 / 128) / sqrt(2)) AS b128) WHERE idx = 0) GROUP BY group_id, signal_id", S, RATES)
def rates_filter(spark, d):
    """The first output of each signal is its first sample times the first coefficient for the signal's own rate."""
    run = pipeline.run_groups(_rates(spark, d), [pipeline.Stage("filter", {"cutoff_hz": 8.0})])
    return rounded(run.last.samples.where("idx = 0").select("group_id", "signal_id", F.col("value").alias("total")), "total")


@query("SELECT signal_id, idx, bit FROM (SELECT signal_id, idx, coalesce(last_value(CASE WHEN value > 0.07 THEN 1 WHEN value < -0.03 THEN 0 END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS bit FROM s)", S)
def slice_blocks(spark, d):
    """Levels sliced in blocks of eight samples, each taking over what the blocks before leave."""
    return stages.slice_levels(samples(spark, d), 0.02, 0.1, block=8).select("signal_id", "idx", "bit")


@query("SELECT 'user, \"' || user_id || '\"' AS name, count(*) AS pulses, 1::BIGINT AS failed FROM events GROUP BY user_id")
def stream_ingest(spark, d):
    """A watched folder with a file that can't be read among others: seen at the first look, read at the second."""
    folder, rules = _csv(spark, d)
    spark.createDataFrame([("x",), ("a,b",), ("c,d",)], "value string").coalesce(1).write.mode("append").text(folder)
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for _ in range(2):
        ledger = streaming.scan_folder(spark, folder, f"{at}/ledger", f"{at}/out", rules)
    failed = ledger.agg(F.count_if(F.col("state") == "failed").alias("failed"))
    names = spark.read.parquet(f"{at}/out/groups").select("path", "group_ord", "name")
    return spark.read.parquet(f"{at}/out/pulses").join(names, ["path", "group_ord"]).groupBy("name").agg(F.count("*").alias("pulses")).crossJoin(F.broadcast(failed))  # one row


@query("SELECT user_id::VARCHAR AS name, event_type AS type, count(*) AS n FROM events GROUP BY user_id, event_type")
def csv_headers(spark, d):
    """Another delimiter, and columns of count, time and name that are found by what they are called."""
    p = pulses(spark, d).withColumn("idx", F.row_number().over(W.partitionBy("group_id").orderBy("toa_s", "pulse_id")) - 1).withColumnRenamed("group_id", "group_ord").withColumn("ms", F.col("toa_s") * 1000)
    groups = p.select("group_ord", F.col("group_ord").cast("string").alias("name")).distinct()
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    pulse_csv.write_pulse_csv(groups, p, folder, ["event_type"], time="ms", whole=True, sep=";", labels=("Group ID", "Num. Pulses", "Time of Arrival"))
    own, found, _ = pulse_csv.read_pulse_csv(spark, folder, pulse_csv.Profile(toa_unit="ms", pulse_rules={"event_type": pulse_csv.Rule(text=True)}))
    return found.join(own.select("path", "group_ord", "name"), ["path", "group_ord"]).groupBy("name", F.col("fields")["event_type"].alias("type")).agg(F.count("*").alias("n"))


@query(f"SELECT 'd' AS dataset, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS train, user_id AS group_id, dense_rank() OVER (PARTITION BY user_id % 2 ORDER BY user_id)::INTEGER - 1 AS group_ord, count(*) AS pulses, {r('max(value)')} AS high FROM events GROUP BY user_id")
def library_commit(spark, d):
    """A dataset with two trains, published at once; a later commit that fails on its second table shows nothing of its first."""
    path = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    p = pulses(spark, d).withColumn("idx", F.row_number().over(W.partitionBy("group_id").orderBy("toa_s", "pulse_id")) - 1)
    transaction.add_dataset(spark, path, "d", p.withColumn("train", F.when(F.col("group_id") % 2 == 0, "even").otherwise("odd")), ("value",))
    there = transaction.tables(spark, path)
    try:
        transaction.commit(spark, path, {"groups": there["groups"], "fields": there["fields"].withColumn("low", F.raise_error(F.lit("broken")).cast("double"))})
    except Exception as e:  # the failure is what is shown here
        assert "broken" in str(e)
    there = transaction.tables(spark, path)
    high = there["fields"].select("group_id", "high")
    return rounded(there["groups"].join(high, "group_id").select("dataset", "train", "group_id", "group_ord", "pulses", "high"), "high")


@query("SELECT signal_id, word, bits, printf('%02x', value) AS hex, value FROM (SELECT signal_id, idx // 8 AS word, string_agg((value > 0)::INTEGER::VARCHAR, '' ORDER BY idx) AS bits, sum((value > 0)::BIGINT << (7 - idx % 8)::INTEGER)::BIGINT AS value FROM s GROUP BY signal_id, idx // 8)", S)
def bitpack_hex(spark, d):
    sign = samples(spark, d).select("group_id", "signal_id", F.col("idx").alias("k"), (F.col("value") > 0).cast("int").alias("symbol"))
    return stages.pack_bits(sign, 8).select("signal_id", "word", "bits", "hex", "value")


@query("SELECT group_id, signal_id, idx, round(t_s, 6)::DOUBLE AS t_s, round(value, 6)::DOUBLE + 0.0::DOUBLE AS value FROM s", S)
def passthrough(spark, d):
    return rounded(pipeline.run(samples(spark, d), [pipeline.Stage("passthrough")]), "t_s", "value").select("group_id", "signal_id", "idx", "t_s", "value")


@query(f"SELECT 'g' || group_id AS group_id, metric, (dense_rank() OVER (ORDER BY 'g' || group_id) - 1)::DOUBLE AS x, {r('value')} AS value FROM m", S, M)
def metric_curve_text(spark, d):
    """Groups that have texts for ids, in their order."""
    m = _metrics(samples(spark, d)).withColumn("group_id", F.concat(F.lit("g"), F.col("group_id").cast("string")))
    rungs = m.select("group_id").distinct().where("group_id != 'g0'").select("group_id", F.lit("snr_db").alias("key"), F.lit(0.5).alias("rung"))
    return rounded(profile.metric_curve(m, rungs), "value")


@query(f"SELECT group_id, signal_id, level, cell, {r('min(value)')} AS low, {r('max(value)')} AS high FROM (SELECT s.*, l AS level, idx // (8 << l)::INTEGER AS cell FROM s CROSS JOIN range(0, 4) x(l)) GROUP BY group_id, signal_id, level, cell", S)
def stream_pyramid(spark, d):
    """Cells of level 0 from a stream of samples, closed by the watermark and rolled up as a batch; a late sample of no signal closes the last."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    s = samples(spark, d)
    end = s.agg(F.lit(-1).cast(s.schema["group_id"].dataType).alias("group_id"), F.lit(-1).cast(s.schema["signal_id"].dataType).alias("signal_id"), F.lit(1 << 20).cast("long").alias("idx"), F.lit(0.0).alias("t_s"), F.lit(0.0).alias("value"))
    s.write.parquet(f"{folder}/in")
    cells = streaming.pyramid_cells(spark.readStream.schema(s.schema).parquet(f"{folder}/in"), 8, RATE_HZ)
    streaming.run_now(cells, f"{folder}/checkpoint", f"{folder}/out")
    end.select(s.columns).write.mode("append").parquet(f"{folder}/in")
    found = streaming.run_now(streaming.pyramid_cells(spark.readStream.schema(s.schema).parquet(f"{folder}/in"), 8, RATE_HZ), f"{folder}/checkpoint", f"{folder}/out")
    return rounded(profile.rolled_up(found.where("signal_id >= 0"), None, "group_id", "signal_id"), "low", "high").select("group_id", "signal_id", F.col("level").cast("long").alias("level"), "cell", "low", "high")
