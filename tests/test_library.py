"""Framing, writing, catalog, sources, pipelines and streams on small tables, against plain Python where there is an order to follow."""

import math
import os
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtables.functions.expressions import expression
from sigtables.functions.scalars import cell_text, narrowed, quoted, shortest_time
from sigtables.operators import catalog, generate, library, profile, regress, specs, stages, transaction
from sigtables.plans import pipeline
from sigtables.sources import framing, pulse_csv
from sigtables.streaming import events as streaming

SAMPLES = "group_id long, signal_id long, idx long, t_s double, value double"


def framed(lines, width):
    """(group, row) of each line, one after the other."""
    out, at, group = [], 0, 0
    while at < len(lines):
        take = int(lines[at][1]) if lines[at][1].isdigit() else None
        out.append((group, -1))
        at, row = at + 1, 0
        while at < len(lines) and (take is None or row < take) and len(lines[at]) == width:
            out.append((group, row))
            at, row = at + 1, row + 1
        group += 1
    return out


@pytest.mark.parametrize("width", [2, 3])
def test_framing_in_buckets_is_that_of_one_pass(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(framing, "BUCKET", 7)
    rnd = random.Random(width)
    for name in "ab":  # counts are right, too large, too small or no numbers; with width 2 any line may be a group's
        lines = []
        for _ in range(40):
            n = rnd.randint(0, 9)
            lines.append(["g", rnd.choice([str(n), str(n), str(n + 3), str(max(0, n - 2)), "x"])])
            lines += [[str(rnd.randint(0, 9)) for _ in range(width)] for _ in range(n)]
        text = ["top", "id,count", ",".join(["time", "a", "b"][:width])]
        for x in lines:
            text += rnd.choice([[], ["# note"], [" "]]) + [",".join(x)]
        (tmp_path / f"{name}.csv").write_text("\n".join(text) + "\n")
        got = pulse_csv.read_rows(spark, str(tmp_path / f"{name}.csv")).orderBy("line").select("group_ord", "row").collect()
        assert [tuple(r) for r in got] == framed(lines, width)
    both = pulse_csv.read_rows(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert both.groupBy("path").count().count() == 2


def test_files_are_numbered_across_splits(spark, tmp_path):
    rows = "".join(f"{i},{i % 7}\n" for i in range(5000))
    (tmp_path / "long.csv").write_text("top\nid,n\ntoa,v\ng,5000\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        groups, pulses, wrong = pulse_csv.read_pulse_csv(spark, str(tmp_path / "long.csv"))
        assert pulse_csv.lines_of(spark, str(tmp_path / "long.csv")).rdd.getNumPartitions() > 4
        assert pulses.where("abs(toa_s - idx / 1e6) > 1e-12 OR line != idx + 5").count() == 0 and pulses.count() == 5000
        assert groups.first().actual_count == 5000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_overrides_and_rules(spark, tmp_path):
    (tmp_path / "q.csv").write_text('top\r"which; one";how many;"a ""b"""\rwhen;x y;z\r"g; 1";2;"say ""hi"""\r1;300.7;t\r2;-4;\r')
    p = pulse_csv.Profile(count="how many", name="which; one", time="WHEN", toa_unit="ms", pulse_rules={"x y": pulse_csv.Rule(key="x", dtype="u8"), "z": pulse_csv.Rule(text=True)}, group_rules={"how many": pulse_csv.Rule(skip=True)})
    groups, pulses, wrong = pulse_csv.read_pulse_csv(spark, str(tmp_path / "q.csv"), p)
    g = groups.first()
    assert (g.name, g.actual_count, g.attributes) == ("g; 1", 2, {"which_one": "g; 1", "a_b": 'say "hi"'})
    assert [(r.toa_s, r.x, r.z) for r in pulse_csv.typed_fields(pulses, p, ["x", "z"]).orderBy("idx").collect()] == [(0.001, 255.0, "t"), (0.002, 0.0, "")]
    assert wrong.count() == 0
    (tmp_path / "u.csv").write_bytes(b"top\nid,n\ntoa,v\ng,1\n1,\xff\n")
    with pytest.raises(Exception, match="line 5: not UTF-8"):
        pulse_csv.read_rows(spark, str(tmp_path / "u.csv")).collect()


def test_written_files_read_back(spark, tmp_path):
    names = ["plain", "a,b", 'say "x"', " pad ", "#no", ""]
    groups = spark.createDataFrame(list(enumerate(names)), "group_ord int, name string")
    rows = [(0, 0, 0.001, 5.0, "x"), (0, 1, 0.1 + 0.2, None, "a,b"), (0, 2, 1 / 3, float("nan"), None), (2, 0, 7.0, 1e-7, "#t"), (2, 1, 8.0, -2.5, '"')]
    pulse_csv.write_pulse_csv(groups, spark.createDataFrame(rows, "group_ord int, idx int, toa_s double, v double, s string"), str(tmp_path / "out"), ["v", "s"], time="toa_s", unit="s")
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.read_text())
    (tmp_path / "one.csv").write_text(text + "\n")
    p = pulse_csv.Profile(toa_unit="s", pulse_rules={"s": pulse_csv.Rule(text=True)})
    g, pulses, wrong = pulse_csv.read_pulse_csv(spark, str(tmp_path / "one.csv"), p)
    assert [(r.name, r.actual_count) for r in g.orderBy("group_ord").collect()] == [(n.strip(), c) for n, c in zip(names, (3, 0, 2, 0, 0, 0), strict=True)]
    got = [(r.group_ord, r.idx, r.toa_s, None if math.isnan(r.v) else r.v, r.s or None) for r in pulse_csv.typed_fields(pulses, p, ["v", "s"]).orderBy("group_ord", "idx").collect()]
    assert got == [(a, b, t, None if v is None or math.isnan(v) else v, s) for a, b, t, v, s in rows] and wrong.count() == 0


def test_cell_texts(spark):
    df = spark.createDataFrame([(5.0,), (-0.0,), (2.5,), (float("nan"),), (None,), (1e300,)], "v double")
    assert [r[0] for r in df.select(cell_text(df.v)).collect()] == ["5", "0", "2.5", "", "", "1.0E300"]
    assert [r[0] for r in df.select(narrowed(df.v, "i16")).collect()] == [5.0, 0.0, 3.0, 0.0, None, 32767.0]
    t = spark.createDataFrame([(0.001,), (0.1 + 0.2,), (2.0,), (None,)], "t double")
    assert [r[0] for r in t.select(shortest_time(t.t, 1e-3)).collect()] == ["1", "300.00000000000006", "2000", None]
    s = spark.createDataFrame([("a",), ("a,b",), ('"',), ("x ",)], "s string")
    assert [r[0] for r in s.select(quoted(s.s)).collect()] == ["a", '"a,b"', '""""', '"x "']


def test_properties_by_json_type(spark):
    rows = [(1, '{"a": "0012", "b": 12, "c": true, "d": null, "e": [1, 2], "f": "NaN", "g": "true", "h": 1.5, "i": {"x": 1}}'), (2, "[1]"), (3, "no json"), (4, None), (5, "{}")]
    got = {r.key: (r.num_value, r.txt_value) for r in catalog.property_index(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    assert got == {"a": (None, "0012"), "b": (12.0, None), "c": (1.0, None), "e": (None, "[1,2]"), "f": (None, "NaN"), "g": (None, "true"), "h": (1.5, None), "i": (None, '{"x":1}')}
    T = catalog.PropertyTest
    forms = {"": T(), " 5 ": T(5.0, 5.0), ">=2": T(2.0), "> 2": T(2.0), "<=3": T(high=3.0), "<3": T(high=3.0), "1..4": T(1.0, 4.0), "..4": T(high=4.0), "=nrz": T(equals="nrz"), "nrz": T(equals="nrz"), ">x": T(equals=">x")}
    assert {f: catalog.parse_test(f) for f in forms} == forms


def test_contents_differ_by_a_bit(spark):
    rows = [("g", 1, [1.0, 2.0]), ("g", 2, [1.0, 2.0]), ("g", 3, [1.0 + 1e-11, 2.0]), ("g", 4, [1.0, math.nextafter(2.0, 3.0)]), ("g", 5, [0.0]), ("g", 6, [-0.0]), ("g", 7, [float("nan"), None])]
    s = spark.createDataFrame(rows, "group_id string, signal_id long, values array<double>")
    assert sorted((r.signal_id, r.copies) for r in catalog.content_classes(s).collect()) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    long = s.select("group_id", "signal_id", F.posexplode("values").alias("idx", "value"))
    assert sorted((r.signal_id, r.copies) for r in catalog.content_classes_of_samples(long, 1).collect()) == [(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]


def test_audit_of_an_empty_and_a_sound_library(spark):
    contents = spark.createDataFrame([(1, 1, "559aead08264d5795d3909718cdd05abd49572e84fe55590eef31a88a08fdffd", 1)], "content long, byte_len long, checksum string, refcount long")
    signals = spark.createDataFrame([(9, 1)], "id long, content long")
    data = spark.createDataFrame([(1, bytearray(b"A"))], "content long, data binary")
    assert library.verify(contents, library.references({"signals": signals}), data).count() == 0
    assert library.verify(contents.limit(0), library.references({"signals": signals.limit(0)}), data.limit(0)).count() == 0
    assert [(r.content, r.fault) for r in library.verify(contents, library.references({"signals": signals}), data.limit(0)).collect()] == [(1, "length")]


def lfsr(order, taps, n):
    state, out = (1 << order) - 1, []
    for _ in range(n):
        out.append(state & 1)
        state = state >> 1 | ((state & taps).bit_count() & 1) << (order - 1)
    return out


@pytest.mark.parametrize("order", [2, 3, 7, 9, 12, 16, 31, 32])
def test_prbs_blocks_against_a_register(order):
    lags = generate.prbs_lags(order)
    want = lfsr(order, sum(1 << i for i in lags), 3000)
    for start, n in ((0, 3000), (1, 5), (1000, 777), (2999, 1)):
        assert generate.prbs_block(order, lags, start, n).tolist() == want[start : start + n]
    if order <= 12:  # of maximal length
        period = (1 << order) - 1
        bits = generate.prbs_block(order, lags, 0, 2 * period)
        assert (bits[:period] == bits[period:]).all() and bits[:period].sum() == 1 << (order - 1)


def test_expressions(spark):
    df = spark.createDataFrame([(0.0,), (-1.5,), (2.0,), (float("nan"),)], "t double")

    def of(text):
        return [r[0] for r in df.select(expression(text, t=df.t)).collect()]

    assert of("2 ^ 3 ^ 2 - -1")[0] == 513 and of("-2 ^ 2")[0] == -4 and of("round(t) + floor(t)")[1] == -4
    assert of("1 / t")[0] == math.inf and math.isnan(of("t / 0")[0]) and of("t % 1")[1] == -0.5
    assert of("ln(t)")[0] == -math.inf and math.isnan(of("ln(t)")[1]) and of("max(t, 1)")[3] == 1 and of("min(1, t)")[3] == 1
    assert of("sign(t)")[:3] == [0, -1, 1] and math.isnan(of("ceil(t)")[3])
    for bad in ("t +", "foo(t)", "x", "t.real", "__import__('os')", "t if t else 1", "sin(t, t)", "'a'", "True"):
        with pytest.raises(ValueError):
            expression(bad, t=df.t)


def test_specs(spark):
    keys = spark.createDataFrame([(0, 1)], "group_id long, signal_id long")
    for name, spec in specs.PRESETS.items():
        assert specs.issues(spec) == [], name
        v = [r.value for r in specs.make(keys, specs.put(spec, "/duration_s", 200 / spec["rate_hz"])).collect()]
        assert len(v) == 200 and all(map(math.isfinite, v)) and any(v), name
    bad = {"rate_hz": 100.0, "duration_s": 1.0, "root": {"kind": "sum", "terms": [{"kind": "sine", "freq_hz": 60.0}, {"kind": "square"}, {"kind": "none"}, {"kind": "fm", "carrier_hz": 5.0, "dev_hz": 1.0, "input": {"kind": "noise"}}, {"kind": "expr", "text": "t +"}]}}
    assert [at for s, at, _ in specs.issues(bad) if s == "error"] == ["/root/terms/0/freq_hz", "/root/terms/1/freq_hz", "/root/terms/2", "/root/terms/3/input", "/root/terms/4/text"]
    with pytest.raises(ValueError):
        specs.make(keys, bad)
    assert [at for _, at, _ in specs.issues({"rate_hz": 0, "duration_s": 1})] == ["/rate_hz"]
    ladder = specs.ladder(specs.PRESETS["prbs9-nrz"], "/root/order", [7.4, 8.6])
    assert [specs.get(s, "/root/order") for _, s in ladder] == [7, 9] and specs.PRESETS["prbs9-nrz"]["root"]["order"] == 9
    with pytest.raises(KeyError):
        specs.get(bad, "/root/terms/9")
    assert specs.train_issues(1, 1, [], [0.1])[0][1] == "/fields" and specs.train_issues(2, 3, [{"name": "a b"}, {"name": "A-b"}], [0.1], -0.05)[0][1] == "/drift_s"


def test_integrals_are_those_of_the_sources(spark):
    grid = generate.grid(spark.createDataFrame([(0, 1)], "group_id long, signal_id long"), 4096.0, 1.0)
    for kind in ("sine", "square", "triangle", "sawtooth"):
        node = {"kind": "gain", "factor": 2.0, "input": {"kind": "delay", "by_s": 0.125, "input": {"kind": kind, "freq_hz": 3.0, "offset": 0.25}}}
        rows = grid.select("idx", specs.render(node, F.col("idx"), 4096.0, 1.0, F.col("signal_id")).alias("v"), specs.integral(node, F.col("t_s")).alias("i")).orderBy("idx").collect()
        total = np.cumsum([0.0, *(r.v for r in rows[:-1])]) / 4096
        assert np.abs(total - [r.i for r in rows]).max() < 2e-3, kind


def test_rungs():
    assert generate.rungs(start=0.0, stop=1.0, step=0.25) == [0.0, 0.25, 0.5, 0.75, 1.0] and generate.rungs(start=3.0, stop=1.0, step=-2.0) == [3.0, 1.0]
    for bad in ({"values": []}, {"start": 0.0, "stop": 1.0, "step": 0.0}, {"start": 0.0, "stop": 1.0, "step": -1.0}, {"start": 0.0, "stop": 1e9, "step": 1.0}, {"values": [math.inf]}):
        with pytest.raises(ValueError):
            generate.rungs(**bad)


def test_align_irregular(spark):
    rows = [(0, 1, 0, 0.0, 1.0), (0, 1, 1, 0.25, 3.0), (0, 1, 2, 1.0, 0.0), (0, 2, 0, 0.5, 7.0)]
    got = {(r.signal_id, r.idx): r.value for r in generate.align(spark.createDataFrame(rows, SAMPLES), 4.0, 6, 0.0).collect()}
    assert [got[1, i] for i in range(6)] == [1.0, 3.0, 2.0, 1.0, 0.0, 0.0] and [got[2, i] for i in range(4)] == [0.0, 0.0, 7.0, 0.0]


@pytest.mark.parametrize("block", [2, 3, 64])
def test_filter_in_blocks(spark, block):
    rnd = np.random.default_rng(block)
    x = {1: rnd.standard_normal(100), 2: rnd.standard_normal(7), 3: np.array([1.0])}
    s = spark.createDataFrame([(0, k, i, i / 64, float(v)) for k, xs in x.items() for i, v in enumerate(xs)], SAMPLES)
    arrays = spark.createDataFrame([(0, k, [float(v) for v in xs]) for k, xs in x.items()], "group_id long, signal_id long, values array<double>")
    for response, sections in (("low", 1), ("notch", 3)):
        want = {r.signal_id: r["values"] for r in stages.filter_signals(arrays, response, 6.0, 64.0, 2.0, sections).collect()}
        got = {}
        for r in stages.filter_samples(s, response, 6.0, 64.0, 2.0, sections, block).orderBy("signal_id", "idx").collect():
            got.setdefault(r.signal_id, []).append(r.value)
        assert all(np.allclose(got[k], want[k], atol=1e-10) for k in x) and set(got) == set(want)


def test_peaks_in_a_window_and_dips(spark):
    v = [0.0, 5.0, 1.0, 3.0, 2.0, 4.0, -6.0, 9.0, 0.0]
    s = spark.createDataFrame([("g", 1, v)], "group_id string, signal_id int, values array<double>")
    assert [(r.time_s, r.prominence) for r in stages.peaks(s, 1.0, window_s=2.0).collect()] == [(1.0, 4.0), (3.0, 1.0), (5.0, 2.0), (7.0, 9.0)]
    assert [(r.time_s, r.amplitude, r.prominence) for r in stages.peaks(s, 1.0, falling=True, min_prominence=2.0).collect()] == [(2.0, 1.0, 3.0), (6.0, -6.0, 11.0)]


def test_first_edge_symbols_and_nrz(spark):
    bits = [1, 0, 1, 1, 0, 0, 1, 0]
    wave = [-1.0] * 3 + [2.0 * b - 1 for b in bits for _ in range(4)]
    s = spark.createDataFrame([(0, 1, i, i / 16, v) for i, v in enumerate(wave)], SAMPLES)
    got = stages.symbols(s, 4.0, 16.0, [-1.0, 1.0], align="first-edge")
    assert [r.symbol for r in got.orderBy("k").collect()][-8:] == bits
    words = stages.pack_bits(got, 8, 1, invert=True).collect()
    assert words[0].bits == "".join(str(1 - b) for b in bits) and words[0].hex == f"{int(words[0].bits, 2):02x}"


def test_viewports(spark):
    s = spark.createDataFrame([(0, 1, i, i / 8, float(i)) for i in range(64)], SAMPLES)
    assert [(r.low, r.high) for r in profile.viewport(s, 1.0, 3.0, 2, "signal_id", shift=1.0).orderBy("px").collect()] == [(0.0, 7.0), (8.0, 15.0)]
    assert profile.pyramid(s, 8, None, "signal_id").where("level = 3").collect()[0].high == 63.0
    assert profile.histogram(s, 4, float("nan"), 1.0).where("bin = 4").first().n == 63


def bundle(spark, values):
    s = spark.createDataFrame([(g, k, i, i / 8, v) for g, k, vs in values for i, v in enumerate(vs)], SAMPLES)
    signals = spark.createDataFrame([(g, k, k, f"s{k}", "analog", 8.0, 0.0, {"a": "1", "b": "2"}) for g, k, _ in values], "group_id long, signal_id long, ordinal int, name string, domain string, rate_hz double, t0_s double, attributes map<string,string>")
    return pipeline.Bundle(s, signals)


def test_a_bad_group_stops_alone(spark):
    b = bundle(spark, [(1, 0, [1.0, 2.0]), (2, 0, [5.0, 6.0]), (3, 0, [0.0, 1.0])])

    def half(table, by):
        if (table["value"] > 5).any():
            raise ValueError("too high")
        return table.assign(value=table["value"] / by)

    if "ext.half" not in pipeline.STAGES:
        pipeline.per_group("ext.half", half, SAMPLES, [pipeline.Param("by", default=2.0)])
    r = pipeline.run_groups(b, [pipeline.Stage("gain", {"gain": 1.0}), pipeline.Stage("ext.half"), pipeline.Stage("statistics")])
    assert {(x.group_id, x.status, x.failed_stage, x.message) for x in r.groups.collect()} == {(1, "ok", None, None), (2, "failed", 1, "ValueError: too high"), (3, "ok", None, None)}
    assert {(x.group_id, x.stage_ordinal) for x in r.signals.collect()} == {(1, -1), (1, 0), (1, 1), (1, 2), (2, -1), (2, 0), (3, -1), (3, 0), (3, 1), (3, 2)}
    assert sorted(x.value for x in r.last.samples.collect()) == [0.0, 0.5, 0.5, 1.0]
    with pytest.raises(ValueError, match="begins with ext"):
        pipeline.register_stage("half", half)


def test_outputs_on_a_frame(spark):
    b = bundle(spark, [(1, 0, [1.0]), (1, 1, [2.0]), (1, 2, [3.0])])
    one = lambda k: b.signals.where(F.col("signal_id") == k)
    added = spark.createDataFrame([(1, "sum", "analog", 0, 0.0, 6.0)], "group_id long, name string, domain string, idx long, t_s double, value double")
    patch = spark.createDataFrame([(1, 2, {"b": "3", "c": "4"}, ["a"])], "group_id long, signal_id long, set map<string,string>, remove array<string>")
    props = spark.createDataFrame([(1, "n", 2.0)], "group_id long, key string, value double")
    after, d = pipeline.apply_outputs(b, pipeline.Outputs(stages.gain(b.samples.where("signal_id = 1"), 10.0), only=one(1), dropped=one(0), added=added, attributes=patch, properties=props))
    assert [(r.name, r.disposition) for r in d.orderBy("ordinal").collect()] == [("s1", "replaced"), ("s2", "passthrough"), ("sum", "added"), ("s0", "dropped")]
    assert sorted(r.value for r in after.samples.collect()) == [3.0, 6.0, 20.0]
    assert {r.name: r.attributes for r in after.signals.collect()} == {"s1": {"a": "1", "b": "2"}, "s2": {"b": "3", "c": "4"}, "sum": {}}
    again, _ = pipeline.apply_outputs(after, pipeline.Outputs(properties=props.withColumn("value", F.lit(5.0))))
    assert [r.value for r in again.properties.collect()] == [5.0]


def test_stages_of_every_kind_chain(spark):
    wave = [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0] * 4
    b = bundle(spark, [(1, 0, wave), (2, 0, wave)])
    plan = [("passthrough", {}), ("gain", {}), ("normalise", {}), ("filter", {"cutoff_hz": 3.9}), ("fft", {"signal": "s0"}), ("peaks", {}), ("threshold", {"level": 0.5}), ("pulse_metrics", {"write_back": True}), ("slice", {"level": 0.5, "signal": "s0"}), ("symbols", {"symbol_rate_hz": 2.0, "level": 0.5, "spacing": 1.0}), ("bits", {}), ("clip", {"lo": 0.0, "hi": 1.0}), ("noise", {"snr_db": 60.0}), ("drop", {"signal": "logic"})]
    r = pipeline.run_groups(b, [pipeline.Stage(k, p) for k, p in plan])
    assert {x.status for x in r.groups.collect()} == {"ok"} and r.last.signals.count() == 2
    m = {(x.stage_ordinal, x.name): x.value for x in r.metrics.where("group_id = 1").collect()}
    assert m[4, "s0.peak_hz"] in (0.0, 2.0) and m[6, "detections"] == 8 == m[7, "pulses"] and m[8, "transitions"] >= 15 and m[9, "s0.symbols"] > 5
    assert {x.key for x in r.last.properties.collect()} == {"detection_count", "prf_hz", "duty"}


def test_retention_and_reuse(spark, tmp_path):
    b = bundle(spark, [(1, 0, [1.0, 2.0]), (2, 0, [5.0, 7.0])])
    plan = [pipeline.Stage("gain", {"gain": 2.0}), pipeline.Stage("detrend", retention="on_failure"), pipeline.Stage("gain", {"gain": 3.0})]
    run = pipeline.run_groups(b, plan)
    pipeline.write_run(run, str(tmp_path / "runs"), "r1", plan)
    stored = spark.read.parquet(str(tmp_path / "runs/run_samples"))
    assert {r.stage_ordinal for r in stored.select("stage_ordinal").distinct().collect()} == {0, 2}
    cache = pipeline.plan_incremental(pipeline.input_hashes(b), pipeline.stage_keys(plan), spark.createDataFrame([], "cache_key string"))
    assert cache.where("hit").count() == 0
    changed = pipeline.Bundle(b.samples.withColumn("value", F.when(F.col("group_id") == 2, F.col("value") + 1e-12).otherwise(F.col("value"))), b.signals)
    hits = pipeline.plan_incremental(pipeline.input_hashes(changed), pipeline.stage_keys(plan), cache)
    assert {(r.group_id, r.hit) for r in hits.collect()} == {(1, True), (2, False)}
def test_a_run_goes_on_from_the_first_edited_stage(spark, tmp_path):
    wave = [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0] * 4
    b, path, calls = bundle(spark, [(1, 0, wave), (2, 0, wave), (3, 0, wave)]), str(tmp_path / "runs"), tmp_path / "calls"
    calls.mkdir()

    def counted(name):
        def run(table, by):
            for g in table["group_id"].unique():
                (calls / f"{name}-{g}-{os.urandom(4).hex()}").touch()
            return table.assign(value=table["value"] * by)

        if f"ext.{name}" not in pipeline.STAGES:
            pipeline.per_group(f"ext.{name}", run, SAMPLES, [pipeline.Param("by", default=1.0)])

    def ran():
        out = sorted(x.name.rsplit("-", 1)[0] for x in calls.iterdir())
        for x in calls.iterdir():
            x.unlink()
        return out

    for name in "abcd":
        counted(name)
    plan = lambda by: [pipeline.Stage("ext.a"), pipeline.Stage("threshold", {"level": 0.5}), pipeline.Stage("ext.b", {"by": 2.0}), pipeline.Stage("ext.c", {"by": by}), pipeline.Stage("pulse_metrics", {"write_back": True}), pipeline.Stage("ext.d")]
    table = lambda name, run: spark.read.parquet(f"{path}/run_{name}").where(F.col("run_id") == run)
    pipeline.run_incremental(b, plan(3.0), path, "r1")
    assert ran() == [f"{s}-{g}" for s in "abcd" for g in (1, 2, 3)]
    assert table("samples", "r1").where("stage_ordinal = 5").agg(F.max("value")).first()[0] == 6.0
    pipeline.run_incremental(b, plan(3.0), path, "r2")
    assert ran() == []
    changed = pipeline.Bundle(b.samples.withColumn("value", F.when(F.col("group_id") == 3, F.col("value") + 1).otherwise(F.col("value"))), b.signals)
    pipeline.run_incremental(changed, plan(5.0), path, "r3")  # stage 3 is edited, and group 3 is new input
    assert ran() == ["a-3", "b-3", "c-1", "c-2", "c-3", "d-1", "d-2", "d-3"]
    whole = pipeline.run_groups(changed, plan(5.0))
    pipeline.write_run(whole, path, "whole", plan(5.0))
    for name in ("groups", "signals", "metrics", "artifacts", "samples", "states", "properties"):
        assert sorted(map(str, table(name, "r3").drop("run_id").collect())) == sorted(map(str, table(name, "whole").drop("run_id").collect())), name
    assert table("keys", "r3").count() == 18 and sorted(r.status for r in table("groups", "r2").collect()) == ["ok"] * 3


def test_times_of_irregular_signals_are_input(spark):
    b = bundle(spark, [(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])])
    hashed = lambda x: [r.input_hash for r in pipeline.input_hashes(x).orderBy("group_id").collect()]
    irregular = pipeline.Bundle(b.samples, b.signals.withColumn("rate_hz", F.lit(None).cast("double")))
    moved = lambda x: pipeline.Bundle(x.samples.withColumn("t_s", F.col("t_s") + F.when(F.col("group_id") == 2, 0.5).otherwise(0.0)), x.signals)
    assert [a == c for a, c in zip(hashed(irregular), hashed(moved(irregular)), strict=True)] == [True, False]
    assert hashed(b) == hashed(moved(b)) and hashed(b) != hashed(irregular)


def test_stages_go_by_each_signals_own_rate(spark):
    n = 256
    rows = [(g, 0, i, 1.0 + i / rate, math.sin(2 * math.pi * 8 * i / rate)) for g, rate in ((1, 64.0), (2, 128.0)) for i in range(n)]
    rows += [(3, 0, i, 0.1 * i * i, float(i % 4 == 2)) for i in range(16)]
    s = spark.createDataFrame(rows, SAMPLES)
    signals = spark.createDataFrame([(1, 0, 0, "a", "analog", 64.0, 1.0, {}), (2, 0, 0, "a", "analog", 128.0, 1.0, {}), (3, 0, 0, "a", "analog", None, 0.0, {})], "group_id long, signal_id long, ordinal int, name string, domain string, rate_hz double, t0_s double, attributes map<string,string>")
    b = pipeline.Bundle(s, signals)
    plan = [("fft", {}), ("threshold", {"level": 0.5}), ("peaks", {"min_prominence": 0.5}), ("pulse_metrics", {}), ("filter", {"cutoff_hz": 2.0, "sections": 2}), ("statistics", {})]
    r = pipeline.run_groups(b, [pipeline.Stage(k, p) for k, p in plan])
    m = {(x.group_id, x.stage_ordinal, x.name): x.value for x in r.metrics.collect()}
    assert m[1, 0, "a.peak_hz"] == m[2, 0, "a.peak_hz"] == 8.0 and (3, 0, "a.peak_hz") not in m
    for g, rate in ((1, 64.0), (2, 128.0), (3, None)):
        x = s.where(F.col("group_id") == g)
        want = sorted((y.start_s, y.end_s) for y in stages.threshold(x, 0.5, period_s=None if rate is None else 1 / rate).collect())
        assert sorted((y.start_s, y.end_s) for y in r.artifacts[1, "detections"].where(F.col("group_id") == g).collect()) == want
        assert m[g, 1, "widest_s"] == max(e - a for a, e in want)
        own = {t for _, _, _, t, _ in rows}
        assert all(y.time_s in own for y in r.artifacts[2, "peaks"].where(F.col("group_id") == g).collect())
        if rate:
            alone = stages.filter_samples(x, "low", 2.0, rate, sections=2).collect()
            got = r.last.samples.where(F.col("group_id") == g).collect()
            assert {y.idx: round(y.value, 12) for y in got} == {y.idx: round(y.value, 12) for y in alone} and {y.idx: y.t_s for y in got} == {i: 1.0 + i / rate for i in range(n)}
    assert abs(m[1, 3, "duty"] - 1 / 3) < 0.05 and abs(m[2, 3, "duty"] - 1 / 3) < 0.05 and abs(m[1, 3, "prf_hz"] - 8.0) < 1e-9 > abs(m[2, 3, "prf_hz"] - 8.0)
    assert {(x.group_id, x.stage_ordinal) for x in r.notes.collect()} == {(3, 0), (3, 4)} and {x.status for x in r.groups.collect()} == {"ok"}
    slow = pipeline.run_groups(b, [pipeline.Stage("symbols", {"symbol_rate_hz": 100.0})]).groups.collect()
    assert {x.group_id: x.status for x in slow} == {1: "failed", 2: "ok", 3: "failed"}


def test_ports_know_domains(spark):
    if "ext.logic" not in pipeline.STAGES:
        pipeline.register_stage("ext.logic", lambda b: pipeline.Outputs(), domains=("digital_logic",))
    b = bundle(spark, [(1, 0, [0.0, 1.0])])
    with pytest.raises(ValueError, match="stage 1: needs digital_logic signals"):
        pipeline.run_groups(b, [pipeline.Stage("gain"), pipeline.Stage("ext.logic"), pipeline.Stage("slice")])
    assert pipeline.run_groups(b, [pipeline.Stage("slice"), pipeline.Stage("ext.logic")]).groups.first().status == "ok"
    assert pipeline.issues([pipeline.Stage("ext.logic")]) == [] != pipeline.issues([pipeline.Stage("ext.logic")], domains=["analog"])


def test_hooks_of_a_run(spark, tmp_path):
    seen = []
    if "ext.curve" not in pipeline.STAGES:
        count = lambda b, top: {"curve": b.samples.groupBy((F.col("value") >= top).alias("above")).agg(F.count("*").alias("n"))}
        pipeline.register_stage("ext.curve", lambda b, top: pipeline.Outputs(), [pipeline.Param("top", default=1.0)], begin=lambda b, top: seen.append(top), end=count, salt="v1")
    b, plan = bundle(spark, [(1, 0, [0.0, 1.0]), (2, 0, [3.0, 4.0])]), [pipeline.Stage("gain", {"gain": 2.0}), pipeline.Stage("ext.curve", {"top": 2.0})]
    r = pipeline.run_groups(b, plan)
    assert seen == [2.0] and {(x.above, x.n) for x in r.whole[1, "curve"].collect()} == {(True, 3), (False, 1)}
    pipeline.write_run(r, str(tmp_path), "r", plan)
    assert {(x.group_id, x.port, x.stage_ordinal) for x in spark.read.parquet(str(tmp_path / "run_artifacts")).collect()} == {(None, "curve", 1)}
    keys = pipeline.stage_keys(plan)
    d = pipeline.STAGES["ext.curve"]
    pipeline.STAGES["ext.curve"] = pipeline.replace(d, salt="v2")
    assert [a == c for a, c in zip(keys, pipeline.stage_keys(plan), strict=True)] == [True, False]
    pipeline.STAGES["ext.curve"] = d


def test_plans_grow_with_the_stages_only(spark):
    b = bundle(spark, [(1, 0, [1.0, 2.0])])

    def windows(n):
        plan = pipeline.run_groups(b, [pipeline.Stage("detrend")] * n).signals._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Window [")

    assert windows(8) <= 8 * max(1, windows(1))
    stats = pipeline.run_groups(b, [pipeline.Stage("gain"), pipeline.Stage("statistics")])
    assert "Window" not in stats.artifacts[1, "statistics"]._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_found_in_a_run_is_found_once(spark, tmp_path):
    b = bundle(spark, [(1, 0, [0.0, 1.0, 1.0, 0.0]), (2, 0, [0.0, 0.0, 0.0, 0.0])])
    plan = [pipeline.Stage("gain"), pipeline.Stage("threshold", {"level": 0.5}), pipeline.Stage("gain")]
    r = pipeline.run_groups(b, plan)
    told = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (r.metrics, r.last.properties, r.artifacts[1, "detections"]):
        assert "MapInArrow" not in told(df)
    assert {(x.group_id, x.value) for x in r.last.properties.collect()} == {(1, 1.0), (2, 0.0)}
    assert "Join" not in told(r.last.samples) and "Aggregate" not in told(r.last.samples)
    some = pipeline.Bundle(b.samples, b.signals.where("group_id = 1"))
    assert {x.group_id for x in pipeline.STAGES["threshold"].run(some, 0.0, "rising", 0.0, 0.0).artifacts["detections"].collect()} == {1}
    for name in ("r 1/2", "r1"):
        pipeline.write_run(r, str(tmp_path), name, plan)
    kept = {n: spark.read.parquet(str(tmp_path / f"run_{n}")) for n in ("samples", "signals", "metrics", "properties", "artifacts")}
    for df in kept.values():
        assert len({x["count"] for x in df.groupBy("run_id").count().collect()}) == 1 and {x.run_id for x in df.select("run_id").distinct().collect()} == {"r 1/2", "r1"}


def test_an_irregular_signal_leaves_the_hashes_of_others(spark):
    b = bundle(spark, [(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])])
    mixed = pipeline.Bundle(b.samples, b.signals.withColumn("rate_hz", F.when(F.col("group_id") == 1, F.col("rate_hz"))))
    one, two = ({r.group_id: r.input_hash for r in pipeline.input_hashes(x).collect()} for x in (b, mixed))
    assert one[1] == two[1] and one[2] != two[2]


def test_stays_along_a_signal_in_any_order(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(6):
        v, x = [], 0.0
        for _ in range(3000):
            x = rnd.choice([x, x, x, rnd.uniform(-1, 1), float("nan") if k == 5 else 0.4])
            v.append(x)
        rows += [(k % 2, k, i, i / 8, y) for i, y in enumerate(v)]
    rnd.shuffle(rows)

    def brute(level, hysteresis, sign):
        out = []
        for k in range(6):
            on, found = False, None
            for r in sorted(r for r in rows if r[1] == k):
                v = r[4] * sign
                stays = v >= level * sign if not on else not (v < level * sign if hysteresis == 0 else v <= level * sign - hysteresis)
                on = stays and v == v
                if on:
                    found = [r[3], r[3], v] if found is None else [found[0], r[3], max(v, found[2])]
                elif found:
                    out.append((k, found[0], found[1] + 0.125, found[2] * sign))
                    found = None
            if found:
                out.append((k, found[0], found[1] + 0.125, found[2] * sign))
        return sorted(out)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        for parts, level, hysteresis, falling in ((1, 0.5, 0.3, False), (3, 0.5, 0.3, False), (5, -0.2, 0.0, True), (4, -0.2, 0.5, True)):
            s = spark.createDataFrame(rows, SAMPLES)
            s = s.repartition(parts) if parts > 1 else s.coalesce(1).sortWithinPartitions("signal_id", "idx")
            got = stages.threshold(s, level, hysteresis, period_s=0.125, falling=falling).collect()
            assert sorted((r.signal_id, r.start_s, r.end_s, r.peak) for r in got) == brute(level, hysteresis, -1 if falling else 1)
            crossings = {r.signal_id: r.crossings for r in profile.zero_crossings(s, "signal_id").collect()}
            for k in range(6):
                v = [r[4] for r in sorted(r for r in rows if r[1] == k) if r[4] == r[4] and r[4] != 0]
                assert crossings[k] == sum((a > 0) != (b > 0) for a, b in zip(v, v[1:], strict=False))
        bits = {(r.signal_id, r.idx): r.bit for r in stages.slice_levels(s, 0.1, 0.4, block=256).collect()}
        for k in range(6):
            bit = 0
            for r in sorted(r for r in rows if r[1] == k):
                bit = 1 if r[4] > 0.1 + 0.2 else 0 if r[4] < 0.1 - 0.2 else bit
                assert bits[k, r[2]] == bit
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_assertions_of_every_kind(spark):
    groups = spark.createDataFrame([(1, "ok"), (2, "failed")], "group_id long, status string")
    metrics = spark.createDataFrame([(0, 1, "a", 1.0), (1, 1, "a", 2.0), (0, 2, "a", float("nan"))], "stage_ordinal int, group_id long, name string, value double")
    known = regress.facts(groups, metrics)
    lines = ["a == 2", "stage[0].metrics.a == 1", "a != 5", "status == ok", "status > 1", "b > 0", "a > baseline", "a within 50 % of 4"]
    got = {(r.group_id, r.ordinal): r.status for r in regress.check(groups, known, lines).collect()}
    assert [got[1, i] for i in range(8)] == ["pass", "pass", "pass", "pass", "error", "not_applicable", "not_applicable", "pass"]
    assert [got[2, i] for i in range(4)] == ["fail", "fail", "pass", "fail"]
    with_base = regress.check(groups, known, ["a >= baseline"], known.where("group_id = 1")).collect()
    assert {r.group_id: r.status for r in with_base} == {1: "pass", 2: "error"}
    for bad in ("a", "a ~ 3", "a within of 3"):
        with pytest.raises(ValueError):
            regress.assertion(bad)
    with pytest.raises(ValueError):
        regress.check(groups, known, [regress.Assertion("a", "~", 1.0)])


def test_a_watched_folder(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "old.csv").write_text("top\nid,n\ntoa,v\ng,1\n1,2\n")
    os.utime(folder / "old.csv", (1e9, 1e9))
    (folder / "new.csv").write_text("top\nid,n\ntoa,v\ng,2\n1,2\n3,4\n")
    (folder / "bad.tsv").write_text("top\nid\ttotal\ntoa\tv\ng\t1\n")
    (folder / "note.md").write_text("no")
    look = lambda: {r.path.rsplit("/", 1)[1]: r.state for r in streaming.scan_folder(spark, str(folder), str(tmp_path / "ledger"), out, adopt_before=datetime(2010, 1, 1)).collect()}
    assert look() == {"old.csv": "adopted", "new.csv": "seen", "bad.tsv": "seen"}
    (folder / "new.csv").write_text("top\nid,n\ntoa,v\ng,3\n1,2\n3,4\n5,6\n")
    assert look() == {"old.csv": "adopted", "new.csv": "seen", "bad.tsv": "failed"}
    assert look() == {"old.csv": "adopted", "new.csv": "read", "bad.tsv": "failed"}
    assert spark.read.parquet(f"{out}/pulses").count() == 3
    kept = (folder / "new.csv").read_text()
    (folder / "new.csv").unlink()
    assert look() == {"old.csv": "adopted", "bad.tsv": "failed"}
    (folder / "new.csv").write_text(kept)
    assert look()["new.csv"] == "seen"


def test_commits_show_all_tables_or_none(spark, tmp_path):
    path, one = str(tmp_path / "lib"), spark.createDataFrame([(1,)], "a long")
    assert transaction.tables(spark, path) == {} == transaction.versions(spark, path)
    assert transaction.commit(spark, path, {"x": one, "y": one}) == 1
    with pytest.raises(Exception, match="broken"):
        transaction.commit(spark, path, {"x": one, "y": one.select(F.raise_error(F.lit("broken")).cast("long").alias("a"))})
    assert {n: t.count() for n, t in transaction.tables(spark, path).items()} == {"x": 1, "y": 1} and len(transaction.abandoned(spark, path)) == 1
    assert transaction.commit(spark, path, {"x": one}) == 2 and transaction.commit(spark, path, {"x": one}, replace=("x",)) == 3
    assert {v: transaction.tables(spark, path, v)["x"].count() for v in (1, 2, 3)} == {1: 1, 2: 2, 3: 1}
    (tmp_path / "lib/_commits/4.json").write_text('{"x": [')  # one that isn't whole yet
    assert max(transaction.versions(spark, path)) == 3
    (tmp_path / "lib/_commits/4.json").unlink()
    pulses = spark.createDataFrame([("t", 1, 0, 0.5, 2.0), ("t", 1, 1, 0.7, float("nan")), ("u", 2, 0, 0.1, 5.0)], "train string, group_id long, idx long, toa_s double, v double")
    transaction.add_dataset(spark, path, "d", pulses, ("v",))
    there = transaction.tables(spark, path)
    assert sorted((r.train, r.group_id, r.pulses, r.t0_s) for r in there["groups"].collect()) == [("t", 1, 2, 0.5), ("u", 2, 1, 0.1)]
    assert sorted((r.group_id, r.low, r.high, r.n) for r in there["fields"].collect()) == [(1, 2.0, 2.0, 1), (2, 5.0, 5.0, 1)]
    with pytest.raises(ValueError, match="there already"):
        transaction.add_dataset(spark, path, "d", pulses, ("v",))


def test_spectra_of_long_signals(spark):
    rng = np.random.default_rng(5)
    rows = {(0, 1): rng.normal(size=5000), (0, 2): rng.normal(size=4096), (1, 3): rng.normal(size=3), (1, 4): np.ones(1)}
    s = spark.createDataFrame([(g, k, i, i / 64, float(v)) for (g, k), x in rows.items() for i, v in enumerate(x)], SAMPLES).withColumn("hz", F.when(F.col("group_id") == 1, 128.0).otherwise(64.0)).repartition(5)
    for window, size in (("hann", 0), ("rect", 3000), ("flat-top", 0)):
        got = {}
        for r in stages.long_spectrum(s, "hz", window, size, columns=16).collect():
            got.setdefault((r.group_id, r.signal_id), {})[r.k] = (r.freq_hz, r.magnitude_db, r.phase_rad)
        for key, x in rows.items():
            arrays = spark.createDataFrame([(*key, x.tolist())], "group_id long, signal_id long, values array<double>")
            want = {r.k: (r.freq_hz, r.magnitude_db, r.phase_rad) for r in stages.spectrum(arrays, 128.0 if key[0] else 64.0, window, size).collect()}
            mine = got[key]
            assert mine.keys() == want.keys()
            for k, (f, db, phase) in want.items():
                assert mine[k][0] == f and (abs(mine[k][1] - db) < 1e-6 or db != db and mine[k][1] != mine[k][1])
                if db != db:
                    continue
                assert db < -200 or abs(math.remainder(mine[k][2] - phase, 2 * math.pi)) < 1e-6 or abs(abs(mine[k][2]) - math.pi) < 1e-9


def test_stream_of_samples_in_several_batches(spark, tmp_path):
    v = [0.0, 2.0, 2.0, 0.0, 3.0, 0.5, 1.5, 1.5]
    rows = [(0, 1, i / 4, x) for i, x in enumerate(v)]
    batches = [rows[2:4], rows[:2] + rows[4:6], rows[6:], [(-1, -1, 9e4, 0.0)]]
    for k, part in enumerate(batches):
        df = spark.createDataFrame(part, "group_id long, signal_id long, t_s double, value double").withColumn("ts", F.timestamp_micros(((F.col("t_s") + 86400) * 1e6).cast("long")))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = streaming.run_now(streaming.detections(stream, 1.0, 0.25, 0.25), str(tmp_path / "c"), str(tmp_path / "out"))
        del k
    got = sorted((r.start_s, r.end_s, r.peak) for r in out.where("signal_id = 1").collect())
    s = spark.createDataFrame([(0, 1, i, i / 4, x) for i, x in enumerate(v)], SAMPLES)
    assert got == sorted((r.start_s, r.end_s, r.peak) for r in stages.threshold(s, 1.0, 0.25, period_s=0.25).collect())


def test_sources_are_made_by_many_tasks(spark):
    """A few specs in one part of a file make many samples, in more than one task."""
    one = spark.range(0, 64, 1, 1).select(F.col("id").alias("signal_id"), F.lit(1).alias("group_id"))
    for made in (generate.grid(one, 64.0, 1.0), generate.prbs(one, 7, 200, 64.0, block=64), generate.pulse_train(one, 50, [0.1])):
        rows = made.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(rows) > 1 and max(r["count"] for r in rows) <= sum(r["count"] for r in rows) / 2


def test_filter_carries_states_of_many_signals_at_once(spark, monkeypatch):
    """Signals of several lengths and rates in blocks of 4, against one pass; no Python group is made for a signal."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda *_: pytest.fail("a Python group for each signal"))
    rnd = random.Random(5)
    signals = {(g, s): [rnd.random() for _ in range(n)] for s, (g, n) in enumerate([(0, 1), (0, 4), (1, 5), (1, 13), (0, 13), (1, 4)])}
    rows = [(g, s, i, i / 64, v, 64.0 + 64 * g) for (g, s), x in signals.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, SAMPLES + ", rate double")
    got = {(r.group_id, r.signal_id, r.idx): r.value for r in stages.filter_samples(d, "notch", 9.0, "rate", 0.8, 2, block=4).collect()}
    assert len(got) == len(rows)
    for (g, s), x in signals.items():
        b0, b1, b2, a1, a2 = stages.biquad_coefficients("notch", 9.0, 64.0 + 64 * g, 0.8)
        for _ in range(2):
            y = []
            for i, v in enumerate(x):
                y.append(b0 * v + (b1 * x[i - 1] - a1 * y[i - 1] if i else 0) + (b2 * x[i - 2] - a2 * y[i - 2] if i > 1 else 0))
            x = y
        assert np.allclose([got[g, s, i] for i in range(len(x))], x, atol=1e-12)


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_long_spectra_of_many_signals_at_once(spark, monkeypatch, batch):
    """Signals of several lengths and rates, in batches that cut through groups; no Python group is made for a part of a signal."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", lambda *_: pytest.fail("a Python group for each part"))
    rnd = random.Random(6)
    made = [(g, s, [rnd.random() for _ in range(n)], 64.0 + s) for s, (g, n) in enumerate([(2, 1), (0, 2), (0, 40), (2, 64), (1, 64), (1, 100)])]
    samples = spark.createDataFrame([(g, s, i, i / 64, v, hz) for g, s, x, hz in made for i, v in enumerate(x)], SAMPLES + ", rate double")
    arrays = spark.createDataFrame(made, "group_id long, signal_id long, values array<double>, rate double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, want = ({(r.group_id, r.signal_id, r.k): (r.freq_hz, r.magnitude_db) for r in d.collect()} for d in (stages.long_spectrum(samples, "rate", columns=2), stages.spectrum(arrays, "rate")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-6, equal_nan=True) for k in want)


def test_stream_detections_of_many_signals_share_calls(spark, tmp_path, monkeypatch):
    """Signals that share a bucket, some without a group, over two batches: as in a table, and a state isn't a signal's own."""
    frame = type(spark.range(1))
    calls, of = [], frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *by: calls.append(by) or of(self, *by))
    rnd = random.Random(7)
    rows = [(g, s, i, i / 64, rnd.choice([rnd.random(), float("nan"), None]) if rnd.random() < 0.3 else rnd.random()) for g, s in [(None, 1), (0, 1), (1, 2), (1, 3), (2**60 + 1, 4)] for i in range(60)]
    table = spark.createDataFrame(rows, SAMPLES).withColumn("ts", F.timestamp_micros(((F.col("t_s") + 86400) * 1e6).cast("long")))
    beat = spark.createDataFrame([(-1, -1, 0, 9e5, 0.0)], SAMPLES).withColumn("ts", F.timestamp_micros((F.col("t_s") * 1e6).cast("long")))
    names = ["group_id", "signal_id", "t_s", "value", "ts"]
    folder, out = str(tmp_path / "in"), []
    for part in (table.where("idx % 3 = 0 AND idx < 40"), table.where("idx % 3 != 0 OR idx >= 40").union(beat)):
        part.select(names).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(table.select(names).schema).parquet(folder)
        out = streaming.run_now(streaming.detections(stream, 0.5, 0.1, 1 / 64, late="1 hour", buckets=2), str(tmp_path / "c"), str(tmp_path / "out")).where("signal_id >= 0").collect()
    assert calls and all(by == ("bucket",) for by in calls)
    want = []
    for key in {r[:2] for r in rows}:
        now = None
        for _, _, _, t, v in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            nan = v is None or v != v
            if now and (nan or v <= 0.4):
                want.append((*key, *now))
                now = None
            elif now:
                now = (now[0], t + 1 / 64, max(now[2], v))
            elif not nan and v >= 0.5:
                now = (t, t + 1 / 64, v)
        want += [(*key, *now)] if now else []
    told = lambda found: sorted((str(g), s, round(a, 9), round(b, 9), round(p, 9)) for g, s, a, b, p in found)
    assert told(out) == told(want)


def test_payload_kinds_come_from_one_pass(spark):
    """Objects, empty arrays, nulls, nested pairs and a repeated id; the table is read once."""
    rows = [(1, '{"a": {"x": [1]}, "b": [], "c": null, "d": [null, "t"], "e": [[1, 2]], "f": [null]}'), (2, '{"a": 1}'), (2, '{"a": "s"}'), (3, "{}"), (4, "[1]"), (5, "no")]
    made = regress.payload_schema(spark.createDataFrame(rows, "id long, payload string"), "id", "payload")
    got = sorted(map(tuple, made.collect()))
    assert [r for r in got if r[0] != 2] == [(1, "a", "json"), (1, "b", "float"), (1, "c", "float"), (1, "d", "text"), (1, "e", "span"), (1, "f", "float")]
    assert len([r for r in got if r[0] == 2]) == 2
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


@pytest.mark.parametrize("rel_tol", [0.0, 0.05])
def test_samples_are_compared_without_a_join(spark, monkeypatch, rel_tol):
    """Pairs of two runs' samples against all pairs in Python: missing, repeated, NaN, infinite and null ones, in several blocks and without a group; no sample is joined."""
    monkeypatch.setattr(regress, "BLOCK", 4, raising=False)
    rnd, nan, inf = random.Random(8), math.nan, math.inf
    odd, steps = [None, nan, inf, -inf, 0.0, 1.0], [0.0, 0.01, 0.04, 0.3]
    value = lambda s: rnd.choice(odd) if s % 3 == 0 and rnd.random() < 0.3 else 1.0 + rnd.choice(steps[: 2 if s % 4 == 3 else 4])
    rows = [[(None if s > 20 else s % 2, s, i, value(s)) for s in range(24) for i in range(11) for _ in range(rnd.choice([1, 1, 2, 3]) if s % 4 == 1 else s % 4 != 2 or rnd.random() < 0.8)] for _ in "bc"]
    b, c = (spark.createDataFrame(x, "group_id int, signal_id long, idx long, value double").repartition(5) for x in rows)

    def off(x, y):
        if x is None or y is None or x != x or y != y:
            return 0.0 if x is y or x is not None and y is not None and x != x and y != y else inf
        return 0.0 if x == y else abs(x - y)

    want = {}
    for g, s in {r[:2] for x in rows for r in x}:
        own = [[(r[2], r[3]) for r in x if r[:2] == (g, s)] for x in rows]
        finite = [v for _, v in own[0] if v is not None and math.isfinite(v)]
        bound = max(0.03, math.sqrt(sum(v * v for v in finite) / len(finite)) * rel_tol)
        of = [{i: [v for j, v in x if j == i] for i, _ in x} for x in own]
        e = [(i, off(x, y)) for i in of[0].keys() & of[1].keys() for x in of[0][i] for y in of[1][i]]
        e += [(i, inf) for k in (0, 1) for i in of[k].keys() - of[1 - k].keys() for _ in of[k][i]]
        beyond = min((i for i, x in e if x > bound), default=None)
        want[g, s] = (len(e), max(x for _, x in e), math.sqrt(sum(x * x for _, x in e) / len(e)), beyond, beyond is None)
    out = regress.diff_samples(b, c, 0.03, rel_tol)
    got = {(r.group_id, r.signal_id): tuple(r)[2:] for r in out.collect()}
    assert got.keys() == want.keys() and len({w[4] for w in want.values()}) == 2
    assert [(k, got[k], w) for k, w in want.items() if (*got[k][:2], *got[k][3:]) != (*w[:2], *w[3:]) or got[k][2] != pytest.approx(w[2], rel=1e-9)] == []
    if not rel_tol:
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_artifacts_are_joined_by_row_not_by_cell(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, "a"), (1, 1, None, "b"), (1, 2, 3.0, None), (None, 0, 1.0, "a")], "group_id int, row int, value double, text string")
    other = spark.createDataFrame([(1, 0, 1.4, "a"), (1, 1, None, "c"), (1, 3, 3.0, None), (2, 0, 1.0, "a")], "group_id int, row int, value double, text string")
    out = regress.diff_artifacts(rows, other, ["value", "text"], 0.5, "group_id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "value", 2, 2), (1, "text", 3, 1), (None, "value", 1, 0), (None, "text", 1, 0), (2, "value", 1, 0), (2, "text", 1, 0)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and all("field" not in line for line in plan.splitlines() if "Join" in line)
