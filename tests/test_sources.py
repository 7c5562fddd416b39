import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigtables.functions.scalars import cell_number, normalise_key, to_seconds
from sigtables.operators import catalog, generate, profile, regress, stages
from sigtables.plans import pipeline
from sigtables.sources import pulse_csv

FILE = "made by hand\r\nName, span, NRec, note\r\nTOA, width, level\r\n\r\n# note\r\ng1, 5, 2, first\r\n1, 0.5, 10\r\n2, NA, 1_0\r\ng2, 6, 4, short\r\n3, 0.25, 9\r\ng3, 1, x, unreadable\r\n7, 1, 2\r\n"


def test_csv_framing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + FILE.encode())
    groups, pulses, wrong = pulse_csv.read_pulse_csv(spark, str(tmp_path / "a.csv"))
    got = {r["name"]: (r.declared_count, r.actual_count) for r in groups.collect()}
    assert got == {"g1": (2, 2), "g2": (4, 1), "g3": (1, 1)}
    assert [r.toa_s for r in pulses.orderBy("group_ord", "idx").collect()] == [1e-6, 2e-6, 3e-6, 7e-6]
    assert sorted((r.group_ord, r.column or "") for r in wrong.collect()) == [(0, "level"), (1, "")]
    for bad, what in (("x\na,b\ntoa,d\ng,1\n", "no count column"), ("x\na,n\nc,d\ng,1\n", "no time column"), ("x\na,n,\ntoa,d\ng,1,2\n", "without a name")):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception, match=what):
            pulse_csv.read_rows(spark, str(tmp_path / "bad.csv")).collect()


def test_csv_small_and_large_files_are_framed_alike(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    for k, (end, bom) in enumerate((("\n", ""), ("\r\n", "\ufeff"), ("\r", ""), ("\n", "\ufeff"))):
        lines = ["preamble é", "# no", "Name;NRec;note;note", "TOA;level;level;lévél"]
        for _ in range(60):
            lines.append(rnd.choice(["# c", "", "   ", "g;3;a;b", "g;x;a;b", "g;2;a", f"1;2;{rnd.random()};x", "2;na;\"q;\"\"é\";4", "3;1_0;5;6", "4;5;6;7"]))
        (tmp_path / f"f{k}.csv").write_bytes((bom + end.join(lines) + end * (k % 2)).encode())
    read = lambda f: sorted(map(str, f(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1)).collect()))
    whole = read(pulse_csv.read_rows)
    monkeypatch.setattr(pulse_csv, "SMALL", 0)
    assert read(pulse_csv.read_rows) == whole and len(whole) > 100
    rows = pulse_csv.read_rows(spark, str(tmp_path))
    for r in rows.where("row >= 0").collect():
        raw = (tmp_path / r.path.rsplit("/", 1)[1]).read_bytes()
        assert raw[r.offset :].decode().startswith(r.time)
    assert {k for r in rows.collect() for k in r.fields} == {"toa", "level", "level_2", "l_v_l"} and {k for r in rows.collect() for k in r.attributes} == {"name", "nrec", "note", "note_2"}


def test_a_file_is_framed_in_little_memory(monkeypatch):
    body = b"x\nid,n\ntoa,v\n" + b"".join(b"g%d,1000\n" % g + b"1,2\n" * 1000 for g in range(1000))
    tracemalloc.start()
    rows = sum(b.num_rows for b in pulse_csv.framed("f", body, pulse_csv.Profile(), None))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_001_000 and most < 48 << 20
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bc", "\r", "\n", "\r\n", "\n\r"]) for _ in range(rnd.randint(0, 30))).encode()
        want = re.split(b"\r\n|\r|\n", text)
        for size in (1, 2, 3, 7, 1 << 20):
            monkeypatch.setattr(pulse_csv, "PIECE", size)
            got = [text[a:b] for a, b in pulse_csv.line_ends(np.frombuffer(text, np.uint8))]
            assert got == (want if want[-1] else want[:-1])
    assert list(pulse_csv.framed("f", pa.py_buffer(b""), pulse_csv.Profile(), None)) == []


def test_csv_errors_name_the_byte(spark, tmp_path, monkeypatch):
    good = b"x\nid,n\ntoa,v\ng,1\n1,2\n"
    (tmp_path / "a.csv").write_bytes(good + b"g,2\n1,\xff\n")
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe" + good)
    (tmp_path / "c.csv").write_bytes(good + b"h,1\n1,2d\n")
    with pytest.raises(Exception, match=rf"line 7: not UTF-8 \(byte {len(good) + 6}\)"):
        pulse_csv.read_rows(spark, str(tmp_path / "a.csv")).collect()
    with pytest.raises(Exception, match="byte 0: UTF-16"):
        pulse_csv.read_rows(spark, str(tmp_path / "b.csv")).collect()
    wrong = pulse_csv.read_pulse_csv(spark, str(tmp_path / "c.csv"))[2].collect()
    assert [(r.line, r.offset, r.column) for r in wrong] == [(7, len(good) + 4, "v")]
    monkeypatch.setattr(pulse_csv, "SMALL", 0)
    assert pulse_csv.read_pulse_csv(spark, str(tmp_path / "c.csv"))[2].collect()[0].offset == len(good) + 4
    with pytest.raises(Exception, match="not UTF-8"):
        pulse_csv.read_rows(spark, str(tmp_path / "a.csv")).collect()


def test_csv_strict_and_sniff(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FILE)
    with pytest.raises(ValueError, match="declares 4"):
        pulse_csv.read_pulse_csv(spark, str(tmp_path / "a.csv"), strict=True)
    (tmp_path / "b.csv").write_text("x\nid,count\ntime,power,band,gap\ng,2\n1,0.5,X,\n2x,3,7,NA\n")
    with pytest.raises(ValueError, match="unreadable time 2x"):
        pulse_csv.read_pulse_csv(spark, str(tmp_path / "b.csv"), strict=True)
    (tmp_path / "c.csv").write_text("x\nid,count\ntime,power,band,gap\ng,2\n1,0.5,X,\n2,3,7,NA\n")
    assert pulse_csv.read_pulse_csv(spark, str(tmp_path / "c.csv"), strict=True)[1].count() == 2
    got = {r.column: r.kind for r in pulse_csv.sniff_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"time": "integer", "power": "number", "band": "text"}


def test_csv_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(g, i, float(rnd.randint(0, 999)), rnd.random()) for g in range(7) for i in range(rnd.randint(0, 20))]
    groups = spark.createDataFrame([(g, f"name{g}") for g in range(7)], "group_ord int, name string")
    pulse_csv.write_pulse_csv(groups, spark.createDataFrame(rows, "group_ord int, idx int, toa_us double, power double"), str(tmp_path / "out"), ["power"])
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.read_text())
    (tmp_path / "one.csv").write_text(text)
    _, pulses, wrong = pulse_csv.read_pulse_csv(spark, str(tmp_path / "one.csv"))
    got = sorted((r.group_ord, r.idx, r.toa_s, float(r.fields["power"])) for r in pulses.collect())
    assert got == [(g, i, t * 1e-6, p) for g, i, t, p in sorted(rows)] and wrong.count() == 0


def test_cells(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("1d",), ("NA",), ("-inf",), ("1_0",)], "c string")
    got = [r[0] for r in df.select(cell_number(df.c)).collect()]
    assert got[0] == 1.5 and got[3] == -math.inf and all(math.isnan(got[i]) for i in (1, 2, 4))
    label = spark.createDataFrame([(" Pulse  Width (us)",)], "a string")
    assert label.select(normalise_key(label.a)).first()[0] == "pulse_width_us"
    assert df.select(to_seconds(cell_number(df.c), "ms")).first()[0] == 0.0015


GROUPS = {"ordinary": [0.0, 1.0, 2.0, -1.0], "single": [3.0], "nan": [math.nan] * 3, "constant": [2.0] * 4, "mixed": [1.0, math.nan, math.inf, -2.0]}


@pytest.mark.parametrize("partitions", [1, 7])
def test_degenerate_groups(spark, partitions):
    rows = [(n, 0, i, i / 4, v) for n, values in GROUPS.items() for i, v in enumerate(values)]
    s = spark.createDataFrame(rows, "group_id string, signal_id int, idx long, t_s double, value double").repartition(partitions)
    got = {r.group_id: r for r in profile.summarise(s, "group_id").collect()}
    assert got["nan"].mean is None and got["nan"].non_finite == 3 and got["mixed"].max == 1.0 and got["constant"].std == 0
    for f in (stages.gain, stages.detrend, stages.normalise, lambda x: stages.detrend(x, "linear")):
        assert f(s).count() == len(rows)
    found = {(r.group_id, r.start_s): (r.end_s, r.peak) for r in stages.threshold(s, 1.0, period_s=0.25).collect()}
    assert found == {("ordinary", 0.25): (0.75, 2.0), ("single", 0.0): (0.25, 3.0), ("constant", 0.0): (1.0, 2.0), ("mixed", 0.0): (0.25, 1.0), ("mixed", 0.5): (0.75, math.inf)}
    assert all(r.within for r in regress.diff_samples(s, s, 0.0, 0.0).where("group_id <> 'mixed'").collect())


def test_peaks(spark):
    s = spark.createDataFrame([("g", 1, [0.0, 1.0, 0.0, 3.0, 3.0, 0.5, 2.0, 0.0]), ("g", 2, None), ("g", 3, [])], "group_id string, signal_id int, values array<double>")
    got = [(r.time_s, r.amplitude, r.prominence) for r in stages.peaks(s, 1.0).collect()]
    assert got == [(1.0, 1.0, 1.0), (3.0, 3.0, 3.0), (6.0, 2.0, 1.5)]
    assert [r.time_s for r in stages.peaks(s, 1.0, min_distance_s=4.0, max_count=1).collect()] == [3.0]


def test_pipeline_checks():
    P = pipeline.Stage
    assert pipeline.issues([P("gain", {"x": 1}), P("none"), P("am")]) == ["stage 0: no parameter x", "stage 1: no kind none", "stage 2: carrier_hz is missing", "stage 2: depth is missing"]
    wrong = [P("gain", {"gain": "2"}), P("filter", {"cutoff_hz": -1.0, "sections": 9, "response": "comb"}), P("pulse_metrics"), P("gain", {"gain": True}, retention="now")]
    assert pipeline.issues(wrong) == ["stage 0: gain: a float is needed", "stage 1: response: one of low, high, band, notch", "stage 1: cutoff_hz: out of range", "stage 1: sections: out of range", "stage 2: needs detections, which no stage before it gives", "stage 3: gain: a float is needed", "stage 3: retention: always, on_failure or never"]
    assert pipeline.issues([P("gain", enabled=False)]) == ["no stage is enabled"]
    assert pipeline.stage_keys([P("gain")]) == pipeline.stage_keys([P("gain", {"gain": 1.0})]) and pipeline.pipeline_hash([P("gain")]) != pipeline.pipeline_hash([P("gain", {"gain": 2.0})])
    a, b = pipeline.stage_keys([P("gain"), P("detrend")]), pipeline.stage_keys([P("gain"), P("normalise")])
    assert a[0] == b[0] and a[1] != b[1]


def test_generators(spark):
    specs = spark.createDataFrame([("a", 1), ("b", 2)], "group_id string, signal_id int")
    g = generate.grid(specs, 8.0, 1.0)
    assert g.count() == 16
    v = [r[0] for r in g.where("signal_id = 1").orderBy("idx").select(generate.trapezoid(g.t_s, 1.0, 0.25, 0.25, 0.25)).collect()]
    assert v == [0.0, 0.5, 1.0, 1.0, 1.0, 0.5, 0.0, 0.0]
    fixed = generate.pulse_train(specs, 5, [0.5]).where("group_id = 'a'").orderBy("pulse_idx").collect()
    assert [r.toa_s for r in fixed] == [0.0, 0.5, 1.0, 1.5, 2.0]
    moved = generate.pulse_train(specs, 5, [0.5], jitter_s=0.1).collect()
    assert all(abs(r.toa_s - 0.5 * r.pulse_idx) <= 0.1 for r in moved) and len({r.toa_s for r in moved}) == 10
    with pytest.raises(ValueError):
        generate.pulse_train(specs, 5, [])


def test_property_kinds(spark):
    P = catalog.Property
    rows = spark.createDataFrame([(1, {"f": "-1", "n": "2.5", "b": "Yes", "t": "abcd"}), (2, {"f": "x", "n": "3", "b": "maybe"}), (3, None)], "id int, a map<string,string>")
    kinds = [P("f", "frequency"), P("n", "integer"), P("b", "bool"), P("t", "text", max_length=3, required=True), P("d", "number", required=True, default="1")]
    got = sorted(tuple(r) for r in catalog.validate_properties(rows, "id", "a", kinds).collect())
    assert got == [(1, "f", "too_low"), (1, "n", "type"), (1, "t", "too_long"), (2, "b", "type"), (2, "f", "type"), (2, "t", "missing"), (3, "t", "missing")]
