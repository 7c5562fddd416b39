"""Sources as plain dicts: {"kind": ..., parameters, inputs}, checked before a job starts and rendered as one column of a grid."""

from __future__ import annotations

import copy
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtables.functions.expressions import expression
from sigtables.operators import generate

#: Parameters of each kind with their defaults; None: must be given. Inputs are other specs.
PARAMS: dict[str, dict[str, object]] = {
    "sine": {"freq_hz": None, "amp": 1.0, "phase_rad": 0.0, "offset": 0.0},
    "square": {"freq_hz": None, "amp": 1.0, "duty": 0.5, "offset": 0.0},
    "triangle": {"freq_hz": None, "amp": 1.0, "offset": 0.0},
    "sawtooth": {"freq_hz": None, "amp": 1.0, "offset": 0.0},
    "pulse": {"period_s": None, "width_s": None, "rise_s": 0.0, "fall_s": 0.0, "amp": 1.0},
    "chirp": {"f0_hz": None, "f1_hz": None, "law": "linear", "amp": 1.0},
    "dc": {"level": None},
    "ramp": {"slope": None},
    "step": {"at_s": None, "level": 1.0},
    "impulse": {"at_s": None, "level": 1.0},
    "noise": {"colour": "gaussian", "amp": 1.0, "seed": 1},
    "prbs": {"order": None, "amp": 1.0},
    "expr": {"text": None},
    "sum": {"terms": None},
    "product": {"terms": None},
    "concat": {"parts": None},
    "gain": {"input": None, "factor": None},
    "delay": {"input": None, "by_s": None},
    "clip": {"input": None, "lo": None, "hi": None},
    "envelope": {"input": None, "shape": None, "attack_s": 0.0, "decay_s": 0.0, "sustain": 1.0, "release_s": 0.0, "centre_s": 0.0, "sigma_s": 0.0, "alpha": 0.1},
    "am": {"carrier_hz": None, "depth": None, "input": None},
    "pm": {"carrier_hz": None, "dev_rad": None, "input": None},
    "fm": {"carrier_hz": None, "dev_hz": None, "input": None},
}
TONES = ("sine", "square", "triangle", "sawtooth")
#: Orders of PRBS whose whole period is held as an array; generate.prbs makes longer ones block by block.
PRBS_ORDER = 12

#: The named sources that come with the library, as rate_hz, duration_s and root.
PRESETS: dict[str, dict] = {
    "tone-1khz": {"rate_hz": 48e3, "duration_s": 1.0, "root": {"kind": "sine", "freq_hz": 1e3}},
    "two-tone": {"rate_hz": 48e3, "duration_s": 1.0, "root": {"kind": "sum", "terms": [{"kind": "sine", "freq_hz": 1e3, "amp": 0.5}, {"kind": "sine", "freq_hz": 1.1e3, "amp": 0.5}]}},
    "noisy-tone": {"rate_hz": 48e3, "duration_s": 1.0, "root": {"kind": "sum", "terms": [{"kind": "sine", "freq_hz": 1e3}, {"kind": "noise", "amp": 0.1}]}},
    "linear-chirp": {"rate_hz": 48e3, "duration_s": 1.0, "root": {"kind": "envelope", "shape": "tukey", "alpha": 0.1, "input": {"kind": "chirp", "f0_hz": 100.0, "f1_hz": 10e3}}},
    "pulse-train": {"rate_hz": 1e6, "duration_s": 0.01, "root": {"kind": "pulse", "period_s": 1e-3, "width_s": 50e-6, "rise_s": 5e-6, "fall_s": 5e-6}},
    "am-tone": {"rate_hz": 192e3, "duration_s": 0.05, "root": {"kind": "am", "carrier_hz": 10e3, "depth": 0.5, "input": {"kind": "sine", "freq_hz": 100.0}}},
    "fm-tone": {"rate_hz": 192e3, "duration_s": 0.05, "root": {"kind": "fm", "carrier_hz": 10e3, "dev_hz": 2e3, "input": {"kind": "sine", "freq_hz": 200.0}}},
    "prbs9-nrz": {"rate_hz": 1e6, "duration_s": 0.005, "root": {"kind": "prbs", "order": 9}},
    "step-edge": {"rate_hz": 1e6, "duration_s": 0.01, "root": {"kind": "sum", "terms": [{"kind": "step", "at_s": 0.005}, {"kind": "noise", "amp": 0.01, "seed": 7}]}},
}


def get(spec: dict, pointer: str) -> object:
    """What a pointer such as /root/terms/0/freq_hz names; KeyError if nothing."""
    at: object = spec
    for part in pointer.strip("/").split("/"):
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise KeyError(pointer) from None
    return at


def put(spec: dict, pointer: str, value: object) -> dict:
    """A copy of the spec with another value there; a number stays whole where it was."""
    out = copy.deepcopy(spec)
    above, _, last = pointer.rpartition("/")
    holder, old = get(out, above) if above else out, get(out, pointer)
    whole = isinstance(old, int) and not isinstance(old, bool) and isinstance(value, (int, float))
    holder[int(last) if isinstance(holder, list) else last] = math.floor(value + 0.5) if whole else value
    return out


def ladder(spec: dict, pointer: str, values: list[float]) -> list[tuple[float, dict]]:
    """A spec for each rung of a sweep over one numeric parameter."""
    if isinstance(get(spec, pointer), bool) or not isinstance(get(spec, pointer), (int, float)):
        raise ValueError(f"{pointer}: not a number")
    return [(v, put(spec, pointer, v)) for v in values]


def _inputs(node: dict) -> list[tuple[str, dict]]:
    if node.get("kind") in ("sum", "product"):
        return [(f"/terms/{i}", x) for i, x in enumerate(node.get("terms") or ())]
    if node.get("kind") == "concat":
        return [(f"/parts/{i}/root", x.get("root", {})) for i, x in enumerate(node.get("parts") or ())]
    return [("/input", node["input"])] if isinstance(node.get("input"), dict) else []


def issues(spec: dict) -> list[tuple[str, str, str]]:
    """(severity, pointer, message) of all that is wrong with a spec; only errors keep it from being rendered."""
    out: list[tuple[str, str, str]] = []

    def bad(pointer: str, message: str, severity: str = "error") -> None:
        out.append((severity, pointer, message))

    def positive(x: object) -> bool:
        return isinstance(x, (int, float)) and math.isfinite(x) and x > 0

    for name in ("rate_hz", "duration_s"):
        if not positive(spec.get(name)):
            bad(f"/{name}", "a number above zero is needed")
    if out:
        return out
    nyquist = spec["rate_hz"] / 2

    def walk(node: dict, at: str) -> None:
        kind = node.get("kind")
        if kind not in PARAMS:
            return bad(at, f"no kind {kind}")
        own = PARAMS[kind]
        for name in node.keys() - own.keys() - {"kind"}:
            bad(f"{at}/{name}", "not a parameter")
        for name, default in own.items():
            value = node.get(name, default)
            if value is None or isinstance(default, (int, float)) and not isinstance(value, (int, float)):
                bad(f"{at}/{name}", "missing" if value is None else "not a number")
            elif isinstance(value, (int, float)) and not math.isfinite(value):
                bad(f"{at}/{name}", "not a finite number")
        for name in ("freq_hz", "carrier_hz", "f0_hz", "f1_hz"):
            f = node.get(name)
            if isinstance(f, (int, float)):
                if f < 0:
                    bad(f"{at}/{name}", "negative")
                elif f >= nyquist:
                    bad(f"{at}/{name}", "not below half the sample rate", "error" if kind in TONES else "warning")
        if kind == "square" and not 0 < node.get("duty", 0.5) < 1:
            bad(f"{at}/duty", "between 0 and 1")
        if kind == "pulse" and all(positive(node.get(n)) for n in ("period_s", "width_s")) and node["width_s"] + node.get("fall_s", 0.0) > node["period_s"]:
            bad(f"{at}/width_s", "longer than the period")
        if kind == "chirp" and node.get("law", "linear") not in ("linear", "quadratic", "log"):
            bad(f"{at}/law", "linear, quadratic or log")
        if kind == "chirp" and node.get("law") == "log" and not (positive(node.get("f0_hz")) and positive(node.get("f1_hz"))):
            bad(f"{at}/f0_hz", "a log chirp needs frequencies above zero")
        if kind == "noise" and node.get("colour", "gaussian") not in ("gaussian", "uniform", "pink", "brown"):
            bad(f"{at}/colour", "gaussian, uniform, pink or brown")
        if kind == "prbs" and node.get("order") not in range(2, PRBS_ORDER + 1):
            bad(f"{at}/order", f"2 to {PRBS_ORDER}")
        if kind == "clip" and not node.get("lo", 0) <= node.get("hi", 0):
            bad(f"{at}/lo", "above hi")
        if kind == "delay" and isinstance(node.get("by_s"), (int, float)) and node["by_s"] < 0:
            bad(f"{at}/by_s", "negative")
        if kind == "envelope" and node.get("shape") not in ("adsr", "gaussian", "tukey"):
            bad(f"{at}/shape", "adsr, gaussian or tukey")
        if kind == "am" and isinstance(node.get("depth"), (int, float)) and abs(node["depth"]) > 1:
            bad(f"{at}/depth", "over-modulated", "warning")
        if kind == "fm" and isinstance(node.get("input"), dict) and not _has_integral(node["input"]):
            bad(f"{at}/input", "no closed form of its integral")
        if kind in ("sum", "product", "concat") and not _inputs(node):
            bad(at, "nothing in it", "warning")
        if kind == "expr" and isinstance(node.get("text"), str):
            try:
                expression(node["text"], t=F.lit(0.0))
            except ValueError as e:
                bad(f"{at}/text", str(e))
        for name, child in _inputs(node):
            walk(child, at + name)

    walk(spec.get("root") or {}, "/root")
    return out


def train_issues(groups: int, pulses: int, fields: list[dict], intervals_s: list[float], drift_s: float = 0.0, jitter_s: float = 0.0) -> list[tuple[str, str, str]]:
    """What is wrong with a pulse train: its counts, its intervals and its fields (name, kind, parameters)."""
    out = [("error", f"/{n}", "one at least") for n, v in (("groups", groups), ("pulses", pulses)) if v < 1]
    out += [("error", "/intervals_s", "above zero")] if not intervals_s or min(intervals_s) <= 0 else []
    if not out and min(intervals_s) + drift_s * (groups * pulses - 1) <= 0:
        out.append(("error", "/drift_s", "an interval falls to zero"))
    if intervals_s and jitter_s >= min(intervals_s, default=0) / 2:
        out.append(("warning", "/jitter_s", "pulses may change places"))
    out += [("error", "/fields", "one at least")] if not fields else []
    seen: set[str] = set()
    for i, f in enumerate(fields):
        key = "_".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in f.get("name", "")).split())
        if not key or key in seen:
            out.append(("error", f"/fields/{i}", "a name of its own is needed"))
        seen.add(key)
    return out


def _has_integral(node: dict) -> bool:
    return node.get("kind") in (*TONES, "dc", "ramp", "step") or node.get("kind") in ("sum", "gain", "delay") and all(_has_integral(x) for _, x in _inputs(node))


def integral(node: dict, t: Column) -> Column:
    """The integral of a source from 0 to t, in closed form."""
    p = PARAMS[node["kind"]] | node
    kind = p["kind"]
    if kind == "sum":
        return generate.total([integral(x, t) for x in p["terms"]])
    if kind == "gain":
        return integral(p["input"], t) * p["factor"]
    if kind == "delay":
        return F.when(t < p["by_s"], 0.0).otherwise(integral(p["input"], t - p["by_s"]))
    if kind == "dc":
        return p["level"] * t
    if kind == "ramp":
        return p["slope"] * t * t / 2
    if kind == "step":
        return p["level"] * F.greatest(t - p["at_s"], F.lit(0.0))
    f = p["freq_hz"]
    if f == 0:
        return (p["amp"] * math.sin(p.get("phase_rad", 0.0)) * (kind == "sine") + p["amp"] * (kind == "square") - p["amp"] * (kind == "sawtooth") + p["offset"]) * t
    if kind == "sine":
        return p["amp"] * (math.cos(p["phase_rad"]) - F.cos(2 * math.pi * f * t + p["phase_rad"])) / (2 * math.pi * f) + p["offset"] * t
    cycles = F.floor(f * t)
    r = f * t - cycles
    if kind == "square":
        d = p["duty"]
        part = cycles * (2 * d - 1) + F.when(r < d, r).otherwise(2 * d - r)
    elif kind == "sawtooth":
        part = r * r - r
    else:  # a triangle rises from 0 to 1, falls to -1 and comes back
        part = F.when(r < 0.25, 2 * r * r).when(r < 0.75, 2 * r - 2 * r * r - 0.25).otherwise(2 * (1 - r) * (1 - r))
    return p["amp"] * part / f + p["offset"] * t


def render(node: dict, idx: Column, rate_hz: float, duration_s: float, key: Column, at: str = "") -> Column:
    """The value of a source at a sample; noise is drawn from key and the place in the spec, so equal nodes differ."""
    p, t = PARAMS[node["kind"]] | node, idx / rate_hz
    kind = p["kind"]

    def inner(child: dict, name: str, i: Column = idx, length: float = duration_s) -> Column:
        return render(child, i, rate_hz, length, key, at + name)

    if kind in TONES:
        return p["amp"] * generate.tone(kind, F.lit(float(p["freq_hz"])), t, p.get("phase_rad", 0.0), p.get("duty", 0.5)) + p["offset"]
    if kind == "pulse":
        return p["amp"] * generate.trapezoid(t, p["period_s"], p["rise_s"], p["width_s"] - p["rise_s"], p["fall_s"])
    if kind == "chirp":
        return p["amp"] * generate.chirp(t, F.lit(float(p["f0_hz"])), F.lit(float(p["f1_hz"])), duration_s, p["law"])
    if kind == "dc":
        return F.lit(float(p["level"]))
    if kind == "ramp":
        return p["slope"] * t
    if kind == "step":
        return generate.basic("step", t, F.lit(float(p["level"])), p["at_s"])
    if kind == "impulse":
        return generate.impulse(idx, F.lit(float(p["level"])), p["at_s"], rate_hz)
    if kind == "noise":
        own = F.concat_ws("/", key.cast("string"), F.lit(at))
        if p["colour"] == "uniform":
            return p["amp"] * generate.uniform_noise(own, idx, seed=p["seed"])
        return p["amp"] * (generate.gaussian(own, idx, p["seed"]) if p["colour"] == "gaussian" else generate.coloured(own, idx, p["colour"], seed=p["seed"]))
    if kind == "prbs":
        bits = generate.prbs_block(p["order"], generate.prbs_lags(p["order"]), 0, (1 << p["order"]) - 1)
        return p["amp"] * (F.element_at(F.lit([int(b) for b in bits]), (idx % len(bits) + 1).cast("int")) * 2.0 - 1)
    if kind == "expr":
        return expression(p["text"], t=t)
    if kind in ("sum", "product"):
        return (generate.total if kind == "sum" else generate.product)([inner(x, name) for name, x in _inputs(p)])
    if kind == "concat":
        return generate.concat(idx, rate_hz, [(lambda i, _, x=x, k=k: inner(x["root"], f"/parts/{k}", i, x["duration_s"]), x["duration_s"]) for k, x in enumerate(p["parts"])])
    if kind == "gain":
        return inner(p["input"], "/input") * p["factor"]
    if kind == "delay":
        shift = math.floor(p["by_s"] * rate_hz + 0.5)
        return F.when(idx < shift, 0.0).otherwise(inner(p["input"], "/input", idx - shift))
    if kind == "clip":
        return F.least(F.greatest(inner(p["input"], "/input"), F.lit(float(p["lo"]))), F.lit(float(p["hi"])))
    if kind == "envelope":
        v = inner(p["input"], "/input")
        if p["shape"] != "tukey":
            return v * generate.envelope(t, p["shape"], duration_s, *(p[n] for n in ("attack_s", "decay_s", "sustain", "release_s", "centre_s", "sigma_s")))
        edge, near = min(p["alpha"], 1.0) * duration_s / 2, F.least(t, duration_s - t)
        return v if edge <= 0 else v * F.when(near >= edge, 1.0).otherwise(0.5 * (1 - F.cos(math.pi * F.greatest(near, F.lit(0.0)) / edge)))
    if kind == "am":
        return F.sin(2 * math.pi * p["carrier_hz"] * t) * (1 + p["depth"] * inner(p["input"], "/input"))
    if kind == "pm":
        return F.sin(2 * math.pi * p["carrier_hz"] * t + p["dev_rad"] * inner(p["input"], "/input"))
    return F.sin(2 * math.pi * (p["carrier_hz"] * t + p["dev_hz"] * integral(p["input"], t)))


def make(keys: DataFrame, spec: dict) -> DataFrame:
    """keys (group_id, signal_id) with idx, t_s and value of one source each; a spec with errors raises before any job."""
    if wrong := [f"{at}: {m}" for severity, at, m in issues(spec) if severity == "error"]:
        raise ValueError("; ".join(wrong))
    g = generate.grid(keys, spec["rate_hz"], spec["duration_s"])
    return g.withColumn("value", render(spec["root"], F.col("idx"), spec["rate_hz"], spec["duration_s"], F.col("signal_id")))
