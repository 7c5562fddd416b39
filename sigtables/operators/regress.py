"""Comparing runs: assertions, tolerant differences, coverage and pruning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.functions.scalars import finite


def difference(a: Column, b: Column) -> Column:
    """How far a pair is apart: 0 for equal values and two NaNs, infinite where one side is missing or NaN."""
    missing = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    return F.when((a == b) | (F.isnan(a) & F.isnan(b)), 0.0).when(missing, float("inf")).otherwise(F.abs(a - b))


#: Neighbouring indexes of a signal that are compared in one task.
BLOCK = 1 << 16


def diff_samples(base: DataFrame, candidate: DataFrame, abs_tol: float, rel_tol: float, by: Sequence[str] = ("group_id", "signal_id")) -> DataFrame:
    """Per signal: samples, max_abs, rms_error, first_beyond and within. The bound is the larger of abs_tol and rel_tol times the rms of the base's finite values.

    A sample on one side only, or NaN on one side only, is infinitely off; NaN on both sides agrees. A base without finite
    values has the bound abs_tol. Of an index that a side has more than once each sample is compared with each of the other
    side. Both sides are shuffled by blocks of indexes, so what leaves a task is a row for each block at most; with rel_tol the
    differences meet their signals' bounds by another shuffle before.
    """
    on = [*by, "_block"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.shiftright("idx", BLOCK.bit_length() - 1).alias("_block"), "idx", F.col("value").cast("double").alias("v"), F.lit(name).alias("_side"))

    rows = side(base, "b").unionByName(side(candidate, "c"))
    b, c = (F.when(F.col("_side") == n, F.col("v")) for n in ("b", "c"))
    of = lambda x, n: [F.count_if(F.col("_side") == n).alias(f"{n}_rows"), F.min(x).alias(f"{n}_min"), F.max(x).alias(f"{n}_max"), F.avg(x).alias(f"{n}_mean"), F.var_pop(x).alias(f"{n}_var")]
    d = rows.repartition(*on).groupBy(*on, "idx").agg(*of(b, "b"), *of(c, "c"), F.count_if(F.col("v").isNull()).alias("_nulls"))
    alone = F.col("idx").isNull() | (F.col("b_rows") == 0) | (F.col("c_rows") == 0)
    apart = F.greatest(difference(F.col("b_max"), F.col("c_min")), difference(F.col("c_max"), F.col("b_min")))
    e = F.when(alone, float("inf")).when(F.col("_nulls") == F.col("b_rows") + F.col("c_rows"), 0.0).when(F.col("_nulls") > 0, float("inf")).otherwise(apart)
    d = d.withColumns({"e": e, "_pairs": F.when(alone, F.col("b_rows") + F.col("c_rows")).otherwise(F.col("b_rows") * F.col("c_rows"))})
    mean_square = F.col("b_var") + F.col("c_var") + F.pow(F.col("b_mean") - F.col("c_mean"), F.lit(2.0))
    square = F.when((F.col("_pairs") == 1) | F.col("e").isin(0.0, float("inf")), F.col("e") * F.col("e")).otherwise(mean_square) * F.col("_pairs")
    bound = F.lit(float(abs_tol))
    if rel_tol:
        v = F.when((F.col("_side") == "b") & finite(F.col("v")), F.col("v"))
        of_blocks = rows.groupBy(*on).agg(F.sum(v * v).alias("_s"), F.count(v).alias("_n"))
        whole = W.partitionBy(*by)
        rms = F.sqrt(F.sum("_s").over(whole) / F.nullif(F.sum("_n").over(whole), F.lit(0)))
        bounds = of_blocks.select(*(F.col(x).alias(f"_{i}") for i, x in enumerate(on)), F.greatest(bound, F.coalesce(rms * rel_tol, F.lit(0.0))).alias("bound"))
        d = d.join(bounds, [F.col(x).eqNullSafe(F.col(f"_{i}")) for i, x in enumerate(on)])
        bound = F.col("bound")
    out = d.groupBy(*by).agg(F.sum("_pairs").alias("samples"), F.max("e").alias("max_abs"), F.sqrt(F.sum(square) / F.sum("_pairs")).alias("rms_error"), F.min(F.when(F.col("e") > bound, F.col("idx"))).alias("first_beyond"))
    return out.withColumn("within", F.col("first_beyond").isNull())


def diff_summaries(base: DataFrame, candidate: DataFrame, abs_tol: float, rel_tol: float, by: Sequence[str] = ("group_id", "signal_id")) -> DataFrame:
    """Per signal whose samples weren't kept: max_abs, the widest of the differences of min, max, mean and rms, and within.

    Recorded rows have by, samples, min, max, mean and rms. A summary that one side lacks is infinitely off, one that both lack
    agrees; other counts of samples deviate.
    """
    cells = ("min", "max", "mean", "rms")
    a, b = (df.select(*by, F.struct("samples", *cells).alias(n)) for df, n in ((base, "a"), (candidate, "b")))
    d = a.join(b, list(by), "full")
    both = [F.when(F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull() & F.col("a").isNotNull() & F.col("b").isNotNull(), 0.0).otherwise(difference(F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in cells]
    bound = F.greatest(F.lit(abs_tol), F.coalesce(F.col("a.rms") * rel_tol, F.lit(0.0)))
    d = d.withColumn("max_abs", F.greatest(*both))
    return d.select(*by, "max_abs", ((F.col("max_abs") <= bound) & F.col("a.samples").eqNullSafe(F.col("b.samples"))).alias("within"))


def diff_metrics(base: DataFrame, candidate: DataFrame, abs_tol: float, rel_tol: float) -> DataFrame:
    """group_id, metric, difference and within, by stage_ordinal too if both sides have it; one-sided metrics are infinitely off.

    NaN is within no bound, on whichever side it is. The bound is the larger of abs_tol and rel_tol times the base's value.
    """
    on = ["group_id", *(["stage_ordinal"] if "stage_ordinal" in base.columns and "stage_ordinal" in candidate.columns else []), "metric"]
    d = base.select(*on, F.col("value").alias("b")).join(candidate.select(*on, F.col("value").alias("c")), on, "full")
    d = d.withColumn("difference", F.when(F.col("b").isNull() | F.col("c").isNull(), float("inf")).when(F.col("b") == F.col("c"), F.when(F.isnan("b"), float("nan")).otherwise(0.0)).otherwise(F.abs(F.col("b") - F.col("c"))))
    bound = F.greatest(F.lit(abs_tol), F.coalesce(F.abs("b"), F.lit(0.0)) * rel_tol)
    return d.select(*on, "difference", (~F.isnan("difference") & ~F.isnan(bound) & (F.col("difference") <= bound)).alias("within"))


def diff_status(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """group_id, base_status and status of groups (group_id, status) that both runs have and whose status changed."""
    both = base.select("group_id", F.col("status").alias("base_status")).join(candidate.select("group_id", "status"), "group_id")
    return both.where(~F.col("base_status").eqNullSafe(F.col("status")))


def diff_groups(base: DataFrame, candidate: DataFrame, allow_new: bool = False) -> DataFrame:
    """group_id and side of groups that only one run has; those of the candidate alone may be allowed."""
    b, c = base.select("group_id").distinct(), candidate.select("group_id").distinct()
    gone = b.join(c, "group_id", "left_anti").withColumn("side", F.lit("baseline"))
    return gone if allow_new else gone.unionByName(c.join(b, "group_id", "left_anti").withColumn("side", F.lit("candidate")))


@dataclass(frozen=True)
class Assertion:
    """subject op operand, or subject within amount (% of it, if relative) of operand; operand: a number, a word or `baseline`."""

    subject: str
    op: str
    operand: float | str
    amount: float | None = None
    relative: bool = False


LINE = re.compile(r"\s*(?P<subject>\S+)\s*(?:(?P<op>==|!=|<=|>=|<|>|=(?!=))|\swithin\s+(?P<amount>[\d.eE+-]+)\s*(?P<percent>%?)\s+of\s)\s*(?P<operand>\S+)\s*$")


def assertion(text: str) -> Assertion:
    m = LINE.match(text)
    if not m:
        raise ValueError(f"{text!r}: not an assertion")
    try:
        operand: float | str = float(m["operand"])
    except ValueError:
        operand = m["operand"]
    if m["amount"]:
        return Assertion(m["subject"], "within", operand, float(m["amount"]), bool(m["percent"]))
    return Assertion(m["subject"], "==" if m["op"] == "=" else m["op"], operand)


def facts(groups: DataFrame, metrics: DataFrame | None = None, signals: DataFrame | None = None, artifacts: dict[tuple[int, str], DataFrame] | None = None, fields: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """group_id, subject, num and txt of all that an assertion may ask for of a run's records.

    <metric> (of the latest stage that has it), stage[n].metrics.<metric>, status, stage[n].status, signals[name].min, max, mean,
    rms, peak_to_peak and samples (after the last stage), <port>.count and <port>.<field>.min, max, mean and sum of the
    latest stage that gives the port.
    """
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("double")
    parts = [groups.select("group_id", F.lit("status").alias("subject"), none.alias("num"), F.col("status").alias("txt"))]
    if metrics is not None:
        value = F.col("value").cast("double")
        latest = metrics.groupBy("group_id", F.col("name").alias("subject")).agg(F.max_by(value, "stage_ordinal").alias("num"))
        parts.append(latest.withColumn("txt", text))
        parts.append(metrics.select("group_id", F.format_string("stage[%d].metrics.%s", "stage_ordinal", "name").alias("subject"), value.alias("num"), text.alias("txt")))
    if signals is not None:
        stages_ = signals.where("stage_ordinal >= 0").select("group_id", "stage_ordinal").distinct()
        parts.append(stages_.select("group_id", F.format_string("stage[%d].status", "stage_ordinal").alias("subject"), none.alias("num"), F.lit("ok").alias("txt")))
        last = F.max("stage_ordinal").over(W.partitionBy("group_id"))
        final = signals.withColumn("_last", last).where("stage_ordinal = _last AND disposition != 'dropped'")
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ("min", "max", "mean", "rms", "peak_to_peak", "samples")])
        final = final.select("group_id", "name", F.explode(cells).alias("p"))
        parts.append(final.select("group_id", F.format_string("signals[%s].%s", "name", "p.c").alias("subject"), F.col("p.v").alias("num"), text.alias("txt")))
    latest_port = {port: max(s for s, p in (artifacts or {}) if p == port) for _, port in artifacts or {}}
    for port, stage in latest_port.items():
        rows = artifacts[stage, port]
        aggregates = [(f"{port}.count", F.count("*").cast("double"))]
        for f in (fields or {}).get(port, ()):
            v = F.col(f).cast("double")
            aggregates += [(f"{port}.{f}.{n}", g(v)) for n, g in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum))]
        wide = rows.groupBy("group_id").agg(*[g.alias(f"a{i}") for i, (_, g) in enumerate(aggregates)])
        wide = groups.select("group_id").join(wide, "group_id", "left").fillna({"a0": 0.0})
        cells = F.array(*[F.struct(F.lit(n).alias("subject"), F.col(f"a{i}").alias("num")) for i, (n, _) in enumerate(aggregates)])
        parts.append(wide.select("group_id", F.explode(cells).alias("p")).select("group_id", "p.*").where("num IS NOT NULL").withColumn("txt", text))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(groups: DataFrame, known: DataFrame, assertions: Sequence[str | Assertion], baseline: DataFrame | None = None) -> DataFrame:
    """group_id, ordinal, subject, status, actual and expected of every assertion for every group; all are one join with the facts.

    status: pass, fail, not_applicable (the group has no such subject, or there is no baseline: no failure) or error (the
    baseline lacks it, or the test needs numbers; counts as a failure). Texts are only equal or not.
    """
    given = [assertion(a) if isinstance(a, str) else a for a in assertions]
    if unknown := {a.op for a in given} - {"==", "!=", "<", "<=", ">", ">=", "within"}:
        raise ValueError(f"no test {sorted(unknown)}")

    def row(i: int, a: Assertion) -> Column:
        number = isinstance(a.operand, (int, float))
        return F.struct(F.lit(i).alias("ordinal"), F.lit(a.subject).alias("subject"), F.lit(a.op).alias("op"), F.lit(float(a.operand) if number else None).cast("double").alias("x"), F.lit(None if number else a.operand).cast("string").alias("word"), F.lit(a.amount).cast("double").alias("amount"), F.lit(a.relative).alias("relative"))

    if not given:
        return groups.select("group_id", F.lit(0).alias("ordinal"), F.lit("").alias("subject"), F.lit("").alias("status"), F.lit(0.0).alias("actual"), F.lit(0.0).alias("expected")).where("false")
    d = groups.select("group_id", F.explode(F.array(*[row(i, a) for i, a in enumerate(given)])).alias("a")).select("group_id", "a.*")
    own = known.where(F.col("subject").isin(sorted({a.subject for a in given})))
    d = d.join(own, ["group_id", "subject"], "left")
    of_base = F.coalesce(F.col("word") == "baseline", F.lit(False))
    if baseline is not None:
        d = d.join(baseline.select("group_id", "subject", F.col("num").alias("_bn"), F.col("txt").alias("_bt")), ["group_id", "subject"], "left")
    else:
        d = d.withColumns({"_bn": F.lit(None).cast("double"), "_bt": F.lit(None).cast("string")})
    x, word = F.when(of_base, F.col("_bn")).otherwise(F.col("x")), F.when(of_base, F.col("_bt")).otherwise(F.col("word"))
    v, op = F.col("num"), F.col("op")
    both = v.isNotNull() & x.isNotNull()
    near = F.abs(v - x) <= F.when(F.col("relative"), F.col("amount") / 100 * F.abs(x)).otherwise(F.col("amount"))
    compared = F.when(op == "<", v < x).when(op == "<=", v <= x).when(op == ">", v > x).when(op == ">=", v >= x).when(op == "==", v == x).when(op == "!=", v != x).otherwise(near)
    nan = F.isnan(v) | F.isnan(x)
    # NaN compares with nothing: only != holds
    by_number = F.when(nan, op == "!=").otherwise(compared)
    left, right = F.coalesce("txt", v.cast("string")), F.coalesce(word, x.cast("string"))
    verdict = F.when(v.isNull() & F.col("txt").isNull(), "not_applicable").when(of_base & F.lit(baseline is None), "not_applicable").when(of_base & x.isNull() & word.isNull(), "error")
    verdict = verdict.when(both, F.when(by_number, "pass").otherwise("fail")).when(op == "==", F.when(left == right, "pass").otherwise("fail")).when(op == "!=", F.when(left != right, "pass").otherwise("fail")).otherwise("error")
    return d.select("group_id", "ordinal", "subject", verdict.alias("status"), v.alias("actual"), x.alias("expected"))


def failed_assertions(checked: DataFrame) -> DataFrame:
    """ordinal, failures (fail or error) and groups of each assertion, those with failures first, then by ordinal."""
    bad = F.col("status").isin("fail", "error")
    out = checked.groupBy("ordinal").agg(F.count_if(bad).alias("failures"), F.count("*").alias("groups"))
    return out.orderBy(F.col("failures") == 0, "ordinal")


def promote(baselines: DataFrame, name: str, run_id: str, abs_tol: float, rel_tol: float) -> DataFrame:
    """baselines (name, run_id, abs_tol, rel_tol) in which `name` means this run from now on."""
    new = baselines.sparkSession.createDataFrame([(name, run_id, float(abs_tol), float(rel_tol))], "name string, run_id string, abs_tol double, rel_tol double")
    return baselines.where(F.col("name") != name).unionByName(new.select(baselines.columns))


def check_baseline(baselines: DataFrame, name: str, run_id: str, metrics: DataFrame) -> DataFrame:
    """group_id, verdict and reasons of a run against the run that a name means; metrics: run_id, group_id, metric, value.

    A run isn't checked against itself, nor against a name that means none.
    """
    row = baselines.where(F.col("name") == name).first()
    if row is None or row.run_id == run_id:
        raise ValueError(f"{name}: no such baseline" if row is None else f"{name}: is this run itself")
    of = lambda r: metrics.where(F.col("run_id") == r).drop("run_id")
    return verdicts(diff_metrics(of(row.run_id), of(run_id), row.abs_tol, row.rel_tol), diff_groups(of(row.run_id), of(run_id)))


def prune(runs: DataFrame, keep: int) -> DataFrame:
    """Runs (run_id, pipeline, exempt) to delete: finished ones beyond the newest `keep` of a pipeline; exempt ones stay uncounted."""
    at = F.row_number().over(W.partitionBy("pipeline").orderBy(F.desc("run_id")))
    return runs.where(~F.col("exempt")).withColumn("_n", at).where(F.col("_n") > keep).drop("_n")


def residual(a: DataFrame, b: DataFrame) -> DataFrame:
    """a less b per sample on the same timebase, as max_abs and first_t of each signal; NaN against a number is infinitely off."""
    on = ["group_id", "signal_id", "idx"]
    d = a.join(b.select(*on, F.col("value").alias("_b")), on).withColumn("d", difference(F.col("value"), F.col("_b")))
    return d.groupBy(*on[:2]).agg(F.max("d").alias("max_abs"), F.min(F.when(F.col("d") > 0, F.col("t_s"))).alias("first_t"))


def residual_nearest(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by, pairs, max_abs and first_t of a less b, each sample of a with that of b nearest in time.

    A pair counts if its times are within half the wider spacing of the two signals; of two equally near the earlier one
    counts. Both are read once, in one order of time; times may be irregular.
    """
    spacing = lambda df, n: df.groupBy(*by).agg(F.when(F.count("*") > 1, (F.max("t_s") - F.min("t_s")) / (F.count("*") - 1)).alias(n))
    d = a.select(*by, "t_s", F.col("value").alias("_a"), F.lit(None).cast("struct<t:double,v:double>").alias("_b"))
    d = d.unionByName(b.select(*by, "t_s", F.lit(None).cast("double").alias("_a"), F.struct(F.col("t_s").cast("double").alias("t"), F.col("value").cast("double").alias("v")).alias("_b")))
    w = W.partitionBy(*by).orderBy("t_s")
    d = d.withColumns({"_p": F.last("_b", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)), "_n": F.first("_b", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))}).where("_b IS NULL")
    before, after = F.col("t_s") - F.col("_p.t"), F.col("_n.t") - F.col("t_s")
    near = F.when(before.isNull() | (after < before), F.col("_n")).otherwise(F.col("_p"))
    d = d.select(*by, "t_s", "_a", near.alias("_b")).join(spacing(a, "_sa"), list(by)).join(spacing(b, "_sb"), list(by))
    reach = F.greatest("_sa", "_sb") / 2 + 1e-12
    d = d.where(F.abs(F.col("_b.t") - F.col("t_s")) <= reach).withColumn("d", difference(F.col("_a"), F.col("_b.v")))
    return d.groupBy(*by).agg(F.count("*").alias("pairs"), F.max("d").alias("max_abs"), F.min(F.when(F.col("d") > 0, F.col("t_s"))).alias("first_t"))


def residual_envelope(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """low and high bounds of a less b for each pixel column of two viewports; null where one side has no column."""
    on = [*by, "px"]
    d = a.join(b.select(*on, F.col("low").alias("_l"), F.col("high").alias("_h")), on, "full")
    low, high = F.col("low") - F.col("_l"), F.col("high") - F.col("_h")
    both = low.isNotNull() & high.isNotNull()
    return d.select(*on, F.when(both, F.least(low, high)).alias("low"), F.when(both, F.greatest(low, high)).alias("high"))


def row_at(spans: DataFrame, t: float, *by: str) -> DataFrame:
    """Of each key the span (start_s, end_s) that holds t, else the latest that starts by t; keys without one have no row."""
    d = spans.where(F.col("start_s") <= t)
    rest = [c for c in spans.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct((F.col("end_s") >= t).alias("holds"), "start_s"))
    return d.groupBy(*by).agg(best.alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def judged(everyone: DataFrame, reasons: DataFrame) -> DataFrame:
    """group_id, verdict and reasons (joined by commas, in order) of all groups, from group_id and reason (null: none)."""
    d = everyone.select("group_id", F.lit(None).cast("string").alias("reason")).unionByName(reasons.select("group_id", "reason"))
    out = d.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return out.withColumn("verdict", F.when(F.col("reasons") == "", "matches").otherwise("deviates"))


def verdicts(diffs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """group_id, verdict and reasons from diff_metrics: deviates if any metric isn't within its bound.

    groups, as diff_groups() gives them, deviate too: their reason is `only in <side>`.
    """
    d = diffs.select("group_id", F.when(~F.col("within"), F.col("metric")).alias("reason"))
    if groups is not None:
        d = d.unionByName(groups.select("group_id", F.concat(F.lit("only in "), "side").alias("reason")))
    return judged(d, d)


def payload_schema(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """id, field and kind of each top-level key of a JSON payload, by its first entry that isn't null.

    bool, text, int, float, span (an array of two numbers), array (any other array) or json; without such an entry float. A value that isn't an array counts
    as its only entry.
    """
    tvf = rows.sparkSession.tvf
    d = rows.select(F.col(id_column).alias("id"), F.try_parse_json(F.col(json_column)).alias("_j")).where(F.schema_of_variant("_j").startswith("OBJECT"))
    d = d.lateralJoin(tvf.variant_explode(F.col("_j").outer())).select("id", F.col("key").alias("field"), "value")
    d = d.withColumn("_array", F.schema_of_variant("value").startswith("ARRAY"))
    entries = d.lateralJoin(tvf.variant_explode_outer(F.when(F.col("_array"), F.col("value")).outer()).select("pos", F.col("value").alias("_v")))
    entries = entries.select("id", "field", F.coalesce("pos", F.lit(0)).alias("pos"), F.when(F.col("_array"), F.col("_v")).otherwise(F.col("value")).alias("entry")).withColumn("_e", F.schema_of_variant("entry"))
    pair = F.col("_e").startswith("ARRAY") & F.try_variant_get("entry", "$[1]", "double").isNotNull() & F.try_variant_get("entry", "$[0]", "double").isNotNull() & F.try_variant_get("entry", "$[2]", "string").isNull()
    kind = F.when(F.col("_e") == "BOOLEAN", "bool").when(F.col("_e") == "STRING", "text").when(F.col("_e") == "BIGINT", "int").when(F.col("_e").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").when(pair, "span").when(F.col("_e").startswith("ARRAY"), "array").otherwise("json")
    told = F.coalesce(F.col("_e") != "VOID", F.lit(False))
    found = entries.groupBy("id", "field").agg(F.min_by(kind, F.when(told, F.col("pos"))).alias("kind"), F.count_if(F.col("pos") == 0).cast("int").alias("_rows"))
    return found.select("id", "field", F.coalesce("kind", F.lit("float")).alias("kind"), F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_row")).drop("_row")


def nearest_artifact(published: DataFrame, value: str, order: Sequence[str], *by: str) -> DataFrame:
    """by and latest: what the latest stage that published a kind gave."""
    return published.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("latest"))


def retained(outputs: DataFrame) -> DataFrame:
    """outputs (group_id, policy, failed) whose samples stay: policy always, or on_failure in a group where anything failed."""
    bad = outputs.where("failed").select("group_id").distinct().withColumn("_bad", F.lit(True))
    d = outputs.join(bad, "group_id", "left")
    return d.where((F.col("policy") == "always") | ((F.col("policy") == "on_failure") & F.col("_bad"))).drop("_bad")


def diff_artifacts(base: DataFrame, candidate: DataFrame, fields: list[str], abs_tol: float, *by: str) -> DataFrame:
    """Per key and field: rows that differ (numbers beyond abs_tol, texts at all) or stand on one side only, and the first such row.

    Both tables have `row`, a number of each key's rows; null on both sides agrees.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        texts = {c for c, t in df.dtypes if t == "string"}
        numbers = [(F.lit(None) if f in texts else F.col(f)).cast("double").alias(f"{name}{i}") for i, f in enumerate(fields)]
        return df.select(*by, "row", F.lit(True).alias(f"in_{name}"), *numbers, *((F.col(f) if f in texts else F.lit(None)).cast("string").alias(f"{name}{i}_text") for i, f in enumerate(fields)))

    d = cells(base, "a").join(cells(candidate, "b"), [*by, "row"], "full")

    def off(i: int) -> Column:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col(f"a{i}_text").eqNullSafe(F.col(f"b{i}_text")) & (a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= abs_tol, F.lit(False)))
        return ~same

    wide = d.groupBy(*by).agg(*(x for i in range(len(fields)) for x in (F.count_if(off(i)).alias(f"n{i}"), F.min(F.when(off(i), F.col("row"))).alias(f"first{i}"))))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("mismatches"), F.col(f"first{i}").alias("first_row")) for i, f in enumerate(fields)))
    return wide.select(*by, F.explode(each).alias("x")).select(*by, "x.*")
