"""Comparing recorded runs: signals, metrics, artifacts, status and coverage, and the verdict of a run against a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.operators import regress

SIGNAL = ["group_id", "stage_ordinal", "signal_id"]


@dataclass(frozen=True)
class Comparison:
    """Differences of two runs' records under one path.

    signals: group_id, stage_ordinal, signal_id, name, max_abs, within and by (samples or summary); metrics: group_id,
    stage_ordinal, metric, difference, within; artifacts: group_id, stage_ordinal, port, field, mismatches; status: groups whose
    status changed; groups: groups that one run has alone; everyone: group_id of all.
    """

    signals: DataFrame
    metrics: DataFrame | None
    artifacts: DataFrame | None
    status: DataFrame
    groups: DataFrame
    everyone: DataFrame

    def verdicts(self) -> DataFrame:
        """group_id, verdict and reasons: matches, or deviates with all that isn't within its bound.

        Reasons: signal <name> at <stage>, metric <name> at <stage>, artifact <port> at <stage>, status, only in <side>. Of a
        group that only one run has nothing else is said.
        """

        def said(df: DataFrame | None, kind: str, name: str, where: str) -> DataFrame | None:
            if df is None:
                return None
            return df.where(where).select("group_id", F.concat(F.lit(f"{kind} "), F.col(name), F.lit(" at "), F.col("stage_ordinal").cast("string")).alias("reason"))

        parts = [said(self.signals, "signal", "name", "NOT within"), said(self.metrics, "metric", "metric", "NOT within"), said(self.artifacts, "artifact", "port", "mismatches > 0")]
        parts = [p.join(self.groups.select("group_id"), "group_id", "left_anti") for p in parts if p is not None]
        parts += [self.status.select("group_id", F.lit("status").alias("reason")), self.groups.select("group_id", F.concat(F.lit("only in "), "side").alias("reason"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return regress.judged(self.everyone, out)


def compare_runs(spark: SparkSession, path: str, base: str, candidate: str, abs_tol: float, rel_tol: float = 0.0, artifact_abs: float | None = None, last_stage_only: bool = False) -> Comparison:
    """Compares what two runs have recorded under path (see pipeline.write_run).

    Signals are compared sample by sample at stages whose samples both runs kept, else by their recorded summaries. Rows of an
    artifact are compared field by field in the order of all their fields; another schema differs in every row.
    """

    def read(name: str, run: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/run_{name}").where(F.col("run_id").cast("string") == run).drop("run_id")
        except AnalysisException:  # no run has written it
            return None

    a, b = ({n: read(n, run) for n in ("groups", "signals", "metrics", "artifacts", "samples", "states")} for run in (base, candidate))
    if last_stage_only:
        last = a["signals"].agg(F.max("stage_ordinal").alias("stage_ordinal"))  # one row
        cut = lambda df: df if df is None or "stage_ordinal" not in df.columns else df.join(F.broadcast(last), "stage_ordinal", "left_semi")
        a, b = ({n: cut(df) for n, df in x.items()} for x in (a, b))
    live = lambda x: x["signals"].where("disposition != 'dropped'")
    names = live(a).select(*SIGNAL, "name").unionByName(live(b).select(*SIGNAL, "name")).groupBy(*SIGNAL).agg(F.min("name").alias("name"))
    summed = lambda x, rest: live(x).join(rest, SIGNAL, "left_anti") if rest is not None else live(x)
    both = a["states"].select(*SIGNAL).join(b["states"].select(*SIGNAL), SIGNAL, "left_semi") if a["states"] is not None else None
    signals = regress.diff_summaries(summed(a, both), summed(b, both), abs_tol, rel_tol, SIGNAL).withColumn("by", F.lit("summary"))
    if both is not None:
        at = a["states"].select("stage_ordinal").distinct().join(b["states"].select("stage_ordinal"), "stage_ordinal", "left_semi")
        own = [x["samples"].join(F.broadcast(at), "stage_ordinal", "left_semi") for x in (a, b)]  # a few stages; signals are told apart when each is a row
        by_samples = regress.diff_samples(*own, abs_tol, rel_tol, SIGNAL).select(*SIGNAL, "max_abs", "within", F.lit("samples").alias("by")).join(both, SIGNAL, "left_semi")
        empty = both.join(by_samples, SIGNAL, "left_anti").select(*SIGNAL, F.lit(0.0).alias("max_abs"), F.lit(True).alias("within"), F.lit("samples").alias("by"))
        signals = signals.unionByName(by_samples).unionByName(empty)
    metrics = None
    if a["metrics"] is not None:
        metrics = regress.diff_metrics(*(x["metrics"].withColumnRenamed("name", "metric") for x in (a, b)), abs_tol, rel_tol)
    groups = regress.diff_groups(a["groups"], b["groups"])
    everyone = a["groups"].select("group_id").unionByName(b["groups"].select("group_id")).distinct()
    return Comparison(signals.join(names, SIGNAL), metrics, _artifacts(a["artifacts"], b["artifacts"], abs_tol if artifact_abs is None else artifact_abs), regress.diff_status(a["groups"], b["groups"]), groups, everyone)


def _artifacts(base: DataFrame | None, candidate: DataFrame | None, abs_tol: float) -> DataFrame | None:
    if base is None or candidate is None:
        return None
    by, parts = ["group_id", "stage_ordinal"], []
    kinds = base.select("port", "schema").unionByName(candidate.select("port", "schema")).distinct().collect()  # a few
    for port, kind in kinds:
        fields = [f.name for f in T.StructType.fromDDL(kind.removeprefix("struct<").removesuffix(">"))] if kind.startswith("struct<") else []

        def rows(df: DataFrame, port: str = port, kind: str = kind, fields: list[str] = fields) -> DataFrame:
            d = df.where((F.col("port") == port) & (F.col("schema") == kind)).select(*by, F.from_json("payload", kind, {"allowNonNumericNumbers": "true"}).alias("p")).select(*by, "p.*")
            return d.withColumn("row", F.row_number().over(W.partitionBy(*by).orderBy(*fields)))

        flat = [f for f in fields if not isinstance(rows(base).schema[f].dataType, (T.ArrayType, T.StructType, T.MapType))]
        parts.append(regress.diff_artifacts(rows(base), rows(candidate), flat, abs_tol, *by).withColumn("port", F.lit(port)))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def check_baseline(spark: SparkSession, path: str, baselines: DataFrame, name: str, run_id: str) -> Comparison:
    """The comparison of a run with the one that a name means, within that name's tolerances (see regress.promote)."""
    row = baselines.where(F.col("name") == name).first()
    if row is None or row.run_id == run_id:
        raise ValueError(f"{name}: no such baseline" if row is None else f"{name}: is this run itself")
    return compare_runs(spark, path, row.run_id, run_id, row.abs_tol, row.rel_tol)
