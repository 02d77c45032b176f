"""Confidence in findings: defaults, false positives, what they exclude."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import COMPLEX_RULES

# Which rules a reviewed issue of each kind overlaps.
OVERLAPS: dict[str, list[str]] = {
    "ENVIRONMENT_ASSUMPTION": ["HARDCODED_SECRET", "HARDCODED_URL", "PROTOTYPE_INFRA"],
    "DATA_CONTRACT_RISK": ["HARDCODED_SECRET", "UNVALIDATED_INPUT", "DATA_SHAPE_ASSUMPTION"],
    "RESILIENCE_GAP": ["SILENT_ERROR", "UNSAFE_IO"],
    "OBSERVABILITY_GAP": ["SILENT_ERROR"],
    "SCALING_RISK": ["UNBOUNDED_QUERY", "MEMORY_RISK", "LOOPED_IO"],
    "CONCURRENCY_RISK": ["SHARED_FILE_WRITE", "RETRY_STORM_RISK", "GLOBAL_MUTATION"],
}


def validate(findings: DataFrame, answers: DataFrame, threshold: float = 0.6, cap: int = 30, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """Adds confidence, reasoning and false_positive to findings, and whether they were asked about.

    The first cap findings of each by (in seq order) are matched with answers (by, file, line, kind, confidence, reasoning).
    Without an answer, a finding of a rule that needs context has 0.5 and others 0.7; under the threshold it is taken for
    a false positive. Those after the first cap have 0.7 and are none.
    """
    own = [c for c in findings.columns if c != "reasoning"]
    x = findings.select(*own, _line().alias("_line"), F.lit(True).alias("_found"))
    a = answers.select(*by, "file", "kind", _line().alias("_line"), F.lit(False).alias("_found"), F.col("confidence").alias("_c"), F.col("reasoning").alias("_r"))
    return _judged(x.unionByName(a, allowMissingColumns=True), own, threshold, cap, by)


def validate_answered(findings: DataFrame, confidence: Column, reasoning: Column, threshold: float = 0.6, cap: int = 30, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """validate of findings that are answers as well, where confidence is not null: findings that are dealt by by stay where they are."""
    own = [c for c in findings.columns if c not in ("confidence", "reasoning")]
    x = findings.select(*own, _line().alias("_line"), F.lit(True).alias("_found"), confidence.alias("_c"), reasoning.alias("_r"))
    return _judged(x, own, threshold, cap, by)


def _line() -> Column:
    return F.coalesce(F.col("line").cast("long"), F.lit(0))


def _judged(x: DataFrame, own: list[str], threshold: float, cap: int, by: tuple[str, ...]) -> DataFrame:
    """validate of findings and answers in one table, which is dealt by by once; windows by file, line and kind stay where those are."""
    keys = [*by, "file", "kind"]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_found"), "seq"))
    x = x.withColumn("asked", nth <= cap)
    same = Window.partitionBy(*keys, "_line")
    answered = lambda c: F.when(_known(keys), c.over(same))
    x = x.withColumns({"_c": answered(F.max("_c")), "reasoning": answered(F.max_by("_r", "_c"))}).where("_found").select(*own, "asked", "_c", "reasoning")
    default = F.when(F.col("kind").isin(COMPLEX_RULES), 0.5).otherwise(0.7)
    conf = F.when(F.col("asked"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("_c"), default)))).otherwise(0.7)
    return x.withColumn("confidence", conf).withColumn("false_positive", F.col("asked") & (F.col("confidence") < threshold)).drop("_c")


def _known(keys: list[str]) -> Column:
    """Whether no key is null: such a one equals no other."""
    return functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def real(by: tuple[str, ...] = ("pr_id",)) -> Column:
    """Whether a validated finding is one of without_false_positives, as a window that lies where findings are dealt by by."""
    keys = [*by, "file", "kind"]
    first = F.min_by("false_positive", "seq").over(Window.partitionBy(*keys, F.coalesce("line", F.lit(0))))
    return ~F.coalesce(_known(keys) & first, F.lit(False))


def without_false_positives(findings: DataFrame, validated: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """Findings whose first validated row of the same file, line and kind is no false positive."""
    line = F.coalesce("line", F.lit(0))
    first = validated.groupBy(*by, "file", line.alias("_line"), "kind").agg(F.min_by("false_positive", "seq").alias("_fp")).where("_fp").drop("_fp")
    return findings.withColumn("_line", line).join(first, [*by, "file", "_line", "kind"], "left_anti").select(*findings.columns)


def drop_overlapping(issues: DataFrame, validated: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """Reviewed issues of which the file has no false positive of a rule that the issue's kind overlaps; issues without a file stay."""
    pairs = issues.sparkSession.createDataFrame([(k, r) for k, rs in OVERLAPS.items() for r in rs], "kind string, rule string")
    hidden = validated.where("false_positive").select(*by, "file", F.col("kind").alias("rule")).join(F.broadcast(pairs), "rule").select(*by, "file", "kind").distinct()
    return issues.join(hidden, [*by, "file", "kind"], "left_anti").select(*issues.columns)
