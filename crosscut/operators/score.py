"""Scores of change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import LABELS, penalty


def score_label(score: Column) -> Column:
    out = None
    for least, name in LABELS[:-1]:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(LABELS[-1][1])


def scores(findings: DataFrame, multiplier: str = "1.0", high_risk_below: int = 60, by: tuple[str, ...] = ("pr_id",), counts: bool = False) -> DataFrame:
    """by, penalty, score, label and high_risk: 100 less the weighted points of all findings, rounded half up, within 0 and 100.

    Points are exact decimals. Sums combine before the shuffle; by pairs without findings have no row. With counts, severity_counts' columns
    follow, of the same pass over the findings.
    """
    x = findings.groupBy(*by).agg(F.sum(cost(multiplier)).alias("penalty"), *(_counts() if counts else []))
    return scored(x, high_risk_below).select(*by, "penalty", "score", "label", "high_risk", *(["total", *COUNTED] if counts else []))


def cost(multiplier: str = "1.0") -> Column:
    """The points of a finding."""
    return (penalty(F.col("kind"), F.col("severity"), F.col("level")) * F.lit(multiplier).cast("decimal(8,4)")).cast("decimal(18,4)")


def scored(x: DataFrame, high_risk_below: int = 60) -> DataFrame:
    """Adds score, label and high_risk to rows with a penalty."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.lit(100) - F.col("penalty"), 0).cast("int")))
    return x.withColumn("score", s).withColumns({"label": score_label(F.col("score")), "high_risk": F.col("score") < high_risk_below})


COUNTED = ("high", "medium", "low")


def _counts() -> list[Column]:
    return counts_of(F.lit(True))


def counts_of(some: Column) -> list[Column]:
    """How many findings of some there are, in all and by severity."""
    return [F.count_if(some).alias("total"), *[F.count_if(some & (F.col("severity") == s)).alias(s) for s in COUNTED]]


def severity_counts(findings: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    return findings.groupBy(*by).agg(*_counts())
