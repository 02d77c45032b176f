"""Grouping, ranking and capping findings for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DESCRIPTIONS, SEVERITY_ORDER, category, lookup, severity_order


def _named(order: Column) -> Column:
    return F.when(order == 3, "high").when(order == 2, "medium").when(order == 1, "low")


def describe(kind: Column, message: Column) -> Column:
    """The rule's short name, else the finding's message, else its kind; an empty text counts as none."""
    return F.coalesce(lookup(DESCRIPTIONS, kind), F.nullif(message, F.lit("")), kind)


def by_kind(findings: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, kind, count, severity (the highest), description (the first), locations in order, and rank.

    Groups rank by severity, then count, then first appearance.
    """
    x = findings.groupBy(*by, "kind").agg(
        F.count("*").alias("count"),
        F.max(severity_order(F.col("severity"))).alias("_sev"),
        F.min_by("message", "seq").alias("_message"),
        F.min("seq").alias("first_seq"),
        F.sort_array(F.collect_list(F.struct("seq", "file", "line"))).alias("_at"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("_sev"), F.desc("count"), "first_seq")
    return x.select(*by, "kind", "count", _named(F.col("_sev")).alias("severity"), describe(F.col("kind"), F.col("_message")).alias("description"), F.transform("_at", lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"))).alias("locations"), F.row_number().over(order).alias("rank"))


def validated_by_kind(validated: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, kind, count, severity, avg_confidence, filtered_count, top_locations (3 by confidence) and rank.

    Counts and means are of findings that are no false positives; groups of false positives only are dropped. The
    severity is the highest of those and of the group's first row, whatever that is.
    """
    real = ~F.col("false_positive")
    x = validated.groupBy(*by, "kind").agg(
        F.count_if(real).alias("count"),
        F.avg(F.when(real, F.col("confidence"))).alias("avg_confidence"),
        F.count_if(~real).alias("filtered_count"),
        F.greatest(F.max(F.when(real, severity_order(F.col("severity")))), F.min_by(severity_order(F.col("severity")), "seq")).alias("_sev"),
        F.min("seq").alias("_first"),
        F.sort_array(F.collect_list(F.when(real, F.struct((-F.col("confidence")).alias("c"), "seq", "file", "line")))).alias("_at"),
    ).where("count > 0")
    order = Window.partitionBy(*by).orderBy(F.desc("_sev"), F.desc("avg_confidence"), "_first")
    top = F.transform(F.slice("_at", 1, 3), lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), (-s["c"]).alias("confidence")))
    return x.select(*by, "kind", "count", _named(F.col("_sev")).alias("severity"), "avg_confidence", "filtered_count", top.alias("top_locations"), F.row_number().over(order).alias("rank"))


def architecture(findings: DataFrame, by: tuple[str, ...] = ("pr_id",), top: int = 2, strict: bool = True) -> DataFrame:
    """by, category, count and top kinds: the first top findings in report order. Kinds of no category are left out.

    Report order puts medium before high and low, which share a place in order of appearance; strict=False puts high first.
    """
    sev = F.col("severity")
    place = F.when(sev == "medium", 1).otherwise(2) if strict else -severity_order(sev)
    x = findings.withColumn("category", category(F.col("kind"))).where("category is not null").withColumn("_place", place)
    n = F.row_number().over(Window.partitionBy(*by, "category").orderBy("_place", "seq"))
    x = x.withColumn("_n", n)
    tops = F.sort_array(F.collect_list(F.when(F.col("_n") <= top, F.struct("_n", "kind", "file", "line", "severity"))))
    return x.groupBy(*by, "category").agg(F.count("*").alias("count"), tops.alias("_t")).select(*by, "category", "count", F.transform("_t", lambda s: F.struct(s["kind"].alias("kind"), s["file"].alias("file"), s["line"].alias("line"), s["severity"].alias("severity"))).alias("top"))


def summary_input(findings: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, kind, count, severity (the highest) and files, distinct, in order of appearance."""
    f = findings.groupBy(*by, "kind", "file").agg(F.count("*").alias("n"), F.max(severity_order(F.col("severity"))).alias("s"), F.min("seq").alias("q"))
    x = f.groupBy(*by, "kind").agg(F.sum("n").alias("count"), F.max("s").alias("_s"), F.sort_array(F.collect_list(F.struct("q", "file"))).alias("_f"))
    return x.select(*by, "kind", "count", _named(F.col("_s")).alias("severity"), F.transform("_f", lambda s: s["file"]).alias("files"))


def review_candidates(findings: DataFrame, files: DataFrame, n: int = 3, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, file, severity and rank of the n files with a patch whose worst finding is worst, then by appearance."""
    x = findings.groupBy(*by, "file").agg(F.max(severity_order(F.col("severity"))).alias("_sev"), F.min("seq").alias("_first"))
    x = x.join(files.select(*by, "file").distinct(), [*by, "file"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_sev"), "_first"))
    return x.withColumn("rank", rank).where(F.col("rank") <= n).select(*by, "file", _named(F.col("_sev")).alias("severity"), "rank")


def issue_groups(findings: DataFrame, threshold: str = "high", max_groups: int = 3, max_locations: int = 5, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """The first max_groups kinds, by appearance, of findings at or over the threshold, with their first locations and how many more."""
    x = findings.where(severity_order(F.col("severity")) >= SEVERITY_ORDER[threshold])
    x = x.groupBy(*by, "kind").agg(F.count("*").alias("count"), F.min("seq").alias("_first"), F.sort_array(F.collect_list(F.struct("seq", "file", "line"))).alias("_at"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_first"))).where(F.col("rank") <= max_groups)
    at = F.transform(F.slice("_at", 1, max_locations), lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line")))
    return x.select(*by, "kind", "count", at.alias("locations"), F.greatest(F.col("count") - max_locations, F.lit(0)).alias("more"), "rank")


def issues_by_kind(issues: DataFrame, by: tuple[str, ...] = ("pr_id",), order: str = "ord") -> DataFrame:
    """by, kind, count, issues (all other columns, in order) and rank: kinds by their first issue."""
    rest = [c for c in issues.columns if c not in (*by, "kind", order)]
    x = issues.groupBy(*by, "kind").agg(F.count("*").alias("count"), F.min(order).alias("_first"), F.sort_array(F.collect_list(F.struct(order, *rest))).alias("issues"))
    return x.select(*by, "kind", "count", "issues", F.row_number().over(Window.partitionBy(*by).orderBy("_first", "kind")).alias("rank"))


def needs_comment(findings: DataFrame, scored: DataFrame, below: int = 60, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by pairs of scored with a finding of high severity, or a score under below."""
    high = findings.where("severity = 'high'").select(*by).distinct().withColumn("_high", F.lit(True))
    return scored.join(high, list(by), "left").where(F.coalesce("_high", F.lit(False)) | (F.col("score") < below)).drop("_high")
