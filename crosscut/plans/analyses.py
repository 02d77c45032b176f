"""Whole analyses, each one lazy plan from scan to result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rules import FILE_RULES
from ..operators import file_rules, group, lines, merge, patch_rules, report, score, suppress, validation
from ..sources.config import Config, apply_rules
from ..sources.staging import running, staged


def analyze_pull_requests(files: DataFrame, config: Config | None = None, contents: DataFrame | None = None, structural: DataFrame | None = None, ranges: DataFrame | None = None, keyword: str = suppress.KEYWORD) -> DataFrame:
    """Findings of (pr_id, file_key, file_ord, filename, patch), with level, is_prototype_zone, origin and seq (by change set).

    file_key names a file of a change set. contents has (file_key, content) of files whose whole text is known,
    ranges their comments and strings, structural the findings of their syntax (file_key, seq, line, severity, kind,
    message, snippet). Files without a patch, that are no code or that are ignored give nothing.
    """
    config = config or Config()
    kept = files.where(F.col("patch").isNotNull() & X.is_code_file(F.col("filename")) & ~config.ignored(F.col("filename")))
    src = lines.patch_lines(kept)
    found = patch_rules.analyze_lines(src).drop("filename")
    found = found.withColumn("seq", F.row_number().over(Window.partitionBy("file_key").orderBy(F.col("rule_ord") > 100, "idx", "rule_ord")))
    cols = ["file_key", "seq", "line", "severity", "kind", "message", "snippet"]
    found = found.select(*cols)
    if ranges is not None:
        found = merge.outside_ranges(found, ranges)
    if structural is not None:
        changed = lines.changed_lines(src)
        structural = structural.join(changed, ["file_key", "line"], "left_semi").select(*cols)
        found = merge.merge_structural(structural, found).withColumn("part", F.col("prec")).select(*cols, "origin", "part")
    else:
        found = found.withColumns({"origin": F.lit("textual"), "part": F.lit(1)})
    if contents is not None:
        whole = file_rules.analyze_files(contents.join(kept.select("file_key", "filename"), "file_key"))
        whole = whole.withColumn("seq", F.row_number().over(Window.partitionBy("file_key").orderBy("line", "rule_ord")))
        whole = whole.withColumns({"message": F.lit(None).cast("string"), "origin": F.lit("file"), "part": F.lit(3)}).select(*cols, "origin", "part")
        found = merge.with_new(found, whole)
    text = lines.added_text(src).groupBy("file_key").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    directives = suppress.parse_directives(text.select("file_key", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("text")), keyword=keyword)
    found = apply_rules(found.join(kept.select("file_key", "pr_id", "file_ord", "filename"), "file_key"), config)
    found = suppress.suppress(found, directives)
    order = Window.partitionBy("pr_id").orderBy("file_ord", "file_key", "part", "seq")
    return found.withColumn("seq", F.row_number().over(order)).drop("part").withColumnRenamed("filename", "file")


def analyze_repository(snapshots: DataFrame, config: Config | None = None, rules: Iterable[str] = FILE_RULES, max_files: int = 200, keyword: str = suppress.KEYWORD) -> tuple[DataFrame, DataFrame]:
    """(findings, stats) of (repo, file_key, file_ord, filename, content): a baseline scan of the first max_files files it can analyze.

    stats has files_analyzed, files_skipped (before the limit was reached) and truncated for each repo. file_key is a file's own.
    """
    config = config or Config()
    ok = X.is_code_file(F.col("filename")) & ~config.ignored(F.col("filename"))
    keys = snapshots.select("repo", "file_ord", "file_key", ok.alias("ok")).withColumn("one", F.col("ok").cast("long"))
    x = staged(running(keys, ("repo",), ("file_ord", "file_key"), "one").withColumn("inside", F.col("sum_before") < max_files), "places")
    stats = x.groupBy("repo").agg(F.count_if(F.col("inside") & F.col("ok")).alias("files_analyzed"), F.count_if(F.col("inside") & ~F.col("ok")).alias("files_skipped"), F.bool_or(~F.col("inside")).alias("truncated"))
    # contents are met only after the cut
    kept = snapshots.join(x.where("inside and ok").select("file_key"), "file_key", "left_semi")
    found = file_rules.analyze_files(kept, rules)
    directives = suppress.parse_directives(kept, "content", keyword)
    found = suppress.suppress(apply_rules(found, config), directives)
    return found.join(kept.select("file_key", "repo", "file_ord"), "file_key"), stats


def summarize(findings: DataFrame, validated: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """One row a change set: score, label, high_risk and severity counts, false positives left out if validated is given."""
    config = config or Config()
    real = findings if validated is None else validation.without_false_positives(findings, validated)
    return score.scores(real, config.multiplier, config.high_risk_below, counts=True)


def api_results(findings: DataFrame, validated: DataFrame, config: Config | None = None) -> DataFrame:
    """summarize with details: validated findings if a change set has any, else its static ones; line 0 as null."""
    details = validated.groupBy("pr_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "file", F.nullif("line", F.lit(0)).alias("line"), "severity", "confidence", "false_positive"))).alias("details"))
    return summarize(findings, validated, config).join(details, "pr_id", "left")


def job_outputs(validated: DataFrame, config: Config | None = None, fail_on_high: bool = True) -> DataFrame:
    """report.job_outputs of validated findings and of their summary, in one pass by change set; those without a real finding have no row."""
    config = config or Config()
    x = validated.withColumn("real", validation.real())
    points = F.sum(F.when(F.col("real"), score.cost(config.multiplier)))
    x = x.groupBy("pr_id").agg(points.alias("penalty"), *score.counts_of(F.col("real")), *report.job_lines()).where("pr_id is not null and total > 0")
    return report.job_texts(score.scored(x, config.high_risk_below), fail_on_high)


def grouped_report(findings: DataFrame) -> DataFrame:
    from ..operators.report import grouped_text

    return grouped_text(group.by_kind(findings))
