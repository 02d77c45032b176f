"""Reports as text columns: grouped findings, categories, baseline issues, check runs and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SEVERITY_ORDER

# Confidence labels, and how much of each list a report shows.
CONFIDENCE = [(0.9, "very high"), (0.7, "high"), (0.5, "medium"), (None, "low")]
MAX_GROUPS, MAX_LOCATIONS, PROMPT_FINDINGS, PROMPT_CODE, JOB_TOP = 8, 3, 50, 3000, 5

# Our own wording.
REVIEW_TASK = "List the production risks of the changed lines as JSON: {\"issues\": [{\"kind\", \"title\", \"line\", \"summary\", \"severity\"}], \"architectureSummary\"}. Put findings with one cause together."
SUMMARY_TASK = "Say in two or three sentences what has to be mended first, with numbers, and nothing else."


def confidence_label(c: Column) -> Column:
    out = None
    for least, name in CONFIDENCE[:-1]:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise(CONFIDENCE[-1][1])


def place(file: Column, line: Column) -> Column:
    """file:line, or the file alone without a line."""
    return F.concat(F.lit("`"), file, F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""), F.lit("`"))


def grouped_text(groups: DataFrame, by: tuple[str, ...] = ("pr_id",), max_groups: int = MAX_GROUPS, max_locations: int = MAX_LOCATIONS) -> DataFrame:
    """by and text: one item a kind in order of rank, its first locations, and how many more of both there are."""
    shown = F.array_join(F.transform(F.slice("locations", 1, max_locations), lambda s: place(s["file"], s["line"])), ", ")
    more = F.when(F.size("locations") > max_locations, F.concat(F.lit(" +"), (F.size("locations") - max_locations).cast("string"), F.lit(" more"))).otherwise("")
    item = F.concat(F.lit("- **"), F.col("kind"), F.lit("** ("), F.col("severity"), F.lit(", "), F.col("count").cast("string"), F.lit("x): "), F.col("description"), F.lit(" in "), shown, more)
    x = groups.withColumn("_item", item).groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("rank") <= max_groups, F.struct("rank", "_item")))).alias("_i"), F.greatest(F.count("*") - max_groups, F.lit(0)).alias("_more"))
    rest = F.when(F.col("_more") > 0, F.array(F.concat(F.lit("- "), F.col("_more").cast("string"), F.lit(" more kinds")))).otherwise(F.array().cast("array<string>"))
    return x.select(*by, F.array_join(F.concat(F.transform("_i", lambda s: s["_item"]), rest), "\n").alias("text"))


def architecture_text(categories: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by and text: a table row a category with its count and first findings."""
    tops = F.array_join(F.transform("top", lambda s: F.concat(s["kind"], F.lit(" "), place(s["file"], s["line"]))), "; ")
    row = F.concat(F.lit("| "), F.col("category"), F.lit(" | "), F.col("count").cast("string"), F.lit(" | "), tops, F.lit(" |"))
    x = categories.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("category", row.alias("r")))).alias("_r"))
    return x.select(*by, F.array_join(F.concat(F.array(F.lit("| Risk | Findings | First |"), F.lit("| --- | --- | --- |")), F.transform("_r", lambda s: s["r"])), "\n").alias("text"))


def check_runs(scored: DataFrame, counts: DataFrame, texts: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """One record a change set: title, summary, text; the conclusion is always neutral."""
    x = scored.join(counts, list(by), "left").join(texts, list(by), "left")
    title = F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(": "), F.col("label"))
    summary = F.concat(F.coalesce("total", F.lit(0)).cast("string"), F.lit(" findings ("), *[p for s in SEVERITY_ORDER for p in (F.coalesce(s, F.lit(0)).cast("string"), F.lit(f" {s}" + (", " if s != "low" else ")")))])
    return x.select(*by, title.alias("title"), summary.alias("summary"), F.coalesce("text", F.lit("No static findings.")).alias("text"), F.lit("neutral").alias("conclusion"))


def validation_prompts(findings: DataFrame, contents: DataFrame, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, file and prompt: a file's first findings with its code, cut to a length. Nothing is sent anywhere."""
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" at "), F.coalesce("line", F.lit(0)).cast("string"), F.lit(": "), F.coalesce("message", F.lit("")))
    x = findings.groupBy(*by, "file").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))).alias("_l"))
    x = x.join(contents.select(*by, "file", "content"), [*by, "file"], "left")
    body = F.array_join(F.transform(F.slice("_l", 1, PROMPT_FINDINGS), lambda s: s["l"]), "\n")
    code = F.coalesce(F.concat(F.lit("\n\nCode:\n"), F.substring("content", 1, PROMPT_CODE)), F.lit(""))
    return x.select(*by, "file", F.concat(F.lit("Say for each finding whether it is real.\n"), body, code).alias("prompt"))


def baseline_text(groups: DataFrame, stats: DataFrame, by: tuple[str, ...] = ("repo",), examples: int = 3) -> DataFrame:
    """by and text of a baseline issue: totals, then a section a severity with its kinds and first examples."""
    shown = F.array_join(F.transform(F.slice("locations", 1, examples), lambda s: place(s["file"], s["line"])), ", ")
    item = F.concat(F.lit("- "), F.col("kind"), F.lit(" ("), F.col("count").cast("string"), F.lit("): "), shown)
    order = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    x = groups.groupBy(*by, "severity", order.alias("_o")).agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("i")))).alias("_i"))
    x = x.withColumn("_t", F.concat(F.lit("### "), F.col("severity"), F.lit("\n"), F.array_join(F.transform("_i", lambda s: s["i"]), "\n")))
    x = x.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_o", "_t"))).alias("_s"))
    head = F.concat(F.lit("Files analyzed: "), F.col("files_analyzed").cast("string"), F.lit(", skipped: "), F.col("files_skipped").cast("string"), F.when(F.col("truncated"), " (truncated)").otherwise(""))
    return stats.join(x, list(by), "left").select(*by, F.array_join(F.concat(F.array(head), F.coalesce(F.transform("_s", lambda s: s["_t"]), F.array().cast("array<string>"))), "\n\n").alias("text"))


def review_prompts(files: DataFrame, findings: DataFrame, outlines: DataFrame | None = None, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, file and prompt: what a reviewing model is told of a changed file. Nothing is sent anywhere.

    files has by, file, language (may be null), snippet, and content (may be null); findings are those of the rules,
    the first PROMPT_FINDINGS of each file; outlines has by, file and outline.
    """
    item = F.to_json(F.struct("kind", "line", "severity", F.coalesce("message", F.lit("")).alias("summary")))
    f = findings.groupBy(*by, "file").agg(F.sort_array(F.collect_list(F.struct("seq", item.alias("i")))).alias("_f"))
    x = files.join(f, [*by, "file"], "left")
    x = x.join(outlines.select(*by, "file", "outline"), [*by, "file"], "left") if outlines is not None else x.withColumn("outline", F.lit(None).cast("string"))
    known = F.array_join(F.transform(F.slice("_f", 1, PROMPT_FINDINGS), lambda s: s["i"]), "\n")
    parts = [
        F.concat(F.lit("File: "), F.col("file"), F.coalesce(F.concat(F.lit(" ("), F.col("language"), F.lit(")")), F.lit(""))),
        F.concat(F.lit("Outline:\n"), F.col("outline")),
        F.when(F.size("_f") > 0, F.concat(F.lit("Findings so far, one a line:\n"), known)),
        F.concat(F.lit("Whole file:\n"), F.col("content")),
        F.concat(F.lit("Changed lines:\n"), F.col("snippet")),
        F.lit(REVIEW_TASK),
    ]
    return x.select(*by, "file", F.concat_ws("\n\n", *parts).alias("prompt"))


def summary_prompts(scored: DataFrame, counts: DataFrame, kinds: DataFrame, by: tuple[str, ...] = ("pr_id",), max_files: int = MAX_LOCATIONS) -> DataFrame:
    """by and prompt: what a model is told that sums a change set up. kinds is group.summary_input with a rank."""
    more = F.when(F.size("files") > max_files, F.concat(F.lit(" and "), (F.size("files") - max_files).cast("string"), F.lit(" more"))).otherwise("")
    item = F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.col("count").cast("string"), F.lit(", "), F.col("severity"), F.lit(", in "), F.array_join(F.slice("files", 1, max_files), ", "), more)
    k = kinds.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("count", "kind", item.alias("i"))), False), lambda s: s["i"]), "\n").alias("_k"))
    x = scored.join(counts, list(by)).join(k, list(by), "left")
    head = F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(" of 100; "), F.col("total").cast("string"), F.lit(" findings, "), F.col("high").cast("string"), F.lit(" high, "), F.col("medium").cast("string"), F.lit(" medium."))
    return x.select(*by, F.concat_ws("\n\n", head, F.col("_k"), F.lit(SUMMARY_TASK)).alias("prompt"))


def job_outputs(scored: DataFrame, counts: DataFrame, validated: DataFrame, fail_on_high: bool = True, top: int = JOB_TOP, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """by, score, findings_count, high_count, summary and failed: what a build step gives back and writes down.

    The summary lists counts, how many findings were left out as false positives, and the first top of the others by
    severity, then order. A build fails if it has findings of high severity and fail_on_high is set.
    """
    v = validated.groupBy(*by).agg(*job_lines())
    return job_texts(scored.join(counts, list(by)).join(v, list(by), "left"), fail_on_high, top, by)


def job_lines() -> list[Column]:
    """Of validated findings: how many are false positives, and the lines of the others in order."""
    real = ~F.col("false_positive")
    line = F.concat(F.lit("- **["), F.upper("severity"), F.lit("]** "), place(F.col("file"), F.col("line")), F.lit(" "), F.col("kind"))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return [F.count_if(~real).alias("_filtered"), F.sort_array(F.collect_list(F.when(real, F.struct(order.alias("o"), "seq", line.alias("l"))))).alias("_l")]


def job_texts(x: DataFrame, fail_on_high: bool = True, top: int = JOB_TOP, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """job_outputs of rows with a score, counts and job_lines."""
    table = F.concat(F.lit("| Severity | Findings |\n| --- | --- |"), *[p for s in SEVERITY_ORDER for p in (F.lit(f"\n| {s} | "), F.col(s).cast("string"), F.lit(" |"))])
    parts = [
        F.concat(F.lit("**Score:** "), F.col("score").cast("string"), F.lit("/100 ("), F.col("label"), F.lit(")")),
        table,
        F.when(F.col("_filtered") > 0, F.concat(F.col("_filtered").cast("string"), F.lit(" left out as likely false positives"))),
        F.when(F.size("_l") > 0, F.array_join(F.transform(F.slice("_l", 1, top), lambda s: s["l"]), "\n")),
    ]
    return x.select(*by, "score", F.col("total").alias("findings_count"), F.col("high").alias("high_count"), F.concat_ws("\n\n", *parts).alias("summary"), (F.lit(fail_on_high) & (F.col("high") > 0)).alias("failed"))
