"""Model answers as an input column: finding, repairing and normalising their JSON. Nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and severities of an answer's issues.
KINDS = ["SCALING_RISK", "CONCURRENCY_RISK", "RESILIENCE_GAP", "OBSERVABILITY_GAP", "DATA_CONTRACT_RISK", "ENVIRONMENT_ASSUMPTION"]
SEVERITIES = ["low", "medium", "high"]
_LAST = r'(?s)\A.*"severity"\s*:\s*"(?:low|medium|high)"\s*\}'
_EMPTY = '{"issues": [], "architectureSummary": null}'
_ISSUE = "struct<kind:string,title:string,file:string,line:string,summary:string,explanation:string,evidenceSnippet:string,suggestedFix:string,severity:string>"


def repair(answer: Column) -> Column:
    """A cut-off answer ended after its last whole issue; null if it does not look like one."""
    cut = F.substring(answer, F.instr(answer, "{"), F.length(answer))
    whole = F.regexp_extract(cut, _LAST, 0)
    looks = answer.contains('"issues"') & answer.contains("[") & answer.contains("{") & cut.rlike(r'"issues"\s*:\s*\[')
    return F.when(looks, F.when(whole == "", _EMPTY).otherwise(F.concat(whole, F.lit("]}"))))


def embedded_object(answer: Column) -> Column:
    """From the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def embedded_array(answer: Column) -> Column:
    """From the first [ to the last ], within a code fence if there is one, or null."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\[.*\])\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit("")))


def issues(answers: DataFrame, answer_col: str = "answer", default_file: str = "file") -> DataFrame:
    """All columns of answers with one row an issue: ord, kind, title, issue_file, line, summary, evidence, fix, severity.

    Unknown kinds are scaling risks, unknown severities medium; titles and summaries have defaults. Answers that neither
    parse nor can be repaired give no issues.
    """
    a = F.col(answer_col)
    text = F.coalesce(embedded_object(a), a)
    parse = lambda t: F.from_json(t, f"issues array<{_ISSUE}>, architectureSummary string")
    first = parse(text)
    x = answers.withColumn("_p", F.coalesce(first["issues"], parse(repair(a))["issues"]))
    x = x.select(*answers.columns, F.posexplode("_p").alias("ord", "_i")).where("_i is not null")
    i = F.col("_i")
    return x.select(
        *answers.columns,
        "ord",
        F.when(i["kind"].isin(KINDS), i["kind"]).otherwise("SCALING_RISK").alias("kind"),
        F.coalesce(i["title"], F.lit("Unknown issue")).alias("title"),
        F.coalesce(i["file"], F.col(default_file)).alias("issue_file"),
        F.expr("try_cast(_i.line as int)").alias("line"),
        F.coalesce(i["summary"], i["explanation"], F.lit("No summary provided")).alias("summary"),
        i["evidenceSnippet"].alias("evidence"),
        i["suggestedFix"].alias("fix"),
        F.when(i["severity"].isin(SEVERITIES), i["severity"]).otherwise("medium").alias("severity"),
    )
