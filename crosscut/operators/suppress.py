"""Directives in comments that suppress findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULE_IDS

#: What directives begin with; sources that use another word pass it as keyword.
KEYWORD = "risk-ignore"


def parse_directives(sources: DataFrame, text_col: str = "text", keyword: str = KEYWORD) -> DataFrame:
    """(file_key, line, scope, all_rules, rules) of every directive in (file_key, text), line breaks \\n or \\r\\n.

    scope is file, line or next-line, in any case. ALL counts only as the whole list; otherwise names of known rules,
    in upper case, are kept, and a directive without one is dropped.
    """
    pattern = rf"(?i){keyword}-(file|line|next-line)\s+([A-Z0-9_,\s]+|ALL)"
    x = sources.select("file_key", F.posexplode(F.split(text_col, "\r?\n")).alias("p", "l")).where(F.col("l").rlike(f"(?i){keyword}"))
    x = x.select("file_key", (F.col("p") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(pattern), F.lit(0))).alias("d"))
    named = F.trim(F.regexp_replace(F.regexp_extract("d", pattern, 2), r"\s", " "))
    x = x.select("file_key", "line", F.lower(F.regexp_extract("d", pattern, 1)).alias("scope"), named.alias("named"))
    x = x.withColumn("all_rules", F.upper("named") == "ALL")
    rules = F.filter(F.split("named", r"[,\s]+"), lambda r: r.isin(RULE_IDS))
    x = x.select("file_key", "line", "scope", "all_rules", F.when(F.col("all_rules"), F.array().cast("array<string>")).otherwise(rules).alias("rules"))
    return x.where(F.col("all_rules") | (F.size("rules") > 0))


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings that no directive of their file covers.

    A known kind is covered by a directive that names it (or ALL) for the file, its line, or the line before; only if
    it has a line. Other kinds are covered by ALL for the file only. Findings meet one row a file, with its directives
    as an array, so they are read once.
    """
    known = F.col("kind").isin(RULE_IDS)
    placed = F.coalesce(F.col("line"), F.lit(0)) != 0
    said = directives.groupBy(F.col("file_key").alias("_f")).agg(F.collect_list(F.struct("line", "scope", "all_rules", "rules")).alias("_said"))

    def covers(d: Column) -> Column:
        here = (d["scope"] == "file") | (F.col("line") == d["line"] + F.when(d["scope"] == "next-line", 1).otherwise(0))
        return F.when(known, placed & (d["all_rules"] | F.array_contains(d["rules"], F.col("kind"))) & here).otherwise((d["scope"] == "file") & d["all_rules"])

    out = findings.join(said, F.col("file_key") == F.col("_f"), "left")
    return out.where(F.col("_said").isNull() | ~F.exists("_said", covers)).select(*findings.columns)


def file_suppressions(directives: DataFrame) -> DataFrame:
    """(file_key, all_rules, rules): what each file suppresses as a whole."""
    d = directives.where("scope = 'file'").groupBy("file_key")
    return d.agg(F.bool_or("all_rules").alias("all_rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))
