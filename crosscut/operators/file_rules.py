"""The rules over every line of a whole file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import flag
from ..functions.rules import FILE_RULES
from .lines import content_lines
from .patch_rules import MAX_FINDINGS


def analyze_files(files: DataFrame, rules: Iterable[str] = FILE_RULES, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """Findings of (file_key, filename, content): line by line, one line's in the order of FILE_RULES, the first max_findings a file.

    Names in rules that have no such check do nothing.
    """
    t = F.col("text")
    full = X.trim(t)
    secret = F.concat(F.substring(full, 1, 80), F.when(F.length(t) > 80, "...").otherwise(""))
    checks = [
        ("STATEFUL_SERVICE", "high", flag(t, "stateful"), full),
        ("PROTOTYPE_INFRA", "high", flag(t, "prototype_infra"), full),
        ("HARDCODED_SECRET", "high", flag(t, "secret") & ~X.is_test_file(F.col("filename")), secret),
        ("UNSAFE_EVAL", "high", flag(t, "unsafe_eval"), full),
        ("GLOBAL_MUTATION", "medium", flag(t, "module_literal"), full),
    ]
    rules = set(rules)
    hits = [F.when(p, F.struct(F.lit(i).alias("rule_ord"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), c.alias("snippet"))) for i, (k, s, p, c) in enumerate(checks) if k in rules]
    kind = "array<struct<rule_ord:int,kind:string,severity:string,snippet:string>>"
    found = F.array_compact(F.array(*hits)) if hits else F.lit(None).cast(kind)
    x = content_lines(files).select("file_key", "filename", F.col("line_no").alias("line"), F.explode(found).alias("f")).select("file_key", "filename", "line", "f.*")
    nth = F.row_number().over(Window.partitionBy("file_key").orderBy("line", "rule_ord"))
    return x.withColumn("_n", nth).where(F.col("_n") <= max_findings).drop("_n")
