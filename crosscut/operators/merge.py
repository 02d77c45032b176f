"""Putting findings of several origins together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import STRUCTURAL_KINDS


def outside_ranges(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings of which the line lies in no comment or string range of its file.

    A marker for unfinished work is looked for in comments, so only strings hide it. Files without ranges keep all; findings
    without a line stay. Findings and the starts of ranges are swept in order of lines: a line is inside one if the furthest end
    so far is not before it, so no finding meets the ranges of its file one by one.
    """
    c = F.col
    starts = ranges.select("file_key", c("start_line").cast("long").alias("line"), F.lit(0).alias("late"), c("end_line").cast("long").alias("any_end"), F.when(~c("range_type").eqNullSafe("comment"), c("end_line").cast("long")).alias("string_end"))
    asked = findings.select("file_key", c("line").cast("long").alias("line"), F.lit(1).alias("late"), F.struct("*").alias("finding"))
    sweep = Window.partitionBy("file_key").orderBy("line", "late").rowsBetween(Window.unboundedPreceding, 0)
    x = starts.unionByName(asked, allowMissingColumns=True).withColumns({"any_end": F.max("any_end").over(sweep), "string_end": F.max("string_end").over(sweep)})
    end = F.when(c("finding.kind") == "TEMPORARY_HACK", c("string_end")).otherwise(c("any_end"))
    hidden = (c("line") != 0) & (end >= c("line"))
    return x.where((c("late") == 1) & ~F.coalesce(hidden, F.lit(False))).select("finding.*")


def with_new(known: DataFrame, findings: DataFrame) -> DataFrame:
    """known, and those of findings that are not in known by file, line (null equals null) and kind; columns of known.

    One pass over each: a window tells whether a file, line and kind is known.
    """
    x = known.withColumn("_old", F.lit(True)).unionByName(findings.select(*known.columns).withColumn("_old", F.lit(False)))
    same = Window.partitionBy("file_key", "line", "kind")
    x = x.withColumn("_known", F.bool_or("_old").over(same) & F.col("file_key").isNotNull() & F.col("kind").isNotNull())
    return x.where(F.col("_old") | ~F.col("_known")).drop("_old", "_known")


def new_findings(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings that are not in known by file, line (null equals null) and kind."""
    k = known.select(F.col("file_key").alias("_f"), F.col("line").alias("_l"), F.col("kind").alias("_k")).distinct()
    return findings.join(k, (F.col("file_key") == F.col("_f")) & F.col("line").eqNullSafe(F.col("_l")) & (F.col("kind") == F.col("_k")), "left_anti")


def merge_structural(structural: DataFrame, textual: DataFrame) -> DataFrame:
    """One finding for each file, line and kind: structural ones of the preferred kinds first, then textual, then the others.

    Textual findings of preferred kinds count only in files without any structural finding. seq orders the rows of each
    input; origin and prec are added.
    """
    preferred = F.col("kind").isin(STRUCTURAL_KINDS)
    s = structural.withColumn("origin", F.lit("structural")).withColumn("prec", F.when(preferred, 0).otherwise(2))
    t = textual.withColumn("origin", F.lit("textual")).withColumn("prec", F.lit(1))
    # each input is read once: windows by file serve those by file, line and kind
    x = s.unionByName(t).withColumn("_has", F.bool_or(F.col("origin") == "structural").over(Window.partitionBy("file_key")) & F.col("file_key").isNotNull())
    x = x.where((F.col("origin") == "structural") | ~preferred | ~F.col("_has")).drop("_has")
    first = F.row_number().over(Window.partitionBy("file_key", "line", "kind").orderBy("prec", "seq"))
    return x.withColumn("_n", first).where("_n = 1").drop("_n")
