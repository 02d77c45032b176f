"""Ordered lines of patches and files: splitting, hunks, line numbers, changed lines, added text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Starts a hunk wherever it stands in a line; gives the first line number in the new file.
HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def in_file() -> WindowSpec:
    """The order of a file's lines."""
    return Window.partitionBy("file_key").orderBy("idx")


def before() -> WindowSpec:
    return in_file().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return in_file().rowsBetween(Window.unboundedPreceding, 0)


def patch_lines(files: DataFrame, patch_col: str = "patch") -> DataFrame:
    """(file_key, filename, idx, raw): one row a line; null and blank patches give none. A trailing empty line counts."""
    kept = files.where(F.col(patch_col).rlike(r"\S"))
    return kept.select("file_key", "filename", F.posexplode(F.split(patch_col, "\n")).alias("idx", "raw"))


def content_lines(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(file_key, filename, line_no, text): one row a line, numbered from 1."""
    return files.select("file_key", "filename", F.posexplode(F.split(content_col, "\n")).alias("p", "text")).select("file_key", "filename", (F.col("p") + 1).alias("line_no"), "text")


def hunk_start(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, HUNK, 1), F.lit("")).cast("int")


def marked(lines: DataFrame) -> DataFrame:
    """Adds op and body: op is @ for a hunk header, # for a file header (--- or +++), else +, - or a space."""
    raw = F.col("raw")
    op = F.when(hunk_start(raw).isNotNull(), "@").when(raw.startswith("---") | raw.startswith("+++"), "#").when(raw.startswith("+"), "+").when(raw.startswith("-"), "-").otherwise(" ")
    return lines.withColumn("op", op).withColumn("body", F.when(F.col("op") == "+", F.substring("raw", 2, 1_000_000_000)))


def counted() -> dict[str, Column]:
    """Running counts of marked lines: those that advance the number, and hunks."""
    steps = F.sum(F.when(F.col("op").isin("+", " "), 1).otherwise(0)).over(before())
    return {"_steps": F.coalesce(steps, F.lit(0)), "hunk": F.count(F.when(F.col("op") == "@", 1)).over(so_far())}


def number(steps: str = "_steps") -> Column:
    """The line's number from that running count: the count since the header is the count so far less that at the header."""
    base = F.last(F.when(F.col("op") == "@", hunk_start(F.col("raw")) - F.col(steps)), ignorenulls=True).over(so_far())
    return (F.coalesce(base, F.lit(0)) + F.col(steps)).cast("int")


def with_new_lines(lines: DataFrame) -> DataFrame:
    """Adds op, body, hunk and new_line, the number of the line in the new file (0-based count before any hunk).

    File headers and removed lines do not advance the number; every other line does, context or not.
    """
    return marked(lines).withColumns(counted()).withColumn("new_line", number()).drop("_steps")


def changed_lines(lines: DataFrame) -> DataFrame:
    """(file_key, line) of added lines. Lines that begin with "diff " are passed over as well."""
    x = with_new_lines(lines.where(~F.col("raw").startswith("diff ")))
    return x.where("op = '+'").select("file_key", F.col("new_line").alias("line")).distinct()


def added_text(lines: DataFrame) -> DataFrame:
    """(file_key, idx, line_no, text): added lines without their sign and context lines as they are, numbered anew from 1.

    Hunk offsets are not kept: the number is the line's place among those that stay.
    """
    raw = F.col("raw")
    added = raw.startswith("+") & ~raw.startswith("+++")
    stays = added | ~(raw.startswith("-") | raw.startswith("@@") | raw.startswith("diff "))
    x = lines.where(stays).withColumn("text", F.when(added, F.substring("raw", 2, 1_000_000_000)).otherwise(raw))
    return x.select("file_key", "idx", F.row_number().over(in_file()).alias("line_no"), "text")
