"""What the lines around a line say: bounded frames over one order a file, so Spark sorts once for all of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import flag, in_lower_case
from .lines import in_file

# Frames in raw lines, both ends included.
FRAMES: dict[str, tuple[str, int, int]] = {
    "near_error_handling": ("error_handling", -5, 5),
    "near_validation": ("validation_lower", -8, 8),
    "in_route_handler": ("route_handler", -15, -1),
    "after_loop": ("loop", -8, -1),
    "in_async": ("async", -20, -1),
    "near_pagination": ("pagination", -5, 5),
    "near_batching": ("batching", -8, 8),
    "in_request": ("request_context", -20, -1),
    "near_backoff": ("backoff_lower", -10, 10),
    "before_delay": ("delay", 1, 10),
    "before_act": ("act_added", 1, 8),
    "before_io": ("io_added", 1, 8),
    "io_around": ("io", -10, 9),
}


def line_flags(raw: Column, low: Column) -> dict[str, Column]:
    """The flags that the frames look for; low is the line in lower case."""
    added = raw.startswith("+")
    has = lambda g: flag(raw, g, low)
    return {
        "error_handling": has("error_handling"),
        "validation_lower": flag(low, "validation"),
        "route_handler": has("route_handler"),
        "loop": has("loop"),
        "async": has("async"),
        "pagination": has("pagination"),
        "batching": has("batching"),
        "request_context": has("route_handler") | has("request_use"),
        "backoff_lower": flag(low, "backoff"),
        "delay": has("delay"),
        "act_added": added & has("act"),
        "io_added": added & has("io"),
        "io": has("io"),
    }


def flags_of(names: Iterable[str]) -> Column:
    """The flags that the named frames read, as one struct."""
    need = {FRAMES[n][0] for n in names}
    raw = F.col("raw")
    return in_lower_case(raw, lambda low: F.struct(*[v.alias(k) for k, v in line_flags(raw, low).items() if k in need]))


def frames(names: Iterable[str]) -> dict[str, Column]:
    """The named frames over the struct _flags."""
    return {n: F.coalesce(F.bool_or(f"_flags.{FRAMES[n][0]}").over(in_file().rowsBetween(*FRAMES[n][1:])), F.lit(False)) for n in FRAMES if n in set(names)}


def with_neighbourhood(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds a boolean for each named frame (all by default): whether any line of it has the frame's flag."""
    names = names or list(FRAMES)
    return lines.withColumn("_flags", flags_of(names)).withColumns(frames(names)).drop("_flags")


def silent_catch(next_lines: Column) -> Column:
    """Whether the catch on the first of these (at most 10) lines swallows the error. Nulls stand for lines past the last one.

    Braces are counted from there; once a { was seen, the lines after the first belong to the block, until the
    count is 0. Without braces that block is empty, blank, comments, or only plain logging.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(False).alias("done"), F.lit("").alias("text"))

    def step(s: Column, line: Column) -> Column:
        opens = F.length(line) - F.length(F.replace(line, F.lit("{"), F.lit("")))
        closes = F.length(line) - F.length(F.replace(line, F.lit("}"), F.lit("")))
        depth, is_open = s["depth"] + opens - closes, s["open"] | (opens > 0)
        text = F.when(is_open & (s["i"] > 0), F.concat(s["text"], F.lit("\n"), line)).otherwise(s["text"])
        nxt = F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), is_open.alias("open"), (is_open & (depth == 0)).alias("done"), text.alias("text"))
        return F.when(s["done"], s).otherwise(nxt)

    block = F.aggregate(F.array_compact(next_lines), start, step)["text"]
    block = F.regexp_replace(F.regexp_replace(block, "[{}]", ""), r"\A\s+|\s+\z", "")
    only_comments = F.regexp_replace(block, "//[^\n]*", "").rlike(r"\A\s*\z")
    only_logging = block.rlike(r"\A(?:\s*console\.(?:log|error|warn)\([^)]*\);\s*)+\z") & ~block.rlike("throw|return|reject")
    return only_comments | only_logging
