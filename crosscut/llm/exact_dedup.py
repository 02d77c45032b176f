"""Exact duplicates: frequent texts found by a Misra-Gries summary are settled where they lie, the rest by one shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, checked, shuffle_width

#: A text is frequent if it is at least this share of all rows; so there are at most 1 / SHARE frequent texts.
SHARE = 1 / 2000


def normalised(text: Column) -> Column:
    """text with each run of space, \\t, \\n, \\v, \\f and \\r as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def summary_size(share: float) -> int:
    """Counters that find every item of at least a share of all rows.

    With m counters no count is off by more than 3.5 / m of all rows, and items whose lower bound exceeds
    that error come out; a quarter of the share as the error leaves room for both.
    """
    return math.ceil(4 * 3.5 / share * 0.75)


def frequent(digests: DataFrame, item: str, share: float) -> DataFrame:
    """(item): a superset of the values of a long column that make up at least a share of all rows; at most 1.5 / share values.

    Spark's frequent-items sketch is a Misra-Gries summary: a bounded table of counters, all lowered when it is full. Each task makes one, tasks
    are merged in about the root of their number of groups and then together, so that no task meets the sketches of all tasks.
    """
    size, most = summary_size(share), math.ceil(1.5 / share)
    groups = max(1, math.isqrt(digests.sparkSession.sparkContext.defaultParallelism + shuffle_width(digests.sparkSession)))
    part = digests.select(item, F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part"))
    one = part.groupBy("part").agg(F.expr(f"approx_top_k_accumulate({item}, {size})").alias("s"))
    # by a constant, as a table without rows has no summary
    top = one.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {size})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("e"))
    return top.select(F.col("e.item").alias(item))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = (), share: float = SHARE) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row, and the columns named in keep.

    Rows are equal when their normalised texts are; of equal rows the one with the smallest id stays, and keep_id is its id.

    Digests are written once, so texts are read once and never moved. Texts that make up at least share of all rows are counted exactly, by
    an aggregate that combines before its shuffle; their winners, at most 1 / share rows, are sent to every task, and their
    copies are settled without a shuffle. No other text has more than share of the rows, so one shuffle by digest settles them.

    Null texts count as empty, so empty and null texts are one group. Null ids come after all others: such a row stays only where all ids of its
    group are null, and keep_id is null then. Of rows with the same smallest id exactly one stays. An empty table gives no rows. Columns not
    in keep are not looked at; a column of keep that has the name of a result column is passed over for that one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    others = [c for c in dict.fromkeys(keep) if c != id and c.lower() not in ("keep_id", "group_size", "kept", "text_sha256", id.lower())]
    sha = F.unhex(F.sha2(normalised(F.col(text)), 256))
    # keep's columns travel in a struct, so that no name of theirs can meet one of these
    held = [F.struct(*[F.col(c) for c in others]).alias("held")] if others else []
    rows = docs.select(F.col(id).alias("id"), sha.alias("sha"), *held)
    rows = scratch.keep(rows.select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64("sha").alias("h")), "digests")
    n = rows.count()
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"))

    names = checked(scratch.keep(frequent(rows, "h", share), "names"))
    hot = rows.join(names, "h", "left_semi").groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    winners = checked(scratch.keep(hot.where(F.col("size") >= F.lit(max(2, math.ceil(share * n)))), "winners"))
    dealt = rows.join(winners, "sha", "left")
    settled = dealt.where("size is not null").select("id", "sha", "row", "first", "size", *(["held"] if held else []))
    group = Window.partitionBy("sha")
    rest = dealt.where("size is null").withColumns({"first": F.min(place).over(group), "size": F.count("*").over(group)}).select(*settled.columns)
    out = settled.unionByName(rest)
    return out.select(
        F.col("id").alias(id),
        F.col("first.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col("held").getField(c).alias(c) for c in others],
    )
