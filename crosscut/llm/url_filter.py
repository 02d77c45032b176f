"""URL filter rules as intervals over reversed-host keys, resolved by a sorted sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Aside, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages; columns of those names are replaced, others stay whatever their names and types.

    rules has host, path (starting with /, or empty) and action. A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest rule string wins, and of rules
    written twice the alphabetically first action. Rules without a host are ignored.
    A null url, or one without ://, has an empty host and path and gets the default verdict with a
    null rule; so does every row of an empty rule table. Repeated rows are each judged.

    A rule is the interval of all keys (reversed host, path) that start with its own. It holds its host's
    subdomains whatever comes between, and then its path, so a url's own key need not lie in it; the key of the url's
    path under the rule's host does. So a url gives one point for each number of labels that some rule has, and a
    rule of k labels can only hold the point of k labels. Intervals over one reversed host nest or lie apart, so in sorted order the
    last rule before a point carries the whole stack of rules that may still be open there. The sweep
    runs on distinct (host, path) only. A suffix that holds more than its share of points is swept in
    slices, each with a copy of that suffix's rules; there are at most as many slices as shuffle
    partitions.
    """
    spark = pages.sparkSession
    aside = Aside(pages)
    pages, url_col = aside.df, aside.name(url_col)
    width = shuffle_width(spark)
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .where("host is not null and host <> '' and action is not null")
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
        .withColumn("rev", _reversed(F.col("host")))
    )
    levels = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())  # a few numbers: label counts
    judged = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    if not levels:
        return aside.back(judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}))

    labels = F.size(F.split("host", r"\."))
    keys = judged.select("host", "path").where("host <> ''").distinct()
    probes = keys.select(
        "host",
        "path",
        F.explode(F.array_compact(F.array(*[F.when(labels >= k, F.substring_index("host", ".", -k)) for k in levels]))).alias("suffix"),
    ).withColumn("rev", _reversed(F.col("suffix"))).drop("suffix").join(rules.select("rev").distinct(), "rev", "left_semi")

    # A suffix with more than 1/width of the points is among the width most frequent ones.
    top = probes.groupBy("rev").count().orderBy(F.desc("count"), "rev").limit(width).collect()
    total = sum(r["count"] for r in top)
    slices = spark.createDataFrame([(r["rev"], -(-r["count"] * width // total)) for r in top] or [("", 1)], "rev string, slices long")
    slices = F.broadcast(slices)  # at most width rows

    opens = rules.select("rev", "path", F.struct(F.length("path").alias("n"), "path", F.concat("host", "path").alias("rule"), "action").alias("own"))
    outer = rules.select("rev", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("rev", "path", F.substring("path", F.lit(1), F.col("n")).alias("cut"))
    stacks = outer.join(opens.select("rev", F.col("path").alias("cut"), "own"), ["rev", "cut"]).groupBy("rev", "path").agg(F.sort_array(F.collect_list("own")).alias("stack"))
    stacks = stacks.join(slices, "rev", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1)))
    points = probes.join(slices, "rev", "left").withColumn("slice", F.pmod(F.xxhash64("host", "path"), F.coalesce("slices", F.lit(1))))

    events = stacks.select("rev", "slice", "path", "stack", F.lit(None).cast("string").alias("host")).unionByName(points.select("rev", "slice", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), "host"))
    sweep = Window.partitionBy("rev", "slice").orderBy("path", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
        .where("host is not null and active is not null")
        .withColumn("top", F.try_element_at(F.filter("active", lambda s: F.startswith(F.col("path"), s["path"])), F.lit(-1)))
        .where("top is not null")
    )
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("n"), F.col("top.rule").alias("rule"), F.col("top.action").alias("action"))).alias("w"))
    best = best.select("host", "path", F.col("w.rule").alias("rule"), F.col("w.action").alias("verdict"))
    # urls without a host meet nothing, so they are spread instead of sharing one key
    hashed = [f.name for f in pages.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    nothing = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*hashed), F.lit(1 << 20)).cast("string"))
    judged = judged.withColumn("_key", F.when(F.col("host") == "", nothing).otherwise(F.col("host")))
    best = best.select(F.col("host").alias("_key"), F.col("path").alias("_path"), "rule", "verdict")
    out = judged.join(best, (judged["_key"] == best["_key"]) & (judged["path"] == best["_path"]), "left").drop("_key", "_path")
    return aside.back(out.select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
