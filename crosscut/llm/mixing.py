"""Mixing sources to target weights by pivotal rounding of copy probabilities along a reduction tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Fractional documents in one node of the tree, on average.
NODE = 48


def text_size(text: Column) -> Column:
    """The number of runs of characters other than space, \\t, \\n, \\v, \\f and \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """source, source_size and target of each source (null is one) of a table (source, size).

    Sources in code point order, null last, weigh weights in turn and share all sizes by weight. No target
    exceeds max_repeat times its source's size; what it would have more is shared by weight again.
    That ends at min(max_repeat * size, level * weight) with one level for all: sources are capped in
    order of size over weight, and the level is what is left over the weights that are left; it rises up
    to the first source that needs no cap and falls after that. The
    windows run over one row a source in one task: weights go by place among all sources, so sources are meant to be
    as many as one task sorts (millions), not as many as documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_wleft": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)), "_all": F.sum("source_size").over(every).cast("double")})
    s = s.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_wleft"))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every))
    return s.select("source", "source_size", F.least("_cap", F.coalesce("_level", F.lit(0.0)) * F.col("_w")).alias("target"))


def _node(items: Column, salt: Column) -> Column:
    """Pairs the fractional documents of a node, largest first: (rest, settled).

    x is the probability of one more copy and a the words that copy has. Of a pair, words move from one to
    the other until one's probability is 0 or 1, the way chosen with chances that keep each
    expectation; the words expected in all stay the same.
    """
    # state: c (the document still open, null before the first), done (settled ones)

    def merge(state: Column, n: Column) -> Column:
        def moved(v: Column) -> Column:
            # v: up (words that can come to c), down (that can leave it), go (whether they come)
            c = state["c"]
            up_full = c["a"] * (1.0 - c["x"]) <= n["a"] * n["x"]  # c reaches 1 before n reaches 0
            down_out = c["a"] * c["x"] <= n["a"] * (1.0 - n["x"])  # c reaches 0 before n reaches 1
            cx = F.when(v["go"], F.least(F.lit(1.0), c["x"] + v["up"] / c["a"])).otherwise(F.greatest(F.lit(0.0), c["x"] - v["down"] / c["a"]))
            nx = F.when(v["go"], F.greatest(F.lit(0.0), n["x"] - v["up"] / n["a"])).otherwise(F.least(F.lit(1.0), n["x"] + v["down"] / n["a"]))
            c_ends = F.when(v["go"], up_full).otherwise(down_out)
            end = F.struct(F.when(c_ends, c["id"]).otherwise(n["id"]).alias("id"), F.when(c_ends, F.when(v["go"], 1).otherwise(0)).otherwise(F.when(v["go"], 0).otherwise(1)).alias("more"))
            rest = F.struct(F.when(c_ends, n["id"]).otherwise(c["id"]).alias("id"), F.when(c_ends, n["a"]).otherwise(c["a"]).alias("a"), F.when(c_ends, nx).otherwise(cx).alias("x"))
            return F.struct(rest.alias("c"), F.concat(state["done"], F.array(end)).alias("done"))

        c = state["c"]
        up, down = F.least(c["a"] * (1.0 - c["x"]), n["a"] * n["x"]), F.least(c["a"] * c["x"], n["a"] * (1.0 - n["x"]))
        chance = F.pmod(F.xxhash64(c["id"], n["id"], salt), F.lit(1 << 30)) / F.lit(float(1 << 30))
        pick = _let(F.struct(up.alias("up"), down.alias("down")), lambda v: F.struct(v["up"], v["down"], (chance * (v["up"] + v["down"]) < v["down"]).alias("go")))
        return F.when(c.isNull(), F.struct(F.struct(n["id"].alias("id"), n["a"].alias("a"), n["x"].alias("x")).alias("c"), state["done"].alias("done"))).otherwise(_let(pick, moved))

    first = F.element_at(items, 1)
    start = F.struct(F.struct(first["id"].alias("id"), first["a"].alias("a"), first["x"].alias("x")).alias("c"), F.filter(F.array(F.struct(first["id"].alias("id"), F.lit(0).alias("more"))), lambda _: F.lit(False)).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, merge)


def _round(opened: DataFrame, nodes: int, scratch: Scratch, seed: int) -> DataFrame:
    """(source, id, more) for each open document (source, id, a, x): 1 if its fraction gives a copy."""
    settled, level = None, 0
    while True:
        groups = opened.groupBy("source", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(nodes)).alias("_node")).agg(F.sort_array(F.collect_list(F.struct("a", "id", "x")), asc=False).alias("items"))
        done = scratch.keep(groups.select("source", _node(F.col("items"), F.lit(seed + level)).alias("r")), f"level{level}")
        out = done.select("source", F.explode("r.done").alias("d")).select("source", "d.id", "d.more")
        settled = out if settled is None else settled.unionByName(out)
        rest = done.select("source", "r.c.id", "r.c.a", "r.c.x")
        if nodes == 1:
            return settled.unionByName(rest.select("source", "id", (F.col("x") >= 0.5).cast("int").alias("more")))
        opened, level, nodes = rest, level + 1, -(-nodes // NODE)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11) -> DataFrame:
    """id_col, source, size, source_size, target, copies and taken (copies times size) of every row of docs.

    A document of a source is expected target / source_size times. The whole part is taken as it is; the
    fractions are rounded in nodes of about NODE documents, whose one open document goes on to the
    next level of the tree, until one is open: it is taken by the nearer of 0 and 1. A source's
    documents of over 1/16 of its words come first, then those of over 1/256, then the others; what the
    first ones took too much or too little is made up by the rate of the later ones. So the words that a
    source gives differ from its target by less than one document of the last kind it has. The draws
    depend on ids, sizes and seed only, so reruns agree. Empty and null texts have size 0 and nothing
    is taken of them. Rows with equal id, source and size are rounded as one, each taken
    alike. Null ids and a null source are values like others; an empty table gives none. Extra
    columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size")), "sizes")
    goals = scratch.keep(source_targets(rows, weights, max_repeat), "targets")
    part = F.when(F.col("a") * 16 > F.col("source_size"), 0).when(F.col("a") * 256 > F.col("source_size"), 1).otherwise(2)
    named = goals.select(F.col("source").alias("_s"), "source_size")
    units = rows.where("size > 0").groupBy("source", "doc_id", "size").count().withColumn("a", F.col("size") * F.col("count"))
    units = scratch.keep(units.join(named, units["source"].eqNullSafe(named["_s"])).select("source", F.struct("doc_id", "size").alias("id"), "a", part.alias("part")), "units")
    largest = units.where("part = 2").groupBy("source").count().agg(F.max("count")).first()[0] or 0

    left = goals.select("source", F.col("target").alias("goal"), F.col("source_size").cast("double").alias("words"))
    decided = None
    for k in range(3):
        rate = F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeat)), F.col("goal") / F.col("words")))).otherwise(0.0)
        rates = left.select(F.col("source").alias("_s"), rate.alias("rate"))
        mine = units.where(F.col("part") == k)
        mine = mine.join(rates, mine["source"].eqNullSafe(rates["_s"])).drop("_s").withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("x", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
        opened = mine.where("x > 1e-9").select("source", "id", F.col("a").cast("double").alias("a"), "x")
        more = _round(opened, max(1, -(-largest // NODE)) if k == 2 else 1, scratch, seed + 100 * k)
        more = more.select(F.col("source").alias("_s"), F.col("id").alias("_i"), "more")
        took = mine.join(more, mine["source"].eqNullSafe(more["_s"]) & (mine["id"]["size"] == more["_i"]["size"]) & mine["id"]["doc_id"].eqNullSafe(more["_i"]["doc_id"]), "left")
        took = took.select("source", "id", "a", (F.col("base") + F.coalesce("more", F.lit(0))).cast("int").alias("copies"))
        if k < 2:
            took = scratch.keep(took, f"part{k}")
            used = took.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("a") * F.col("copies")).alias("used"), F.sum("a").alias("had"))
            left = left.join(used, left["source"].eqNullSafe(used["_s"]), "left").select("source", (F.col("goal") - F.coalesce("used", F.lit(0))).alias("goal"), (F.col("words") - F.coalesce("had", F.lit(0))).alias("words"))
            left = scratch.keep(left, f"left{k}")
        decided = took if decided is None else decided.unionByName(took)
    decided = decided.select(F.col("source").alias("_s"), F.col("id.doc_id").alias("_d"), F.col("id.size").alias("_z"), "copies")
    out = rows.join(decided, (rows["size"] == decided["_z"]) & rows["doc_id"].eqNullSafe(decided["_d"]) & rows["source"].eqNullSafe(decided["_s"]), "left").drop("_s")
    named = goals.select(F.col("source").alias("_s"), "source_size", "target")
    out = out.join(named, out["source"].eqNullSafe(named["_s"]))
    copies = F.coalesce("copies", F.lit(0))
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies.cast("long") * F.col("size")).alias("taken"))
