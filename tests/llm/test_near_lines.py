"""op9 and the pipeline's line dedup against all pairs of long lines, whatever their lines begin and end with."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from crosscut.llm import line_dedup as L
from crosscut.llm.line_dedup import dedup_lines

from .test_line_dedup import distance


def near_by_all_pairs(lines):
    """Places of lines that an earlier distinct one is within the bound of edits of; all have twenty words or more."""
    split = [x.split(" ") for x in lines]
    gone = set()
    for j, b in enumerate(split):
        if any(abs(len(a) - len(b)) <= min(len(a), len(b)) // 10 and distance(a, b) <= min(len(a), len(b)) // 10 for a in split[:j]):
            gone.add(j)
    return gone


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        k, what = rng.randrange(len(w)), rng.randrange(3)
        w = w[:k] + [[rng.choice("uvxyz")], [w[k], rng.choice("uvxyz")], []][what] + w[k + 1 :]
    return w


def test_edits_spread_over_a_line(spark):
    rng = random.Random(11)
    lines = []
    for n in (20, 29, 30, 39, 40, 42, 43, 60, 99, 120):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
        lines += [" ".join(base), *(" ".join(edited(rng, base, e)) for e in range(1, n // 10 + 3) for _ in range(4))]
        # edits near both ends, at equal distances: no shared beginning or end is as long as a sixth of the line
        spread = list(base)
        for k in range(n // 10):
            spread[min(n - 1, (k + 1) * n // (n // 10 + 1))] = "other"
        first = "x " + " ".join(base[1:-1]) + " y"
        lines += [" ".join(spread), first]
    lines = [x for x in dict.fromkeys(lines) if len(x.split(" ")) >= 20]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"] for r in dedup_lines(df).where("n_removed = 1").collect()}
    assert got == near_by_all_pairs(lines)


def test_pipeline_cuts_a_line_that_is_near_a_later_alike_one(spark):
    base = [f"w{k}" for k in range(40)]
    other = [*base[:13], *(f"q{k}" for k in range(14)), *base[27:]]  # begins and ends like base, and comes first
    near = [*base[:5], "x", *base[6:20], "y", *base[21:35], "z", *base[36:]]
    rows = [(1, " ".join(other)), (2, " ".join(base)), (3, " ".join(near))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.line_dedup(spark, df, "").collect()) == [1, 2]


def test_very_long_lines_and_repeats(spark):
    base = [f"w{k % 50}" for k in range(9000)]
    near = [w if k % 15 else "other" for k, w in enumerate(base)]
    far = [w if k % 5 else "else" for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(near) + "\n" + " ".join(near))]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}


def test_many_alike_lines_that_are_not_near_leave_no_pairs(spark):
    """Lines that share most of their grams, but none of which is within the bound of another: their number alone makes no rows."""
    rng = random.Random(5)
    base = [f"word{k}" for k in range(60)]
    lines = [[chr(0x4E00 + 60 * i + k) if k % 10 in (3, 4 + i % 5) else w for k, w in enumerate(base)] for i in range(300)]
    lines += [edited(rng, lines[7], 6), lines[8][1:], [*base[:30], *(f"z{k}" for k in range(30))]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    assert {r["doc_id"] for r in dedup_lines(df).where("n_removed = 1").collect()} == {300, 301}
    scratch, aside = L.Scratch(spark, "test"), df.select(F.col("doc_id").alias("d"), F.lit(0).alias("p"), F.col("text").alias("line"))
    marks = aside.withColumn("n", F.size(F.split("line", " "))).withColumn("marks", L._grams())
    occ = marks.withColumn("h", F.xxhash64("line"))
    met = L._meeting(occ, occ.select("h", "d", "p", "n", "marks.b0", "marks.b1"), scratch)
    none = met.select("d", "p").limit(0)
    assert met.groupBy("key").count().agg(F.max("count")).first()[0] > 50
    assert L._near_long(met, none, df, "doc_id", "text", scratch).count() == 2
    compared = sum(spark.read.parquet(f"{scratch.root}/{f}").count() for f in os.listdir(scratch.root.removeprefix("file://")) if f.endswith("-wanted"))
    scratch.end()
    assert compared <= 150  # lines of pairs that the bits leave, in both passes; all 303 share grams
