"""Merging reads each of its inputs once."""

import random

from crosscut.functions.rules import STRUCTURAL_KINDS
from crosscut.operators import merge

KINDS = [*sorted(STRUCTURAL_KINDS)[:2], "MADE_UP", "OTHER"]
SCHEMA = "file_key long, seq long, line long, kind string"


def counted(spark, rows):
    """A table of rows, and how many of them tasks have read so far."""
    n = spark.sparkContext.accumulator(0)

    def note(frames):
        for f in frames:
            n.add(len(f))
            yield f

    return spark.createDataFrame(rows, SCHEMA).mapInPandas(note, SCHEMA), n


def some(rng, n):
    return [(rng.choice([None, 1, 2, 3, 4]), k, rng.choice([None, 1, 2, 3]), rng.choice(KINDS)) for k in range(n)]


def test_structural_and_textual_findings_are_read_once(spark):
    rng = random.Random(3)
    structural, textual = [r for r in some(rng, 12) if r[0] != 4], some(rng, 60)
    (s, read_s), (t, read_t) = counted(spark, structural), counted(spark, textual)
    got = sorted(((r["file_key"], r["seq"], r["line"], r["kind"], r["origin"]) for r in merge.merge_structural(s, t).collect()), key=str)
    assert (read_s.value, read_t.value) == (len(structural), len(textual))
    has, best = {f for f, *_ in structural if f is not None}, {}
    for origin, rows in (("structural", structural), ("textual", textual)):
        for f, seq, line, kind in rows:
            if origin == "textual" and kind in STRUCTURAL_KINDS and f in has:
                continue
            prec = 1 if origin == "textual" else 0 if kind in STRUCTURAL_KINDS else 2
            best.setdefault((f, line, kind), []).append((prec, seq, origin))
    assert got == sorted(((f, min(v)[1], line, kind, min(v)[2]) for (f, line, kind), v in best.items()), key=str)


def test_findings_that_are_new_are_added_in_one_pass(spark):
    rng = random.Random(8)
    old, new = some(rng, 20), some(rng, 60)
    (k, read_k), (f, read_f) = counted(spark, old), counted(spark, new)
    got = sorted(map(str, map(tuple, merge.with_new(k, f).collect())))
    assert (read_k.value, read_f.value) == (len(old), len(new))
    known = spark.createDataFrame(old, SCHEMA)
    want = known.unionByName(merge.new_findings(spark.createDataFrame(new, SCHEMA), known).select(*known.columns))
    assert got == sorted(map(str, map(tuple, want.collect())))
