import hashlib
import random
import re

import pytest

from crosscut.llm import exact_dedup as D


def brute(rows):
    """[(doc_id, keep_id, group_size, sha)] in sorted order, and how many rows of each text stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        out += [(i, first, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("share", [D.SHARE, 1 / 3, 1 / 20])
def test_against_brute_force(spark, share):
    rng = random.Random(7)
    texts = [None, "", " ", "a b", "a  b", "a\tb", "a b", "A b", "a b ", "é" * 50_000, "x\x0by", "x y", "😀"]
    rows = [(k if rng.random() < 0.95 else None, rng.choice(texts)) for k in range(600)] + [(k, "hot text") for k in range(1000, 1500)] + [(3, "a b"), (3, "a b"), (None, "alone"), (None, "alone")]
    rows += [(k, f"t{k % 400}") for k in range(2000, 2900)]
    rng.shuffle(rows)
    # columns whose names meet results and inner names
    df = spark.createDataFrame([(i, t, k, "x", 1.0, "s") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long, sha string, kept double, held string")
    out = D.exact_dedup(df, keep=("row", "sha", "kept", "held"), share=share)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "row", "sha", "held"]
    got = out.collect()
    want, n_groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert all(rows[r["row"]][0] == r["doc_id"] for r in got)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n_groups == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_empty(spark):
    assert D.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_frequent_finds_every_frequent_value(spark):
    rng = random.Random(3)
    values = [v for v in range(30) for _ in range(150)] + [rng.randrange(10**9) for _ in range(30_000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(9)
    share = 150 / len(values)
    found = {r["h"] for r in D.frequent(df, "h", share).collect()}
    assert found >= set(range(30)) and len(found) <= 1.5 / share + 1
