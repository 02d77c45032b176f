import re

from crosscut.llm.mixing import mix, source_targets


def levels(sizes, weights=(1, 2, 3), most=3.0):
    """Excess shared again and again, as the text says."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    w = {s: float(weights[i % 3]) for i, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in capped else target[s] for s in order}
        capped |= set(over)


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 500, "d": 4, None: 9}, {"Z": 0, "a": 5}, {"é": 10, "z": 1000, "😀": 1, None: 1}, {"a": 0}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = levels(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), sizes


def test_mix(spark):
    docs = [(i, f"s{i % 7}" if i % 11 else None, "w " * (1 + i * i % 97)) for i in range(2000)]
    docs += [(5000, "s1", None), (5001, "s1", ""), (5002, "s2", "\u00a0a\x85b\tc"), (5003, "s3", "big " * 3000), (None, "s4", "x y")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mix(df).collect()
    assert len(rows) == len(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in docs}
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(100, 0.01 * target[s]) for s in target)
    again = {r["doc_id"]: r["taken"] for r in mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x y z")] * 40 + [(k, "a", "x") for k in range(2, 400)] + [(k, "b", "q r") for k in range(400, 500)], "doc_id long, source string, text string")
    rows = mix(df).collect()
    assert len(rows) == 538 and len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
    assert mix(df.limit(0)).count() == 0
