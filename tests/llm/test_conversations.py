import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from crosscut.llm import conversations as C
from crosscut.llm.queries import SQL


def plain(classes):
    """Least cost, then least letters, by a search over whole edit strings."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(classes) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, letters
        if (i, roles, letters) in seen or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        seen.add((i, roles, letters))
        for r in "ua":
            heapq.heappush(heap, (cost + 3, letters + "I", i, roles + r))
        if i < len(classes):
            row = classes[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles))
            if row.isalpha():
                more = 3 if row.isupper() else 0
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + row.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + more + 3, letters + "R", i + 1, roles + r))
    raise AssertionError


def test_cheapest_against_search():
    for n in range(4):
        for row in itertools.product("suaxUA0", repeat=n):
            assert C.cheapest("".join(row)) == plain("".join(row)), row
    rng = random.Random(5)
    for _ in range(60):
        row = "".join(rng.choices("suaxSUAX0123", weights=[2, 6, 6, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=rng.randrange(4, 8)))
        assert C.cheapest(row) == plain(row), row


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(6)
    rows = ["".join(rng.choices("suaxUA01", k=n)) for n in (0, 1, 3, 4, 5, 8, 40, 41, 400)]
    whole = [C.cheapest(r) for r in rows]
    monkeypatch.setattr(C, "BLOCK", 4)
    assert [C.cheapest(r) for r in rows] == whole


def rows_of(rng, n):
    texts = ["Hello there.", "ok", "Sure!", "", " \n", "no end", "What? ", "é.", None, "x" * 20_000 + "."]
    out = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            out.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 3]), role, rng.choice(texts), "extra"))
    return out


def oracle(df):
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    return sorted(map(str, con.sql("SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM (" + SQL["op11_conversation_repair"] + ")").fetchall()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sql(spark, seed):
    df = spark.createDataFrame(rows_of(random.Random(seed), 80), "conv_id long, turn long, role string, text string, classes string")
    rows = C.damaged(df)
    got = sorted(str(tuple(r)) for r in C.repair(rows, df.select("conv_id")).collect())
    assert got == oracle(df)


def test_a_conversation_of_many_blocks(spark):
    rng = random.Random(9)
    rows = []
    for k in range(10_000):
        rows.append((1, k // 3 if k > 50 else None, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {k}.", f"text {k}", "again.", ""])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    r = C.repair(df).collect()
    assert len(r) == 1
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1], x[2], x[3]) if x[1] is not None else (False, 0, x[2], x[3]))
    seen, classes, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in order:
        fault = "blank" if not text.strip() else "duplicate" if (role, text) in seen else "" if text.strip()[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            count[fault] += 1
        c = role[0]
        classes += {"s": "1", "u": "2", "a": "3"}[c] if fault in ("blank", "duplicate") else c.upper() if fault else c
    cost, audit = C.cheapest(classes)
    assert (r[0]["cost"], r[0]["audit"]) == (cost, audit) and all(r[0][f] == n for f, n in count.items())
    turns = {t for _, t, _, _ in rows if t is not None}
    assert r[0]["gaps"] == max(turns) - min(turns) + 1 - len(turns)
    after = C.repaired(df).orderBy("place").collect()
    assert re.fullmatch("s?(ua)+", "".join(x["role"][0] for x in after))
    assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in after).encode()).hexdigest() == r[0]["repaired_sha256"]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        one = (c, t, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
        want += [one] * (0 if way == 0 else 2 if way == 3 else 1)
    assert sorted(map(str, map(tuple, C.damaged(df).collect()))) == sorted(map(str, want))


def test_empty_and_all_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(none).collect() == []
    named = spark.createDataFrame([(7,)], "conv_id long")
    assert [tuple(r) for r in C.repair(none, named).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
