import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from crosscut.llm import divergence as V
from crosscut.llm.queries import SQL


def fixture(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n long")


def oracle(df):
    documents = df.toPandas()  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(map(str, con.sql("SELECT lang, source, part, item, value, rank FROM (" + SQL["op12_source_divergence"] + ")").fetchall()))


def result(df):
    return sorted(str(tuple(r)) for r in V.divergence(df).collect())


def test_against_every_term_of_every_pair(spark):
    rng = random.Random(11)
    words = ["Ab", "ab", "été", "日本", "x1y", "don't", "Z", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 30))) if rng.random() < 0.95 else None, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", "Z", None]), "t", 1) for k in range(900)]
    # a language of too few documents for any term, a group without terms, repeated rows, a long text
    rows += [(k, "only here", "xx", f"s{k % 3}", "t", 1) for k in range(20)] + [(1, "12 34", "en", "empty", "t", 1)] * 2 + [(2, "ab Ab " * 100_000, "fr", "a", "t", 1)]
    df = fixture(spark, rows).repartition(5)
    got = result(df)
    assert got == oracle(df) and any("'xx', 's1', 'pair', 's0', 0, 1" in r for r in got)


def test_empty(spark):
    assert result(fixture(spark, [])) == []


def test_same_source_shares(spark):
    rows = [(k, "same words", "en", s, "", 0) for k in range(30) for s in ("a", "b")]
    assert result(fixture(spark, rows)) == ["('en', 'a', 'pair', 'b', 0, 1)", "('en', 'b', 'pair', 'a', 0, 1)"]


def test_share_is_exact(spark):
    big = 9 * 10**17
    df = spark.createDataFrame([(big, big + 7, 3), (0, 0, 1), (1, 10**15, 12345), (4, 4, 0), (0, 0, 0)], "c long, t long, v long")
    got = [r[0] for r in df.select(V.share(df.c, df.t, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 5) // (t + 5 * v) if t + 5 * v else None for c, t, v in ((big, big + 7, 3), (0, 0, 1), (1, 10**15, 12345), (4, 4, 0), (0, 0, 0))]


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_long_texts_in_pieces(monkeypatch, size):
    monkeypatch.setattr(V, "SLICE", size)
    text = "Aé bb 日本日本 c,c " * 40 + "q" * 300 + "1" + "é" * 200
    got = V._long(np.frombuffer(text.encode(), dtype=np.uint8)).to_pydict()
    want = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
    assert dict(zip(got["term"], got["n"], strict=True)) == want
