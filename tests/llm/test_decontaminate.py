import random

import pytest

from crosscut.llm.decontaminate import Automaton, find_spans, remove_spans
from crosscut.llm.words import word_list


def brute(text, items, n):
    w = word_list(text)
    hit, own = set(), set()
    for key, t in items:
        v = word_list(t)
        size = min(n, len(v))
        wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in wins:
                hit.update(range(k, k + size))
                own.add(key)
    return len(w), len(hit), own


def make(rng):
    vocab = [f"w{k}" for k in range(12)] + ["é", "ß"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for k in range(12)] + [(90, None), (91, "w1"), (92, " ;; "), (3, "w9 w9 w9 w9")]
    docs = [(k, rng.choice([" ", ". "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    for k in range(60, 90):
        a = items[rng.randrange(12)][1]
        docs.append((k, "Start " + a.upper() + "! and " + items[rng.randrange(12)][1] + " end"))
    return docs + [(200, None), (201, ""), (202, "word " * 40_000)], items


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 10, 10**6), (2, 4, 10**6), (3, 10, 40)])
def test_against_windows(spark, seed, n, block):
    docs, items = make(random.Random(seed))
    if n == 10:
        items = [(k, t) for k, t in items if t is None or len(word_list(t)) != 1]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], set(r["items"])) for r in find_spans(d, b, n, keep=["doc_id", "items"], max_block_words=block).collect()}
    for i, t in docs:
        assert got[i] == brute(t, items, n), i


def test_longest_matches():
    seqs = [(1, [b"a", b"b", b"c", b"a", b"b"]), (2, [b"b", b"c", b"d"])]
    auto = Automaton(seqs, 2)
    stream = [b"x", b"a", b"b", b"c", b"d", b"a", b"b", b"c", b"a"]
    factors = {tuple(s[i:j]) for _, s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for at, _, length in auto.follow(stream):
        assert length == max((k for k in range(at + 2) if tuple(stream[at + 1 - k : at + 1]) in factors or k == 0))


def test_removal(spark):
    item = " ".join(f"q{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"Before this é {item}. After it all of these words stay here as they are now", 9), (2, item + " x", 5), (3, None, None), (4, "clean", 5), (4, "clean", 5)], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in remove_spans(d, b).collect())
    text = "Before this é  . After it all of these words stay here as they are now"
    assert got == [(1, text, len(text)), (3, None, None), (4, "clean", 5), (4, "clean", 5)]
    assert remove_spans(d, b.limit(0)).count() == 5
    assert remove_spans(d.limit(0), b).count() == 0


@pytest.mark.parametrize("block", [10**6, 10])
def test_items_without_an_id(spark, block):
    a, b = (" ".join(f"{c}{k}" for k in range(12)) for c in "qz")
    d = spark.createDataFrame([(1, f"x {a} y"), (2, f"{a} and {b}"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, a + " end"), (7, b)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], set(r["items"]), len(r["items"])) for r in find_spans(d, items, max_block_words=block).collect()}
    assert got == {1: (12, {None}, 1), 2: (24, {None, 7}, 2), 3: (0, set(), 0)}
    assert [r["doc_id"] for r in remove_spans(d, items, max_block_words=block).collect()] == [3]
