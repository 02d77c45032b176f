import random

from crosscut.llm.ngram_join import choose_bands, ngram_join
from crosscut.llm.words import word_list


def brute(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = word_list(t)
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    link = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(rows))]
    comp = {}
    for i in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        if i in comp:
            continue
        todo, comp[i] = [i], rows[i][0]
        while todo:
            for j in link[todo.pop()]:
                if j not in comp:
                    comp[j] = rows[i][0]
                    todo.append(j)
    return {rows[i][0]: (comp[i], len(link[i])) for i in range(len(rows))}


def texts(rng):
    words = [f"w{k}" for k in range(900)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
            i += 1
    return rows


def test_against_all_pairs(spark):
    rows = texts(random.Random(1)) + [(1000, None), (1001, ""), (1002, " .. "), (1003, "one"), (1004, "ONE!"), (1005, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, class_id int, n int")
    want = brute(rows)
    for block in (256, 3):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join(df, block=block).collect()}
        assert got == want


def test_large_group_of_near_copies_makes_no_pairs(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join(df, block=64).collect()}
    want = brute(rows)
    assert sum(a == b for a, b in ((got[i], want[i]) for i in want)) >= 0.98 * len(rows)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b, c d e f"), (2, "z y x w v u")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"], r["n_links"], r["kept"]) for r in ngram_join(df).collect())
    assert got == [(-1, 1, 2, False), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 0, True)]
    assert ngram_join(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.95):
        bands, rows = choose_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 160
