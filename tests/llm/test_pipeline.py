import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from crosscut.llm import quality as Q

from .test_line_dedup import brute as brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of the smallest table, of which the longest are cut, and some copies changed in a few words."""
    rng = random.Random(9)
    rows = [(r["doc_id"], (r["text"] or "")[:3000], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for k in range(30):
        w = rng.choice(rows)[1].split(" ")
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["new", "words", ""])
        rows.append((10_000 + k, " ".join(w), "en", "s"))
    return [(i, t, lang, s, len(t)) for i, t, lang, s in rows]


def as_frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_line_dedup_by_brute_force(spark, corpus):
    want = {i: t for i, t in brute_lines([(i, t) for i, t, *_ in corpus]).items()}
    stays = {i: want[i] for i, t, *_ in corpus if want[i] == t or want[i].strip(" \t\n\x0b\x0c\r")}
    assert {r["doc_id"]: r["text"] for r in P.line_dedup(spark, as_frame(spark, corpus), "").collect()} == stays


def test_ngram_jaccard_join_by_brute_force(spark, corpus):
    def grams(t):
        w = WORD.findall(lower(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t, *_ in corpus}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    want = {i for i in sets if root(i) == i}
    assert {r["doc_id"] for r in P.ngram_jaccard_join(spark, as_frame(spark, corpus), "").collect()} == want


def test_decontamination_by_brute_force(spark, corpus):
    d = "/root/testdata/sf0.001"
    windows = set()
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = WORD.findall(lower(r["text"] or ""))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    want = {}
    for i, t, *_ in corpus:
        at = [m.span() for m in WORD.finditer(lower(t))]
        w = [lower(t)[a:b] for a, b in at]
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        if sum(hit) <= 0.5 * len(w):
            want[i] = [x for x, h in zip(w, hit, strict=True) if not h]
    rows = P.benchmark_decontamination(spark, as_frame(spark, corpus), d).collect()
    assert {r["doc_id"]: WORD.findall(lower(r["text"])) for r in rows} == want
    whole = {i: t for i, t, *_ in corpus}
    assert all(r["text"] == whole[r["doc_id"]] for r in rows if len(want[r["doc_id"]]) == len(WORD.findall(lower(whole[r["doc_id"]]))))


def test_quality_classifier_by_its_rules(spark, corpus):
    """The rules applied one by one to each text's statistics."""
    import numpy as np
    import pyarrow as pa

    d = "/root/testdata/sf0.001"
    docs = as_frame(spark, corpus)
    model = Q.fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    x = Q.statistics(pa.array([t for _, t, *_ in corpus]))
    z = np.full(len(x), model.bias)
    for rule in model.rules:
        for k, v in enumerate(x):
            z[k] += rule.weight * all((v[i] > bound) if above else (v[i] <= bound) for i, above, bound in rule.when)
    want = {r[0] for r, s in zip(corpus, z, strict=True) if s >= 0}
    assert {r["doc_id"] for r in P.quality_classifier(spark, docs, d).collect()} == want


def test_mixing_by_sums(spark, corpus):
    rows = P.source_mixing(spark, as_frame(spark, corpus), "").collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in corpus}
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 200 for s in target)


def test_stages_keep_the_columns_and_catch_what_is_planted(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == cols, name
    out = P.STAGES[-1][1](spark, docs, d)
    assert out.columns[: len(cols)] == cols
    rows = out.collect()
    assert rows and all(r["copies"] >= 1 and r["taken"] == r["copies"] * r["size"] for r in rows)


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (2, long), (3, long + " end"), (4, "another text that stands alone here"), (None, long), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or -1) for r in P.ngram_jaccard_join(spark, df, "").collect())
    assert got == [1, 4, 5]  # the row without an id is a copy of document 1


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, "alone here"), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or -1), (r["text"] or "")[:5]) for r in P.ngram_jaccard_join(spark, df, "").collect())
    assert got == [(-1, "alone"), (-1, c[:5]), (1, a[:5]), (2, b[:5]), (3, "")]


def test_documents_of_repeated_lines_only_go(spark):
    t = "this line is long enough to count as one\nand so is this other line of words"
    df = spark.createDataFrame([(1, t, "en", "s", 1), (2, t, "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.line_dedup(spark, df, "").collect()) == [1, 3, 4]


def test_copies_with_short_lines_leave_nothing(spark, tmp_path):
    title, body = "A Short Title", "this line is long enough to count as one of a text"
    rows = [(1, f"{title}\n{body}\nThe End"), (2, f"{title}\n\n{body}\nThe End"), (3, f"{title}\nanother line of words that no other document has")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 3: "another line of words that no other document has"}


def test_a_planted_copy_is_gone_after_the_run(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    best = P.run(spark, d).where("n_chars > 400").orderBy("doc_id").first()["doc_id"]
    title = F.concat(F.lit("Planted Title\n"), "text")
    made = docs.withColumn("text", F.when(F.col("doc_id") == best, title).otherwise(F.col("text")))
    copy = made.where(F.col("doc_id") == best).withColumn("doc_id", (F.col("doc_id") + 1_000_000).cast(docs.schema["doc_id"].dataType))
    made.unionByName(copy).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    ids = {r["doc_id"] for r in P.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert best in ids and best + 1_000_000 not in ids
