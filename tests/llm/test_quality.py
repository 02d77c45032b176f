import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crosscut.llm import quality as Q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 200
    rows = Q.score(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    out = [(r["predicted"], r["quality"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(out) > 50 and np.mean([p == q for p, q in out]) >= 0.97
    assert Q.fit_quality(docs, labels) == model


def test_column_equals_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(Q.STATS)))
    y = ((x[:, 1] > 0.6) & (x[:, 2] < 0.7) | (x[:, 5] > 0.8)).astype(float)
    m = Q.fit_rules(x, y)
    z = np.full(len(x), m.bias)
    for r in m.rules:
        z += r.weight * Q._holds(x, r.when)
    df = spark.createDataFrame([(i, tuple(map(float, v))) for i, v in enumerate(x)], "i int, _stats struct<" + ",".join(f"{c}:double" for c in Q.STATS) + ">")
    got = [r["s"] for r in df.select("i", m.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert np.mean((z > 0) == y) > 0.95


def test_odd_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "word " * 60_000, "s"), (3, "word", "s"), (None, "x", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.score(docs, Q.fit_quality(docs, none), ["doc_id", "score"]).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(2, 1), (3, 1), (3, None), (2, 7)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in Q.score(docs, Q.fit_quality(docs, one), ["doc_id"]).collect())
    assert Q.score(docs.limit(0), Q.fit_quality(docs, none), ["doc_id"]).count() == 0
    assert spark.range(3).select(Q.held_out(F.col("id")).alias("h")).collect()[0]["h"] == (zlib.crc32(b"0") % 3 == 1)


def test_statistics_of_slices_agree():
    texts = ["Ab c!! d", None, "", "x|y | z\n\nq", "é" * 50] * 40
    whole = Q.statistics(pa.array(texts))
    each = np.concatenate([Q.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, each) and not whole[1].any() and not whole[2].any()


def test_lasso_meets_its_conditions():
    """Brute force: at the optimum, every weight's gradient equals the penalty, or is below it where the weight is 0."""
    rng = np.random.default_rng(3)
    a = (rng.random((300, 12)) < 0.4).astype(float)
    y = ((a[:, 0] + a[:, 3] > 1) | (rng.random(300) < 0.1)).astype(float)
    share, penalty = Q._weights(y), 5e-3
    w, b = Q.lasso(a, y, penalty, rounds=20_000)
    g = a.T @ ((1 / (1 + np.exp(-(a @ w + b))) - y) * share / len(y))
    assert (np.abs(g) <= penalty + 1e-6).all() and 0 < (w != 0).sum() < 12
    assert np.allclose(g[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-6)
    assert abs((((1 / (1 + np.exp(-(a @ w + b)))) - y) * share).sum()) < 1e-6


def test_penalty_is_chosen_inside_the_rows_given():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(Q.STATS)))
    y = (x[:, 1] > 0.5).astype(float)
    fold = np.arange(300) % Q.FOLDS
    assert Q.choose_penalty(x, y, fold, 8, 2, 7) in Q.PENALTIES
    assert Q.choose_penalty(x, y, np.zeros(300, int), 8, 2, 7) == Q.PENALTIES[0]


def test_documents_that_share_an_id_count_once(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "plain words here" if i % 2 else "## $$ ||") for i in range(60)], "doc_id long, text string")
    again = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", "text")))
    assert Q.fit_quality(again, labels) == Q.fit_quality(again.repartition(3), labels)
