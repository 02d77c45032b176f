import numpy as np
import pyarrow as pa

from crosscut.llm.embedding_dedup import Graph, _labels, _search, audit_recall, near_duplicates, spread


def clustered(rng, n, dim=24):
    centers = rng.normal(size=(n // 12 + 1, dim))
    x = centers[rng.integers(0, len(centers), n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True) + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.06, 0.3], size=(n, 1))


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    return s.sum(axis=1), _labels(len(x), s)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 900)
    x = np.concatenate((x, x[:40], x[:10] * 7))
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int")
    links, label = brute(x)
    for kwargs in ({}, {"cluster": 60, "max_graph": 150}):
        out = near_duplicates(df, **kwargs)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
        assert all(got[i][0] <= links[i] for i in range(len(x)))
        assert sum(g[0] for g in got.values()) >= 0.97 * links.sum()
        assert sum(got[i][1] == label[i] for i in range(len(x))) >= 0.97 * len(x)
        assert audit_recall(df, out, every=10) >= 0.95


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(-1, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 4, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_graph_reaches_a_tight_group():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(400, 16)), rng.normal(size=(1, 16)) + rng.normal(size=(300, 16)) * 0.05))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    near = [list(map(int, row[row >= 0])) for row in g.adj]
    for i, row in enumerate(near):
        for p in row[:6]:
            near[p] = [*near[p], i]
    g = Graph(x, adjacency=[np.array(sorted(set(r))) for r in near])
    q, _ = g.within(x, 0.9)
    assert len(q) >= 0.98 * (x @ x.T >= 0.9).sum()


def test_a_shard_whose_graph_search_fails_is_compared_in_full():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(700, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x)
    cols = {"rep": pa.array(range(n), pa.int64()), "near": pa.array([[]] * n, pa.list_(pa.int64())), "unit": pa.array([v.tobytes() for v in x], pa.binary())}
    cols |= {"shard": pa.array([0] * n, pa.int64()), "shards": pa.array([[0]] * n, pa.list_(pa.int64())), "mult": pa.array([1] * n, pa.int64()), "in_graph": pa.array([1] * n, pa.int32()), "asks": pa.array([True] * n)}
    got = _search(0.9)(pa.table(cols)).sort_by("rep")
    links, label = brute(x)
    assert got.column("links").to_pylist() == links.tolist() and got.column("root").to_pylist() == label.tolist()


def test_a_dense_group_larger_than_a_graph(spark):
    """All of 500 vectors link with each other, in graphs of 150 at most, beside others."""
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(1, 24)) + rng.normal(size=(500, 24)) * 0.05, rng.normal(size=(400, 24))))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, label = brute(x)
    got = {r["vec_id"]: r for r in near_duplicates(df, max_graph=150, cluster=60).collect()}
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.98 * links.sum() and all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    assert all(got[i]["component_id"] == label[i] for i in range(len(x)))


def test_centres_that_are_nearly_the_same_are_one():
    c = np.array([[1.0, 0.0], [0.99, 0.141], [0.0, 1.0]])
    assert len(spread(c)) == 2


def test_a_recall_out_of_reach_has_all_parts_compared_in_full(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 300)
    x = np.concatenate((x, x[:9]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, label = brute(x)
    got = {r["vec_id"]: r for r in near_duplicates(df, target=1.01, max_graph=150).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist() and [got[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_recall_of_many_planted_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(14_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=(6_000, 32))
    near = x[rng.integers(0, 5_000, 6_000)] + turn / np.linalg.norm(turn, axis=1, keepdims=True) * rng.uniform(0, 0.6, (6_000, 1))
    x = np.concatenate((x, near))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(u), 1000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.95 * want.sum() and want.sum() > 5_000
