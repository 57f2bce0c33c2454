import numpy as np

from helixframe.llm import neighbours


def brute(ids, x, query, k):
    scores = x @ x[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-scores[i], ids[i]))[:k]
    return [(ids[i], scores[i]) for i in order]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[100:160] = x[100] + 0.01 * rng.normal(size=(60, 24))
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(900)]
    ids = list(range(900))
    queries = spark.createDataFrame([(i,) for i in range(0, 900, 20)], "query_id long")
    got = {}
    for r in neighbours.nearest(table(spark, rows), queries, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        found.sort()
        want = brute(ids, x.astype(np.float64), q, 20)
        assert [f[0] for f in found] == list(range(1, 21))
        hits += len({f[1] for f in found} & {w[0] for w in want})
        assert all(abs(s - float(x[q].astype(float) @ x[v].astype(float))) < 1e-12 for _, v, s in found)
    assert len(got) == 45 and hits >= 0.95 * 45 * 20


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 0.0], 1)]
    queries = spark.createDataFrame([(0,), (0,), (3,), (77,), (None,)], "query_id long")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(table(spark, rows), queries, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 2, 0.5)]
    assert neighbours.nearest(table(spark, []), queries, 20).collect() == []


def test_recall_in_a_large_group_of_near_copies(spark):
    """Differences far below a byte's step: only the original vectors can rank such a group."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4500, 64))
    for start, noise in ((0, 1e-2), (2000, 1e-3)):
        x[start : start + 2000] = x[start] / np.linalg.norm(x[start]) + noise / 8 * rng.normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(len(x))]
    queries = spark.createDataFrame([(i,) for i in range(0, 4000, 80)], "query_id long")
    got = {}
    for r in neighbours.nearest(table(spark, rows), queries, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = x.astype(np.float64)
    for start in (0, 2000):
        hits = 0
        for q in range(start, start + 2000, 80):
            scores = exact @ exact[q]
            scores[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
        assert hits >= 0.95 * 25 * 20, (start, hits)
