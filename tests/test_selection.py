"""Stability selection and elimination against loops over replicates and refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.operators import selection as sl


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 12))
    x[:, 7] = 3.0  # does not vary
    x[:, 5] = x[:, 0] + 0.3 * rng.normal(size=240)
    y = 2 * x[:, 0] - 1.5 * x[:, 3] + x[:, 9] + rng.normal(size=240)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(240)]
    odd = [(900, None, 1.0), (901, [1.0] * 3, 1.0), (902, [float("nan")] * 12, 1.0), (903, [1.0] * 12, None)]
    return x, y, spark.createDataFrame(rows + odd, "sample long, features array<double>, target double").repartition(5)


def replicate(x, y, w):
    m = np.average(x, axis=0, weights=w)
    d = x - m
    sd = np.sqrt(np.average(d**2, axis=0, weights=w))
    z = d / np.where(sd > 1e-9, sd, np.inf)
    c = (z * w[:, None]).T @ z / w.sum()
    return c, z.T @ (w * (y - np.average(y, weights=w))) / w.sum()


def test_weights_are_poisson(spark):
    w = np.array([r.weights for r in sl.with_weights(spark.range(2000).withColumnRenamed("id", "sample"), 20).collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and len({tuple(c) for c in w.T}) == 20


@pytest.mark.parametrize("how, held", [("lasso", sl.HELD), ("top", 20_000)])
def test_frequencies_are_those_of_a_loop(data, monkeypatch, how, held):
    monkeypatch.setattr(sl, "HELD", held)  # replicates in groups
    x, y, rows = data
    weights = {r.sample: np.array(r.weights) for r in sl.with_weights(rows, 30).collect()}
    w = np.array([weights[i] for i in range(240)])
    counts = np.zeros((len(sl.PATH) if how == "lasso" else 1, 12))
    for b in range(30):
        c, r = replicate(x, y, w[:, b])
        if how == "lasso":
            for k, share in enumerate(sl.PATH):
                counts[k] += np.abs(sl.lasso(c, r, share * np.abs(r).max())) > 1e-6
        else:
            beta = np.abs(np.linalg.solve(c + sl.RIDGE * np.eye(12), r))
            counts[0, np.argsort(-beta, kind="stable")[:3]] += 1
    got = {r.feature: r for r in sl.stability(rows, 12, 30, how=how).collect()}
    assert [got[f].frequency for f in range(12)] == pytest.approx((counts.max(axis=0) / 30).tolist())
    assert got[0].selected and got[3].selected and not got[7].selected and got[7].frequency == 0
    assert all(r.frequency == 0 for r in sl.stability(rows.limit(0), 12, 5, how=how).collect())


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    c, r = x.T @ x / 50, x.T @ rng.normal(size=50) / 50
    b = sl.lasso(c, r, 0.05)
    slope = r - c @ b
    assert np.allclose(slope[b != 0], 0.05 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(slope[b == 0]) <= 0.05 + 1e-6).all()


def test_elimination_keeps_what_tells(data):
    x, y, rows = data
    got = {r.feature: r for r in sl.recursive_elimination(rows, 12, keep=3).collect()}
    assert {f for f, r in got.items() if r.selected} == {0, 3, 9} and got[7].rank == max(r.rank for r in got.values())
    c, r = replicate(x, y, np.ones(240))
    assert [got[f].rank for f in range(12)] == sl.eliminated(c, r, 3) and all(v.score == 1 / v.rank for v in got.values())
    left, rank = list(range(12)), {}
    while len(left) > 3:  # one at a time
        b = np.abs(np.linalg.solve(c[np.ix_(left, left)] + sl.RIDGE * np.eye(len(left)), r[left]))
        rank[left.pop(int(np.argmin(b)))] = len(left) - 2  # the last one to go has 2
    assert all(got[f].rank == k for f, k in rank.items())
    assert sl.recursive_elimination(rows.limit(0), 4, keep=2).count() == 4


def test_the_queries_are_whole_refits(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and len(r.embedding) == 64]
    x, y = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.float64)
    c, r = replicate(x, y, np.ones(len(y)))
    got = {v.feature: v.rank for v in catalog.queries()["selection_elimination"](spark, sf).collect()}
    assert [got[f] for f in range(64)] == sl.eliminated(c, r, 32)
    ids = spark.createDataFrame([(v[0],) for v in rows], "sample long")
    w = {v.sample: v.weights for v in sl.with_weights(ids, 20).collect()}
    w = np.array([w[v[0]] for v in rows])
    counts = np.zeros((len(sl.PATH), 64))
    for b in range(20):
        c, r = replicate(x, y, w[:, b])
        start = None
        for k, share in enumerate(sl.PATH):
            start = sl.lasso(c, r, share * np.abs(r).max(), start)
            counts[k] += np.abs(start) > 1e-6
    stable = {v.feature: v.frequency for v in catalog.queries()["selection_stability"](spark, sf).collect()}
    assert [stable[f] for f in range(64)] == pytest.approx((counts.max(axis=0) / 20).tolist(), abs=0.051)
    assert catalog.queries()["selection_stability"](spark, sf).where(F.col("frequency") > 0).count() > 0
