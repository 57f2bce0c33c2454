"""Moderated t and negative binomial fits against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.operators import moderated as md
from helixframe.operators.statistics import two_group_moments

EULER = 0.5772156649015329


def test_gamma_functions(spark):
    x = [0.5, 1.0, 2.0, 3.5, 10.0, 250.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(md.digamma(F.col("x")).alias("p"), md.trigamma(F.col("x")).alias("t")).collect()
    assert got[1].p == pytest.approx(-EULER, abs=1e-10) and got[0].p == pytest.approx(-EULER - 2 * math.log(2), abs=1e-9) and got[2].p == pytest.approx(1 - EULER, abs=1e-10)
    assert got[1].t == pytest.approx(math.pi**2 / 6, abs=1e-9) and got[0].t == pytest.approx(math.pi**2 / 2, abs=1e-9)
    assert all(md._polygamma(v) == pytest.approx((r.p, r.t), abs=1e-9) for v, r in zip(x, got))
    assert all(md.inverse_trigamma(md._polygamma(v)[1]) == pytest.approx(v, rel=1e-6) for v in x)


def test_prior_is_found_again_and_t_is_the_closed_form(spark):
    rng = np.random.default_rng(2)
    n, d0, s0, df = 4000, 8.0, 0.5, 6
    variances = s0 * d0 / rng.chisquare(d0, n)
    rows = [(int(f), k, g, float(rng.normal(1.0 if f < 40 and g else 0.0, math.sqrt(variances[f])))) for f in range(n) for k in range(8) for g in (k % 2,)]
    long = spark.createDataFrame(rows, "feature long, sample long, grp long, value double")
    m = two_group_moments(long, "grp", 0, 1)
    got = {r.feature: r for r in md.moderated_t(m).collect()}
    s2 = {f: r.var_pooled for f, r in got.items()}
    prior, freedom = md.prior_variance(spark.createDataFrame([(v, float(df)) for v in s2.values()], "var double, df double"))
    assert prior == pytest.approx(s0, rel=0.08) and freedom == pytest.approx(d0, rel=0.25)
    for f in range(0, n, 97):
        x, y = ([v for a, _, g, v in rows if a == f and g == w] for w in (0, 1))
        pooled = (np.var(x) * 4 + np.var(y) * 4) / df
        post = (freedom * prior + df * pooled) / (freedom + df)
        t = (np.mean(y) - np.mean(x)) / math.sqrt(post * 0.5)
        assert (got[f].var_pooled, got[f].statistic, got[f].df_total) == pytest.approx((pooled, t, df + freedom), rel=1e-6)
    same = spark.createDataFrame([(1, 3, 3, 1.0, 2.0, 1.0, 1.0), (2, 3, 3, 1.0, 2.0, 1.0, 1.0), (3, 1, 1, 1.0, 2.0, None, None), (4, 3, 0, 1.0, None, 1.0, None)], "feature long, n1 long, n2 long, mean1 double, mean2 double, var1 double, var2 double")
    rows = {r.feature: r for r in md.moderated_t(same).collect()}
    assert rows[1].df_total == 8 and rows[3].p_value is None and rows[4].statistic is None and len(rows) == 4


def test_fit_is_the_brute_force_maximum():
    rng = np.random.default_rng(3)
    for _ in range(4):
        s, t = rng.uniform(0.5, 2, 14), np.arange(14) % 2 == 1
        y = rng.poisson(rng.gamma(2, 10, 14) * s * np.where(t, 2.0, 1.0)).astype(float)
        got = md.fit(y, s, t, math.log(0.3), 1.0)

        def posterior(a, b, x):
            return md.log_likelihood(y, s * np.where(t, b, a), math.exp(x)) - (x - math.log(0.3)) ** 2 / 2

        best = posterior(got["mean1"], got["mean2"], math.log(got["dispersion"]))
        for da in (0.98, 1, 1.02):
            for db in (0.98, 1, 1.02):
                for dx in (-0.05, 0, 0.05):
                    assert posterior(got["mean1"] * da, got["mean2"] * db, math.log(got["dispersion"]) + dx) <= best + 1e-9
        assert md.log_likelihood(np.array([3.0]), np.array([2.0]), 1e-8) == pytest.approx(-2 + 3 * math.log(2) - math.log(6), abs=1e-4)
        assert got["lr"] == pytest.approx(got["wald"] ** 2, rel=0.5, abs=0.5)


def test_planted_changes_are_found(spark):
    rng = np.random.default_rng(4)
    size = rng.uniform(0.6, 1.6, 12)
    rows = []
    for f in range(120):
        base = rng.uniform(20, 200)
        for k in range(12):
            mean = base * size[k] * (4 if f < 12 and k % 2 else 1)
            rows.append((k, f, k % 2, int(rng.poisson(rng.gamma(10, mean / 10)))))
    rows += [(k, 500, k % 2, 0) for k in range(12)] + [(k, 501, 0, 5) for k in range(6)] + [(0, 502, 0, None)] + [(k, 503, k % 2, 0 if k % 2 else 40) for k in range(12)]
    df = spark.createDataFrame(rows, "sample long, feature long, grp long, value long")
    got = {r.feature: r for r in md.negative_binomial(df, "grp", 0, 1, spark.createDataFrame([(k, float(v)) for k, v in enumerate(size)], "sample long, size_factor double")).collect()}
    assert set(got) == set(range(120)) | {503}
    assert all(got[f].adjusted < 0.01 and got[f].log2fc == pytest.approx(2, abs=0.9) for f in range(12)) and got[503].log2fc < -5
    assert sum(got[f].adjusted < 0.05 for f in range(12, 120)) <= 6 and np.median([got[f].dispersion for f in range(120)]) == pytest.approx(0.1, rel=0.5)


def test_the_query_is_each_features_own_fit(spark):
    sf = "/root/testdata/sf0.001"
    counts = [(r.vec_id, f, int(abs(v) * 100), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() for f, v in enumerate(r.embedding)]
    size = {}
    for i, _, y, _ in counts:
        size[i] = size.get(i, 0) + y / 500
    got = {r.feature: r for r in catalog.queries()["de_negative_binomial"](spark, sf).collect()}
    assert len(got) == 64
    for f in (0, 17, 63):
        own = [(y, size[i], g == 1) for i, a, y, g in counts if a == f and g in (0, 1) and size[i] > 0]
        y, s, t = (np.array(x) for x in zip(*own))
        y = y.astype(float)
        best = md.log_likelihood(y, s * np.where(t, got[f].mean2, got[f].mean1), got[f].dispersion)
        for da, db in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)):
            assert md.log_likelihood(y, s * np.where(t, got[f].mean2 * db, got[f].mean1 * da), got[f].dispersion) < best
        assert got[f].log2fc == pytest.approx(math.log2(got[f].mean2 / got[f].mean1), abs=1e-4)
