"""Tests that borrow strength across features: moderated t of empirical Bayes variances, and negative binomial fits with shrunken dispersions.

What is shared by all features (prior variance and its degrees of freedom, prior of the log dispersion) is estimated by moments in one
aggregation and is a handful of numbers. Features then stand for themselves: the t is an expression on one row a feature, a
negative binomial fit takes the samples of one feature at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.numeric import chi2_sf, normal_two_sided, t_p_value
from helixframe.operators.matrix import median_of_ratios
from helixframe.operators.statistics import adjust, two_group_moments

#: Terms of the series before the asymptotic expansion takes over.
_SHIFT = 8


def digamma(x: Column) -> Column:
    y = x + _SHIFT
    tail = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6)) + 1 / (240 * F.pow(y, 8))
    return tail - sum((1 / (x + k) for k in range(_SHIFT)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    y = x + _SHIFT
    tail = 1 / y + 1 / (2 * y * y) + 1 / (6 * F.pow(y, 3)) - 1 / (30 * F.pow(y, 5)) + 1 / (42 * F.pow(y, 7)) - 1 / (30 * F.pow(y, 9))
    return tail + sum((1 / ((x + k) * (x + k)) for k in range(_SHIFT)), F.lit(0.0))


def _polygamma(x: float) -> tuple[float, float]:
    """digamma and trigamma of a number."""
    psi = tri = 0.0
    while x < 20:
        psi, tri, x = psi - 1 / x, tri + 1 / (x * x), x + 1
    return psi + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6), tri + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def inverse_trigamma(value: float) -> float:
    """The x at which trigamma is `value`, by halving on its logarithm (trigamma falls)."""
    low, high = -20.0, 20.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _polygamma(10**middle)[1] > value else (low, middle)
    return 10**low


def prior_variance(variances: DataFrame, var: str = "var", df: str = "df") -> tuple[float, float]:
    """(prior variance, its degrees of freedom, infinite if variances do not vary more than chance) of rows with a sample variance above 0 and df above 0.

    Moments of the log variances: their mean and spread, less what the degrees of freedom account for.
    """
    half = F.col(df) / 2.0
    e = F.log(var) - digamma(half) + F.log(half)
    r = variances.where((F.col(var) > 0) & (F.col(df) > 0)).agg(F.avg(e).alias("m"), F.var_samp(e).alias("v"), F.avg(trigamma(half)).alias("t")).first()
    if r.m is None:
        return 0.0, 0.0
    spread = (r.v or 0.0) - r.t
    if spread <= 0:
        return math.exp(r.m), math.inf
    d0 = 2 * inverse_trigamma(spread)
    return math.exp(r.m + _polygamma(d0 / 2)[0] - math.log(d0 / 2)), d0


def moderated_t(moments: DataFrame, key: str = "feature") -> DataFrame:
    """Adds var_pooled, var_post, statistic (test minus reference), df_total, p_value and adjusted (Benjamini-Hochberg) to `two_group_moments`.

    Features whose groups leave no degree of freedom, or with no variance and no prior, have nulls. The degrees of freedom are those of the feature
    and the prior, at most those of all features together.
    """
    n1, n2 = F.col("n1"), F.col("n2")
    df = (n1 + n2 - 2).cast("double")
    part = lambda n, v: F.when(n > 1, (n - 1) * v).otherwise(0.0)
    rows = moments.withColumn("df", F.when((n1 > 0) & (n2 > 0) & (df > 0), df)).withColumn("var_pooled", (part(n1, F.col("var1")) + part(n2, F.col("var2"))) / F.col("df"))
    s0, d0 = prior_variance(rows.select(F.col("var_pooled").alias("var"), "df"))
    most = rows.agg(F.sum("df")).first()[0] or 0.0
    post = F.lit(s0) if math.isinf(d0) else (d0 * s0 + F.col("df") * F.col("var_pooled")) / (d0 + F.col("df"))
    rows = rows.withColumn("var_post", F.when(F.col("df").isNotNull() & (post > 0), post))
    rows = rows.withColumn("statistic", (F.col("mean2") - F.col("mean1")) / F.sqrt(F.col("var_post") * (1.0 / n1 + 1.0 / n2))).withColumn("df_total", F.when(F.col("statistic").isNotNull(), F.least(F.col("df") + F.lit(float(d0)), F.lit(float(most)))))
    return adjust(rows.withColumn("p_value", t_p_value("statistic", "df_total")), "fdr_bh", tie=key)


# --- negative binomial ------------------------------------------------------------------------------------------------

#: Dispersions outside are not looked for; the least spread of the prior of their logarithms; a group without counts has this many.
LOW, HIGH, LEAST_SPREAD, NO_COUNT = 1e-8, 1e3, 0.25, 0.5


def log_likelihood(y: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    """Of counts with means mu and variance mu + alpha mu^2."""
    r = 1 / alpha
    values, times = np.unique(y, return_counts=True)
    fixed = sum(t * (math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1)) for v, t in zip(values.tolist(), times.tolist()))
    return fixed + float((y * np.log(np.maximum(mu, 1e-300) * alpha / (1 + alpha * mu)) - r * np.log1p(alpha * mu)).sum())


def fitted_mean(y: np.ndarray, s: np.ndarray, alpha: float) -> float:
    """The mean of counts per unit of size, by the likelihood given the dispersion."""
    total = float(y.sum())
    if total == 0:
        return NO_COUNT / float(s.sum())
    m = total / float(s.sum())
    for _ in range(100):
        w = 1 / (1 + alpha * s * m)
        new = float((y * w).sum() / (s * w).sum())
        if abs(new - m) <= 1e-12 * m:
            break
        m = new
    return new


def fit(y: np.ndarray, s: np.ndarray, test: np.ndarray, centre: float, spread: float) -> dict:
    """Two groups' means, dispersion (largest posterior under a normal prior of its logarithm), Wald and likelihood-ratio statistics of one feature."""

    def means(alpha: float) -> tuple[float, float, np.ndarray]:
        a, b = (fitted_mean(y[test == t], s[test == t], alpha) for t in (False, True))
        return a, b, s * np.where(test, b, a)

    def loss(x: float) -> float:
        alpha = math.exp(x)
        return (x - centre) ** 2 / (2 * spread) - log_likelihood(y, means(alpha)[2], alpha)

    grid = np.linspace(math.log(LOW), math.log(HIGH), 26)
    at = int(np.argmin([loss(x) for x in grid]))
    low, high = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    golden = (math.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > 1e-7:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = loss(b)
    alpha = math.exp((low + high) / 2)
    m1, m2, mu = means(alpha)
    weight = mu / (1 + alpha * mu)
    error = math.sqrt(1 / weight[~test].sum() + 1 / weight[test].sum())
    same = fitted_mean(y, s, alpha)
    ratio = max(0.0, 2 * (log_likelihood(y, mu, alpha) - log_likelihood(y, s * same, alpha)))
    change = math.log(m2 / m1)
    return {"mean1": m1, "mean2": m2, "dispersion": alpha, "log2fc": change / math.log(2), "wald": change / error, "p_value": normal_two_sided(change / error), "lr": ratio, "p_lr": chi2_sf(ratio, 1)}


def dispersion_prior(counts: DataFrame, sizes: DataFrame, group: str, reference, test) -> tuple[float, float]:
    """Centre and variance of the log dispersions of all features by moments: pooled variance within groups of the counts per size, less what chance adds to it."""
    x = counts.join(sizes, "sample").select("feature", group, (F.col("value") / F.col("size_factor")).alias("value"), (1 / F.col("size_factor")).alias("inverse"))
    m = two_group_moments(x, group, reference, test).join(x.where(F.col(group).isin(reference, test)).groupBy("feature").agg(F.avg("value").alias("mean"), F.avg("inverse").alias("inverse")), "feature")
    n1, n2 = F.col("n1"), F.col("n2")
    df = n1 + n2 - 2
    var = ((n1 - 1) * F.coalesce("var1", F.lit(0.0)) + (n2 - 1) * F.coalesce("var2", F.lit(0.0))) / df
    alpha = (var - F.col("inverse") * F.col("mean")) / (F.col("mean") * F.col("mean"))
    r = m.where((df > 0) & (F.col("mean") > 0)).select(alpha.alias("a"), trigamma(df / 2.0).alias("t")).where((F.col("a") > LOW) & (F.col("a") < HIGH)).agg(F.avg(F.log("a")).alias("m"), F.var_samp(F.log("a")).alias("v"), F.avg("t").alias("t")).first()
    return (math.log(0.1), 1.0) if r.m is None else (r.m, max(LEAST_SPREAD, (r.v or 0.0) - r.t))


def negative_binomial(counts: DataFrame, group: str, reference, test, sizes: DataFrame | None = None) -> DataFrame:
    """(feature, mean1, mean2, dispersion, log2fc, wald, p_value, lr, p_lr, adjusted) of counts (sample, feature, group, value) in two groups.

    Zeros must be rows. Size factors (sample, size_factor) are medians of ratios unless given. Features without a sample in one of the groups
    or without any count are left out, null values count as no sample; a group with zeros alone counts as half a count.
    """
    rows = counts.where(F.col(group).isin(reference, test) & F.col("value").isNotNull()).select("sample", "feature", group, F.col("value").cast("double").alias("value"))
    sizes = median_of_ratios(rows) if sizes is None else sizes
    centre, spread = dispersion_prior(rows, sizes, group, reference, test)
    kind = counts.schema["feature"].dataType.simpleString()

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        y, s, t = frame["value"].to_numpy(np.float64), frame["size_factor"].to_numpy(np.float64), frame["test"].to_numpy(bool)
        if t.all() or not t.any() or not y.any():
            return pd.DataFrame({"feature": [], **{c: [] for c in ("mean1", "mean2", "dispersion", "log2fc", "wald", "p_value", "lr", "p_lr")}})
        return pd.DataFrame([{"feature": key[0], **fit(y, s, t, centre, spread)}])

    joined = rows.join(sizes.where("size_factor > 0"), "sample").select("feature", "value", "size_factor", (F.col(group) == test).alias("test"))
    found = joined.groupBy("feature").applyInPandas(one, f"feature {kind}, mean1 double, mean2 double, dispersion double, log2fc double, wald double, p_value double, lr double, p_lr double")
    return adjust(found, "fdr_bh")
