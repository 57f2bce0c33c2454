"""Survival analysis: Kaplan-Meier, log-rank, biomarker groups, Cox regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.numeric import chi2_p_value, normal_two_sided


def risk_table(df: DataFrame, *groups: str) -> DataFrame:
    """(groups, time, events, at_risk) of (groups, time, event): different times are counted first, then summed from the last."""
    counts = df.where("time IS NOT NULL").groupBy(*groups, "time").agg(F.sum(F.col("event").cast("long")).alias("events"), F.count("*").alias("leaving"))
    later = Window.partitionBy(*groups).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.sum("leaving").over(later))


def kaplan_meier(df: DataFrame, *groups: str) -> DataFrame:
    """(groups, time, events, at_risk, survival, std_error): product limit with Greenwood's error at the event times."""
    steps = risk_table(df, *groups).where("events > 0")
    run = Window.partitionBy(*groups).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("events") / F.col("at_risk")
    # once nobody is left the curve is 0 and stays so
    logs, over = F.sum(F.when(left > 0, F.log(left))).over(run), F.max((left <= 0).cast("int")).over(run)
    green = F.sum(F.when(left > 0, F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events"))))).over(run)
    rows = steps.withColumn("survival", F.when(over == 1, F.lit(0.0)).otherwise(F.exp(logs)))
    return rows.withColumn("std_error", F.when(over == 0, F.col("survival") * F.sqrt(green))).drop("leaving")


def median_survival(curve: DataFrame, *groups: str) -> DataFrame:
    """(groups, median): the first time at which half are left; null if never."""
    rows = curve.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))
    return rows


def logrank(df: DataFrame, group: str) -> DataFrame:
    """One row of two groups: observed, expected of the smaller group value, variance, chi-squared, p."""
    values = Window.partitionBy()
    rows = risk_table(df, group)
    low = F.broadcast(df.agg(F.min(group).alias("low")))
    each = rows.crossJoin(low).groupBy("time").agg(F.sum("events").alias("d"), F.sum("leaving").alias("c"), F.sum(F.when(F.col(group) == F.col("low"), F.col("events"))).alias("d1"), F.sum(F.when(F.col(group) == F.col("low"), F.col("leaving"))).alias("c1"))
    later = values.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    risk = each.fillna(0).withColumn("n", F.sum("c").over(later)).withColumn("n1", F.sum("c1").over(later)).where("d > 0")
    e, n, n1, d = F.col("d") * F.col("n1") / F.col("n"), F.col("n"), F.col("n1"), F.col("d")
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    total = risk.agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return total.withColumn("chi2", F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("variance"))).withColumn("p_value", chi2_p_value("chi2", F.lit(1.0)))


def logrank_groups(df: DataFrame, group: str) -> DataFrame:
    """(group, observed, expected, n) of any number of groups: events and their expectation under one common hazard."""
    total = risk_table(df).select("time", F.col("events").alias("d"), F.col("at_risk").alias("n")).where("d > 0").withColumn("h", F.col("d") / F.col("n"))
    hazard = total.withColumn("cum", F.sum("h").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))).select("time", "cum")
    # a subject's expectation is the cumulated hazard at its time: that of the last event time not after it; equal times are one row
    own = df.groupBy(group, "time").agg(F.sum(F.col("event").cast("long")).alias("event"), F.count("*").alias("c"))
    marks = own.unionByName(hazard, allowMissingColumns=True)
    order = Window.orderBy("time", F.col("cum").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("e", F.last("cum", True).over(order)).where("c IS NOT NULL")
    return rows.groupBy(group).agg(F.sum("event").alias("observed"), F.sum(F.coalesce("e", F.lit(0.0)) * F.col("c")).alias("expected"), F.sum("c").alias("n"))


def cutoff_groups(df: DataFrame, biomarker: str, how: str = "median", fixed: float | None = None) -> DataFrame:
    """Adds `level` (low, high; with tertile and quartile also a middle) by the biomarker's cutoff over all rows."""
    b = F.col(biomarker)
    if how in ("tertile", "quartile"):
        low, high = (1 / 3, 2 / 3) if how == "tertile" else (0.25, 0.75)
        cuts = df.agg(F.percentile(b, F.lit(low)).alias("__l"), F.percentile(b, F.lit(high)).alias("__h"))
        level = F.when(b <= F.col("__l"), "low").when(b > F.col("__h"), "high").otherwise("middle")
    else:
        cut = {"median": F.percentile(b, F.lit(0.5)), "mean": F.avg(b)}[how] if fixed is None else F.first(F.lit(float(fixed)))
        cuts = df.agg(cut.alias("__l"), F.lit(0).alias("__h"))
        level = F.when(b > F.col("__l"), "high").otherwise("low")
    return df.crossJoin(F.broadcast(cuts)).withColumn("level", F.when(b.isNotNull(), level)).drop("__l", "__h")


def cox_fit(time: np.ndarray, event: np.ndarray, x: np.ndarray, penalty: float = 0.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of a proportional hazards model, Efron's ties, by Newton's method."""
    order = np.argsort(-time, kind="stable")
    time, event, x = time[order], event[order].astype(bool), x[order] - x.mean(axis=0)
    beta, ends = np.zeros(x.shape[1]), np.r_[np.flatnonzero(np.diff(time)) + 1, len(time)]
    for _ in range(rounds):
        w = np.exp(np.clip(x @ beta, -50, 50))
        s0 = s1 = s2 = 0.0
        gradient, hessian, start = -penalty * beta, penalty * np.eye(len(beta)), 0
        for end in ends:
            xi, wi, dead = x[start:end], w[start:end], event[start:end]
            s0, s1, s2 = s0 + wi.sum(), s1 + wi @ xi, s2 + (xi * wi[:, None]).T @ xi
            xd, wd = xi[dead], wi[dead]
            t0, t1, t2 = wd.sum(), wd @ xd, (xd * wd[:, None]).T @ xd
            gradient = gradient + xd.sum(axis=0)
            for k in range(len(wd)):
                part = k / len(wd)
                a0, a1, a2 = s0 - part * t0, s1 - part * t1, s2 - part * t2
                gradient, hessian = gradient - a1 / a0, hessian + a2 / a0 - np.outer(a1, a1) / a0**2
            start = end
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0))


def cox(df: DataFrame, key: str, covariates: list[str], penalty: float = 0.0) -> DataFrame:
    """(key, covariate, coefficient, hazard_ratio, std_error, z, p_value) for the rows (key, time, event, covariates) of each key.

    A key's subjects are fitted in one task, as in a screen of biomarkers over a cohort.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna()
        beta, error = cox_fit(rows["time"].to_numpy(float), rows["event"].to_numpy(), rows[covariates].to_numpy(float), penalty) if len(rows) > len(covariates) and rows["event"].any() else (np.full(len(covariates), np.nan),) * 2
        z = np.divide(beta, error, out=np.full(len(beta), np.nan), where=error > 0)
        return pd.DataFrame({key: rows[key].iloc[0] if len(rows) else None, "covariate": covariates, "coefficient": beta, "hazard_ratio": np.exp(beta), "std_error": error, "z": z, "p_value": [normal_two_sided(v) if v == v else None for v in z]})

    return df.select(key, "time", "event", *covariates).groupBy(key).applyInPandas(fit, f"{key} {dict(df.dtypes)[key]}, covariate string, coefficient double, hazard_ratio double, std_error double, z double, p_value double")
