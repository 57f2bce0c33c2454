"""Several matrices of the same samples: alignment, early, intermediate and late fusion, similarity network fusion, models."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.fusion import fused_network
from helixframe.operators.graph import settled
from helixframe.operators.matrix import zscore


def align_samples(datasets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each matrix restricted to the samples that all have."""
    common = reduce(lambda a, b: a.join(b, "sample", "left_semi"), [d.select("sample").distinct() for d in datasets.values()])
    return {name: d.join(common, "sample", "left_semi") for name, d in datasets.items()}


def early_fusion(datasets: dict[str, DataFrame], scale: bool = True) -> DataFrame:
    """One long matrix (sample, block, feature, value) over common samples; features are prefixed with their block."""
    parts = []
    for name, d in align_samples(datasets).items():
        d = zscore(d.select("sample", "feature", "value")) if scale else d
        parts.append(d.select("sample", F.lit(name).alias("block"), F.concat(F.lit(f"{name}:"), F.col("feature").cast("string")).alias("feature"), "value"))
    return reduce(DataFrame.unionAll, parts)


def variance_shares(fused: DataFrame) -> DataFrame:
    """(block, share): each block's part of the summed variances; equal parts if nothing varies."""
    per = fused.groupBy("block", "feature").agg(F.var_pop("value").alias("v")).groupBy("block").agg(F.sum("v").alias("v"))
    every = Window.partitionBy()
    return per.select("block", F.when(F.sum("v").over(every) > 0, F.col("v") / F.sum("v").over(every)).otherwise(1.0 / F.count("*").over(every)).alias("share"))


def merge_tables(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Joins tables by their index column: inner, outer, left or right."""
    return a.join(b, on, how)


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def vectors(long: DataFrame) -> DataFrame:
    """(sample, features) as vectors in feature order."""
    return long.groupBy("sample").agg(array_to_vector(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"])).alias("features"))


def pca(rows: DataFrame, k: int, scale: bool = True) -> tuple[DataFrame, list[float]]:
    """(sample, scores) and the explained variance ratios of (sample, features)."""
    stages = ([StandardScaler(inputCol="features", outputCol="scaled", withMean=True)] if scale else []) + [PCA(k=k, inputCol="scaled" if scale else "features", outputCol="pcs")]
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(rows).select("sample", vector_to_array("pcs").alias("scores")), model.stages[-1].explainedVariance.toArray().tolist()


def late_fusion(datasets: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """(sample, scores): the blocks' own principal scores one after the other."""
    parts = [pca(vectors(d.select("sample", "feature", "value")), k)[0].withColumnRenamed("scores", name) for name, d in align_samples(datasets).items()]
    joined = reduce(lambda a, b: a.join(b, "sample"), parts)
    return joined.select("sample", F.concat(*datasets).alias("scores"))


def fuse_predictions(predictions: DataFrame, how: str = "mean") -> DataFrame:
    """(sample, value) of (sample, model, value, weight): weighted mean, max, or the commonest value (smallest of equals)."""
    value = {"mean": F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), "max": F.max("value"), "vote": F.mode("value", True)}[how]
    return predictions.groupBy("sample").agg(value.alias("value"))


def cluster(rows: DataFrame, k: int, seed: int = 42, column: str = "features") -> DataFrame:
    """(sample, cluster) by k-means."""
    return KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster").fit(rows).transform(rows).select("sample", "cluster")


def affinity(x: np.ndarray) -> np.ndarray:
    """Gaussian of the euclidean distances, as wide as their mean; zero on the diagonal."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
    sigma = d[~np.eye(len(d), dtype=bool)].mean() if len(d) > 1 else 1.0
    w = np.exp(-(d**2) / (2 * sigma**2 or 1.0))
    np.fill_diagonal(w, 0)
    return w


def _kernel(w: np.ndarray, k: int) -> np.ndarray:
    """Rows over each sample's k strongest partners (never itself), summing to one."""
    s = np.zeros_like(w)
    for i, row in enumerate(w):
        near = [j for j in np.argsort(-row, kind="stable") if j != i][:k]
        s[i, near] = row[near]
    return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)


def snf(blocks: list[np.ndarray], k: int = 20, rounds: int = 20) -> np.ndarray:
    """Similarity network fusion: every block's network diffuses through the mean of the others."""
    full = [w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300) for w in map(affinity, blocks)]
    local = [_kernel(w, k) for w in map(affinity, blocks)]
    for _ in range(rounds):
        total = sum(full)
        full = [s @ ((total - p) / max(1, len(full) - 1)) @ s.T for s, p in zip(local, full)]
        full = [p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300) for p in full]
    fused = sum(full) / len(full)
    return (fused + fused.T) / 2


def similarity_network(fused: DataFrame, cohort: str | None = None, k: int = 20, rounds: int = 20, most: int = 1000) -> DataFrame:
    """(cohort, src, dst, weight) of an early-fused matrix: all links between the samples of each cohort.

    A cohort of up to `most` samples is fused in one task, cohorts side by side; a larger one in blocks (`fusion`), with the same result.
    """
    rows = fused.withColumn("cohort", F.col(cohort).cast("string") if cohort else F.lit("all")).select("cohort", "sample", "block", "feature", "value")
    sizes = settled(rows.groupBy("cohort").agg(F.count_distinct("sample").alias("n")))

    def fuse(part: pd.DataFrame) -> pd.DataFrame:
        samples = np.sort(part["sample"].unique())
        blocks = [b.pivot(index="sample", columns="feature", values="value").reindex(samples).fillna(0).to_numpy() for _, b in part.groupby("block")]
        w = snf(blocks, min(k, max(1, len(samples) - 1)), rounds)
        i, j = np.nonzero(np.triu(w, 1) > 0)
        return pd.DataFrame({"cohort": part["cohort"].iloc[0], "src": samples[i], "dst": samples[j], "weight": w[i, j]})

    kind = dict(fused.dtypes)["sample"]
    small = rows.join(sizes.where(F.col("n") <= most).select("cohort"), "cohort", "left_semi").groupBy("cohort").applyInPandas(fuse, f"cohort string, src {kind}, dst {kind}, weight double")
    large = sizes.where(F.col("n") > most).select("cohort")
    if not large.limit(1).count():
        return small
    return small.unionByName(fused_network(rows.join(large, "cohort", "left_semi"), k, rounds))


def spectral_coordinates(w: np.ndarray, k: int = 2) -> np.ndarray:
    """Eigenvectors 2 to k + 1 of the normalised affinity, the sign such that each one's largest entry is positive."""
    d = 1 / np.sqrt(np.maximum(w.sum(axis=1), 1e-300))
    _, vectors_ = np.linalg.eigh(w * d[:, None] * d[None, :])
    found = vectors_[:, ::-1][:, 1 : k + 1]
    return found * np.sign(found[np.abs(found).argmax(axis=0), range(found.shape[1])])


# --- models ---------------------------------------------------------------------------------------------------------

MODELS = {
    ("random_forest", "classification"): RandomForestClassifier, ("random_forest", "regression"): RandomForestRegressor, ("gradient_boosting", "classification"): GBTClassifier, ("gradient_boosting", "regression"): GBTRegressor,
    ("svm", "classification"): LinearSVC, ("logistic_regression", "classification"): LogisticRegression, ("elastic_net", "regression"): LinearRegression, ("lasso", "regression"): LinearRegression,
}


def get_model(name: str, task: str = "classification", **params):
    """An unfitted model by name; xgboost and lightgbm stand for gradient boosting."""
    name = {"xgboost": "gradient_boosting", "lightgbm": "gradient_boosting"}.get(name, name)
    if (name, task) not in MODELS:
        raise ValueError(f"no model {name!r} for {task}")
    if name == "lasso":
        params = {"elasticNetParam": 1.0, "regParam": 0.01} | params
    if name == "elastic_net":
        params = {"elasticNetParam": 0.5, "regParam": 0.01} | params
    if name in ("random_forest", "gradient_boosting"):
        params = {"seed": 42} | params
    return MODELS[name, task](featuresCol="features", labelCol="label", **params)


def stratified_folds(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: rows of each label dealt out evenly in a seeded order."""
    order = F.xxhash64("sample", F.lit(seed))
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy("label").orderBy(order, "sample")) - 1) % k)


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1 of (label, prediction), from the confusion table."""
    cells = predictions.groupBy(F.col("label").cast("double").alias("l"), F.col("prediction").cast("double").alias("p")).agg(F.count("*").alias("n"))
    truth = cells.groupBy(F.col("l").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    given = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("given"))
    rows = truth.join(given, "c", "left").fillna(0, ["given"])
    precision = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return rows.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *((F.sum(x * F.col("support")) / F.sum("support")).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1))))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    e = F.col("label") - F.col("prediction")
    rows = predictions.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("label").alias("v"))
    return rows.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


def roc_auc(predictions: DataFrame, score: str = "score") -> DataFrame:
    """One row: area under the ROC curve of (label 0/1, score), ties half, by ranks of different scores."""
    values = predictions.groupBy(score).agg(F.count("*").alias("t"), F.sum("label").alias("p"))
    below = F.coalesce(F.sum("t").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = values.withColumn("r", below + (F.col("t") + 1) / 2).agg(F.sum(F.col("r") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("t").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def train_with_cv(rows: DataFrame, name: str, k: int = 5, **params) -> DataFrame:
    """(fold, accuracy, precision, recall, f1) of a classifier over stratified folds of (sample, label, features)."""
    folds = stratified_folds(rows, k)
    parts = []
    for fold in range(k):
        model = get_model(name, **params).fit(folds.where(F.col("fold") != fold))
        parts.append(classification_metrics(model.transform(folds.where(F.col("fold") == fold))).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionAll, parts)


def importances(rows: DataFrame, name: str = "random_forest", **params) -> DataFrame:
    """(feature, importance) of a fitted model, largest first."""
    model = get_model(name, **params).fit(rows)
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    data = [(i, abs(float(v))) for i, v in enumerate(values.toArray())]  # one number a feature
    return rows.sparkSession.createDataFrame(data, "feature long, importance double").orderBy(F.desc("importance"), "feature")


# --- features of samples ---------------------------------------------------------------------------------------------


def statistical_features(long: DataFrame) -> DataFrame:
    """Moments and quantiles of each sample (deviations with ddof 0)."""
    v = F.col("value")
    rows = long.groupBy("sample").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), *(F.percentile(v, F.lit(q / 100)).alias(f"p{q}") for q in (1, 5, 25, 50, 75, 95, 99)),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
    )
    return rows.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25"), "cv": F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))})


def interaction_features(long: DataFrame, features: int = 100, keep: int = 50) -> DataFrame:
    """(a, b, variance) of products of feature pairs a < b among the most varying features, the `keep` most varying products."""
    top = long.groupBy("feature").agg(F.var_pop("value").alias("v")).orderBy(F.desc("v"), "feature").limit(features).select("feature")
    rows = long.join(F.broadcast(top), "feature", "left_semi").select("sample", "feature", "value")
    pairs = rows.select("sample", F.col("feature").alias("a"), F.col("value").alias("x")).join(rows.select("sample", F.col("feature").alias("b"), F.col("value").alias("y")), "sample").where("a < b")
    return pairs.groupBy("a", "b").agg(F.var_pop(F.col("x") * F.col("y")).alias("variance")).orderBy(F.desc("variance"), "a", "b").limit(keep)


def univariate_scores(long: DataFrame, group: str) -> DataFrame:
    """(feature, f): the ANOVA F of each feature."""
    from helixframe.operators.statistics import anova

    return anova(long, group).select("feature", "f")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least squares with coefficients that are not negative (active sets)."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        free = ~passive & (w > 1e-10)
        if not free.any():
            break
        passive[np.argmax(np.where(free, w, -np.inf))] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                break
            low = passive & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
        x = s
    return x


def deconvolve(long: DataFrame, basis: dict[str, dict], key: str = "sample") -> DataFrame:
    """(sample, cell_type, fraction): a sample as a mixture of cell types with known markers {type: {feature: value}}; a sample a fit."""
    types = sorted(basis)
    features = sorted({f for of in basis.values() for f in of}, key=str)
    matrix = np.array([[float(basis[t].get(f, 0.0)) for t in types] for f in features])
    kind = dict(long.dtypes)[key]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(rows["feature"], rows["value"]))
        x = nnls(matrix, np.array([float(own.get(f, 0.0) or 0.0) for f in features]))
        return pd.DataFrame({key: rows[key].iloc[0], "cell_type": types, "fraction": x / x.sum() if x.sum() > 0 else x})

    return long.select(key, "feature", "value").groupBy(key).applyInPandas(fit, f"{key} {kind}, cell_type string, fraction double")
