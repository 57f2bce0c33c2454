"""Matrices of samples by features in long form (sample, feature, value): shape, filters, imputation, normalisation, quality.

Values may be null (missing). Statistics of a feature or sample are aggregated (partially before the shuffle) and joined
back, so a feature with very many samples never has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.numeric import nan_to_null, probit


def from_arrays(df: DataFrame, sample: str, values: str, *others: str) -> DataFrame:
    """One row per array element; the element's place is the feature."""
    return df.select(F.col(sample).alias("sample"), *others, F.posexplode(values).alias("feature", "value")).withColumn("value", nan_to_null(F.col("value").cast("double")))


def melt(df: DataFrame, sample: str, features: list[str]) -> DataFrame:
    """Columns to long form."""
    return df.unpivot([sample], features, "feature", "value").withColumnRenamed(sample, "sample").withColumn("value", nan_to_null(F.col("value").cast("double")))


def to_arrays(long: DataFrame) -> DataFrame:
    """(sample, values): values in feature order; only for as many features as one row can hold."""
    return long.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"]).alias("values"))


def transpose(long: DataFrame) -> DataFrame:
    return long.select(F.col("feature").alias("sample"), F.col("sample").alias("feature"), "value")


def with_stats(long: DataFrame, keys: str | list[str], **aggregates: Column) -> DataFrame:
    """Joins statistics of each key to the rows."""
    keys = [keys] if isinstance(keys, str) else keys
    return long.join(long.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items())), keys)


def overall(long: DataFrame, **aggregates: Column) -> DataFrame:
    """Joins statistics of all rows: one row, whatever the table's size."""
    return long.crossJoin(F.broadcast(long.agg(*(c.alias(n) for n, c in aggregates.items()))))


def median(column) -> Column:
    return F.percentile(column, F.lit(0.5))


# --- filters --------------------------------------------------------------------------------------------------------


def keep_features(long: DataFrame, condition: Column) -> DataFrame:
    """Features for which an aggregate condition holds."""
    return long.join(long.groupBy("feature").agg(condition.alias("keep")).where("keep").select("feature"), "feature", "left_semi")


def keep_samples(long: DataFrame, condition: Column) -> DataFrame:
    return long.join(long.groupBy("sample").agg(condition.alias("keep")).where("keep").select("sample"), "sample", "left_semi")


def min_count_filter(long: DataFrame, min_count: float = 10, min_samples: int = 3) -> DataFrame:
    """Features with at least `min_samples` values above `min_count`."""
    return keep_features(long, F.count_if(F.col("value") > min_count) >= min_samples)


def missing_filter(long: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Features whose share of missing values is at most `max_missing`."""
    return keep_features(long, F.avg(F.col("value").isNull().cast("double")) <= max_missing)


def variance_filter(long: DataFrame, min_variance: float = 0.01) -> DataFrame:
    return keep_features(long, F.var_samp("value") >= min_variance)


def prevalence_filter(long: DataFrame, min_prevalence: float = 0.1) -> DataFrame:
    """Features that are positive in at least that share of samples."""
    return keep_features(long, F.avg((F.col("value") > 0).cast("double")) >= min_prevalence)


def cell_gene_filter(long: DataFrame, min_genes: int = 200, min_cells: int = 3) -> DataFrame:
    """Cells with enough genes and genes in enough cells, both counted on the unfiltered matrix."""
    cells = long.groupBy("sample").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_genes).select("sample")
    genes = long.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_cells).select("feature")
    return long.join(cells, "sample", "left_semi").join(genes, "feature", "left_semi")


def spot_filter(long: DataFrame, min_spot: float = 100, min_gene: float = 10) -> DataFrame:
    """Spots and genes by their sums on the unfiltered matrix."""
    spots = long.groupBy("sample").agg(F.sum("value").alias("n")).where(F.col("n") > min_spot).select("sample")
    genes = long.groupBy("feature").agg(F.sum("value").alias("n")).where(F.col("n") > min_gene).select("feature")
    return long.join(spots, "sample", "left_semi").join(genes, "feature", "left_semi")


def variance_percentile_filter(long: DataFrame, share: float = 0.1) -> DataFrame:
    """Features whose variance exceeds the given percentile of all features' variances."""
    variances = long.groupBy("feature").agg(F.var_samp("value").alias("v"))
    cut = F.broadcast(variances.agg(F.percentile("v", F.lit(share)).alias("cut")))
    return long.join(variances.crossJoin(cut).where("v > cut").select("feature"), "feature", "left_semi")


def threshold_filter(df: DataFrame, **minimum: float) -> DataFrame:
    """Rows whose columns reach the given minima; columns that the table lacks are not asked for."""
    for name, least in minimum.items():
        if name in df.columns:
            df = df.where(F.col(name) >= least)
    return df


# --- imputation -----------------------------------------------------------------------------------------------------


def impute(long: DataFrame, method: str = "min") -> DataFrame:
    """Fills missing values: min (of all values), half_min (of the feature), mean, median (of the feature) or zero."""
    if method == "zero":
        return long.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if method == "min":
        return overall(long, fill=F.min("value")).withColumn("value", F.coalesce("value", "fill")).drop("fill")
    fill = {"half_min": F.min("value") / 2, "mean": F.avg("value"), "median": median("value")}[method]
    return with_stats(long, "feature", fill=fill).withColumn("value", F.coalesce("value", "fill")).drop("fill")


# --- normalisation --------------------------------------------------------------------------------------------------


def _by_sample_sum(long: DataFrame, scale: float) -> DataFrame:
    return with_stats(long, "sample", s=F.sum("value")).withColumn("value", F.when(F.col("s") != 0, F.col("value") / F.col("s") * scale).otherwise(F.lit(0.0))).drop("s")


def _scaled(long: DataFrame, key: str, center: Column, spread: Column, zero: float = 0.0) -> DataFrame:
    return with_stats(long, key, c=center, s=spread).withColumn("value", F.when(F.col("s") > 0, (F.col("value") - F.col("c")) / F.col("s")).otherwise(F.when(F.col("value").isNotNull(), F.lit(zero)))).drop("c", "s")


def cpm(long: DataFrame) -> DataFrame:
    """Share of the sample's sum, times a million (also offered as tpm, rpkm and internal standard, which here know no lengths)."""
    return _by_sample_sum(long, 1e6)


def relative(long: DataFrame) -> DataFrame:
    return _by_sample_sum(long, 1.0)


def log_transform(long: DataFrame, base: float = 2.0) -> DataFrame:
    """log(x + 1); a negative minimum of all values is shifted to zero first."""
    shifted = overall(long, m=F.min("value")).withColumn("value", F.col("value") - F.least("m", F.lit(0.0))).drop("m")
    return shifted.withColumn("value", F.log(float(base), F.col("value") + 1))


def sqrt_transform(long: DataFrame) -> DataFrame:
    """Simple variance stabilisation: the root of x + 1."""
    return long.withColumn("value", F.sqrt(F.col("value") + 1))


def zscore(long: DataFrame, ddof: int = 0) -> DataFrame:
    return _scaled(long, "feature", F.avg("value"), (F.stddev_samp if ddof else F.stddev_pop)("value"))


def minmax(long: DataFrame) -> DataFrame:
    return _scaled(long, "feature", F.min("value"), F.max("value") - F.min("value"))


def robust(long: DataFrame) -> DataFrame:
    """Distance from the feature's median in interquartile ranges."""
    return _scaled(long, "feature", median("value"), F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25)))


def pareto(long: DataFrame) -> DataFrame:
    return _scaled(long, "feature", F.avg("value"), F.sqrt(F.stddev_samp("value")))


def median_center(long: DataFrame) -> DataFrame:
    return with_stats(long, "sample", m=median("value")).withColumn("value", F.col("value") - F.col("m")).drop("m")


def median_scale(long: DataFrame) -> DataFrame:
    """Brings every sample's median to the median of all samples' medians."""
    medians = long.groupBy("sample").agg(median("value").alias("m"))
    target = F.broadcast(medians.agg(median("m").alias("target")))
    return long.join(medians, "sample").crossJoin(target).withColumn("value", F.when(F.col("m") != 0, F.col("value") * F.col("target") / F.col("m")).otherwise(F.col("value"))).drop("m", "target")


def library_scale(long: DataFrame, log1p: bool = False) -> DataFrame:
    """Divides by the sample's sum over the median of all samples' sums (simplified tmm; with log1p single-cell log-normalisation)."""
    sums = long.groupBy("sample").agg(F.sum("value").alias("s"))
    target = F.broadcast(sums.agg(median("s").alias("target")))
    scaled = F.when(F.col("s") > 0, F.col("value") / (F.col("s") / F.col("target"))).otherwise(F.lit(0.0))
    return long.join(sums, "sample").crossJoin(target).withColumn("value", F.log1p(scaled) if log1p else scaled).drop("s", "target")


def geometric_size_factors(long: DataFrame) -> DataFrame:
    """(sample, size_factor): exp of the mean log(x + 1), relative to the mean over samples."""
    logs = long.groupBy("sample").agg(F.exp(F.avg(F.log1p("value"))).alias("g"))
    return logs.crossJoin(F.broadcast(logs.agg(F.avg("g").alias("m")))).select("sample", (F.col("g") / F.col("m")).alias("size_factor"))


def median_of_ratios(long: DataFrame) -> DataFrame:
    """(sample, size_factor): median over features, positive in all samples, of value over the feature's geometric mean."""
    reference = long.groupBy("feature").agg(F.avg(F.when(F.col("value") > 0, F.log("value"))).alias("g"), F.min("value").alias("least")).where("least > 0").select("feature", "g")
    return long.join(reference, "feature").groupBy("sample").agg(median(F.exp(F.log("value") - F.col("g"))).alias("size_factor"))


def pqn(long: DataFrame) -> DataFrame:
    """Probabilistic quotients: sum-normalised values over the sample's median quotient to the features' medians."""
    shares = relative(long)
    quotients = with_stats(shares, "feature", ref=median("value")).withColumn("q", F.when(F.col("ref") > 0, F.col("value") / F.col("ref")))
    return with_stats(quotients, "sample", m=median("q")).withColumn("value", F.when(F.col("m") > 0, F.col("value") / F.col("m")).otherwise(F.col("value"))).drop("ref", "q", "m")


def clr(long: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """Centred log-ratio of value + pseudocount within the sample."""
    logs = long.withColumn("value", F.log(F.col("value") + pseudocount))
    return with_stats(logs, "sample", m=F.avg("value")).withColumn("value", F.col("value") - F.col("m")).drop("m")


def rarefied(long: DataFrame) -> DataFrame:
    """Scales every sample to the smallest sample sum (no sampling)."""
    sums = long.groupBy("sample").agg(F.sum("value").alias("s"))
    least = F.broadcast(sums.agg(F.min("s").alias("least")))
    return long.join(sums, "sample").crossJoin(least).withColumn("value", F.when(F.col("s") > 0, F.col("value") * F.col("least") / F.col("s")).otherwise(F.lit(0.0))).drop("s", "least")


def arcsinh(long: DataFrame, cofactor: float = 5.0) -> DataFrame:
    return long.withColumn("value", F.asinh(F.col("value") / cofactor))


def ranked(long: DataFrame, key: str = "feature") -> DataFrame:
    """Adds rank_first, rank_min, rank_avg of the values within the key (missing values have none)."""
    order = Window.partitionBy(key).orderBy("value")
    some = long.where("value IS NOT NULL")
    ties = F.count("*").over(Window.partitionBy(key, "value"))
    return some.withColumn("rank_first", F.row_number().over(order.orderBy("value", "sample" if key == "feature" else "feature"))).withColumn("rank_min", F.rank().over(order)).withColumn("rank_avg", F.col("rank_min") + (ties - 1) / 2)


def quantile_normalize(long: DataFrame) -> DataFrame:
    """Each value becomes the mean, over features, of the values at its rank (smallest rank of ties) within the feature."""
    rows = ranked(long)
    means = rows.groupBy(F.col("rank_first").alias("rank_min")).agg(F.avg("value").alias("mean"))
    return rows.join(means, "rank_min").select(*[c for c in long.columns if c != "value"], F.col("mean").alias("value"))


def rank_normal(long: DataFrame) -> DataFrame:
    """Values to normal scores of their average rank within the feature, after clipping to 0..1 (simplified bmiq)."""
    rows = ranked(long.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value"))))
    n = F.count("*").over(Window.partitionBy("feature"))
    return rows.withColumn("p", (F.col("rank_avg") - 0.5) / n).withColumn("value", probit("p")).drop("p", "rank_first", "rank_min", "rank_avg")


def vsn(long: DataFrame) -> DataFrame:
    """log2(x + 1), then z-scores (simplified variance-stabilising normalisation)."""
    return zscore(log_transform(long, 2.0), 1)


NORMALIZERS = {
    "cpm": cpm, "tpm": cpm, "rpkm": cpm, "is": cpm, "relative": relative, "sum": relative, "log2": lambda x: log_transform(x, 2.0), "log10": lambda x: log_transform(x, 10.0), "log1p": lambda x: x.withColumn("value", F.log1p("value")),
    "vst": sqrt_transform, "vsn": vsn, "zscore": zscore, "minmax": minmax, "robust": robust, "pareto": pareto, "median_center": median_center, "median_scale": median_scale, "tmm": library_scale,
    "log_normalize": lambda x: library_scale(x, True), "pqn": pqn, "clr": clr, "rarefaction": rarefied, "arcsinh": arcsinh, "quantile": quantile_normalize, "bmiq": rank_normal,
}


def normalize(long: DataFrame, method: str) -> DataFrame:
    """Any normalisation by name."""
    if method not in NORMALIZERS:
        raise ValueError(f"unknown normalisation {method!r}; known: {', '.join(sorted(NORMALIZERS))}")
    return NORMALIZERS[method](long)


# --- quality --------------------------------------------------------------------------------------------------------


def missing_by(long: DataFrame, key: str) -> DataFrame:
    return long.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"), F.count_if(F.col("value") == 0).alias("n_zero"))


def moments(long: DataFrame, key: str = "feature") -> DataFrame:
    """Mean, deviations, and the bias-corrected skewness and kurtosis of every key."""
    n = F.count("value").cast("double")
    g1, g2 = F.skewness("value"), F.kurtosis("value")
    return long.groupBy(key).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1).alias("skewness"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )


def iqr_outliers(long: DataFrame, key: str = "feature", fence: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by `fence` interquartile ranges, counted by key."""
    q = with_stats(long, key, q1=F.percentile("value", F.lit(0.25)), q3=F.percentile("value", F.lit(0.75)))
    out = (F.col("value") < F.col("q1") - fence * (F.col("q3") - F.col("q1"))) | (F.col("value") > F.col("q3") + fence * (F.col("q3") - F.col("q1")))
    return q.groupBy(key).agg(F.count_if(out).alias("n_outliers"), F.count("value").alias("n"))


def zscore_outliers(long: DataFrame, key: str = "feature", limit: float = 3.0) -> DataFrame:
    z = with_stats(long, key, m=F.avg("value"), s=F.stddev_pop("value"))
    return z.groupBy(key).agg(F.count_if((F.col("s") > 0) & (F.abs((F.col("value") - F.col("m")) / F.col("s")) > limit)).alias("n_outliers"), F.count("value").alias("n"))


def library_sizes(long: DataFrame) -> DataFrame:
    """One row: samples, features, share of non-zero values, median and coefficient of variation (ddof 1) of sample sums, median of detected features."""
    per = long.groupBy("sample").agg(F.sum("value").alias("size"), F.count_if(F.col("value") > 0).alias("detected"))
    totals = long.agg(F.countDistinct("feature").alias("n_features"), F.avg((F.col("value") != 0).cast("double")).alias("nonzero_rate"), F.avg(F.col("value").isNotNull().cast("double")).alias("completeness"))
    return per.agg(F.count("*").alias("n_samples"), median("size").alias("median_size"), (F.stddev_samp("size") / F.avg("size")).alias("size_cv"), F.min("size").alias("min_size"), median("detected").alias("median_detected")).crossJoin(F.broadcast(totals))


def low_coverage_samples(long: DataFrame, share: float = 0.5) -> DataFrame:
    """Samples whose sum is below `share` of the median sum."""
    per = long.groupBy("sample").agg(F.sum("value").alias("size"))
    return per.crossJoin(F.broadcast(per.agg(median("size").alias("m")))).where(F.col("size") < share * F.col("m")).select("sample", "size")


def value_range(long: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return long.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(~F.col("value").between(low, high)).alias("n_outside"))


def report(metrics: DataFrame, **thresholds: float) -> DataFrame:
    """(metric, value, threshold, passed) rows from a one-row table; metrics without threshold pass."""
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(thresholds.get(c)).cast("double").alias("threshold")) for c in metrics.columns))
    return metrics.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.col("threshold").isNull()))
