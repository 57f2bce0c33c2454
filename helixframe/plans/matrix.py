"""Queries over sample-by-feature matrices: filters, imputation, normalisation, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import matrix as m
from helixframe.plans.common import COUNTS, EXPRESSION, GAPS, R, counts, expression, gaps, integers, query, rounded

QUERIES: dict = {}


def add(name: str, source, view: str, make, sql: str, *floats: str, ints: tuple[str, ...] = ()) -> None:
    """Registers make(source) with its SQL; `floats` are rounded on the Spark side (the SQL rounds by itself)."""
    QUERIES[name] = (lambda spark, sf_dir: integers(rounded(make(source(spark, sf_dir)), *floats), *ints), query(view, sql=sql) if sql else None)


def _group_summary(long):
    return long.groupBy("grp", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), m.median("value").alias("median"))


add("matrix_group_summary", expression, EXPRESSION, _group_summary, f"SELECT grp, feature::BIGINT AS feature, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd, {R('median(value)')} AS median FROM expression GROUP BY grp, feature", "mean", "sd", "median", ints=("feature",))
add("matrix_transpose_sums", counts, COUNTS, lambda x: m.transpose(x).groupBy("sample").agg(F.sum("value").alias("total")), "SELECT feature AS sample, sum(value) AS total FROM counts GROUP BY feature")

_ROWS = "SELECT sample, feature, value FROM counts"
add("filter_min_count", counts, COUNTS, lambda x: m.min_count_filter(x, 30, 10), _ROWS + " WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING count(*) FILTER (WHERE value > 30) >= 10)")
add("filter_prevalence", counts, COUNTS, lambda x: m.keep_features(x, F.count_if(F.col("value") > 0) >= 30), _ROWS + " WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING count(*) FILTER (WHERE value > 0) >= 30)")
add("filter_prevalence_share", gaps, GAPS, lambda x: m.prevalence_filter(x.withColumn("value", F.col("value") - 10), 0.2).groupBy("feature").agg(F.count("*").alias("n")), "SELECT feature, count(*) AS n FROM gaps GROUP BY feature HAVING count(*) FILTER (WHERE value - 10 > 0) * 1.0 / count(value) >= 0.2")
add("filter_variance", expression, EXPRESSION, lambda x: m.variance_filter(x, 0.0155).groupBy("feature").agg(F.count("*").alias("n")), "SELECT feature::BIGINT AS feature, count(*) AS n FROM expression GROUP BY feature HAVING var_samp(value) >= 0.0155", ints=("feature",))
add("filter_variance_percentile", expression, EXPRESSION, lambda x: m.variance_percentile_filter(x, 0.25).groupBy("feature").agg(F.count("*").alias("n")), "SELECT feature::BIGINT AS feature, n FROM (SELECT feature, count(*) AS n, var_samp(value) AS v FROM expression GROUP BY feature) WHERE v > (SELECT quantile_cont(v, 0.25) FROM (SELECT var_samp(value) AS v FROM expression GROUP BY feature))", ints=("feature",))
add("filter_missing", gaps, GAPS, lambda x: m.missing_filter(x, 0.1429).groupBy("feature").agg(F.count("*").alias("n")), "SELECT feature, count(*) AS n FROM gaps GROUP BY feature HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.1429")
add("filter_cells_genes", counts, COUNTS, lambda x: m.cell_gene_filter(x, 450, 30), _ROWS + " WHERE sample IN (SELECT sample FROM counts GROUP BY sample HAVING count(*) FILTER (WHERE value > 0) >= 450) AND feature IN (SELECT feature FROM counts GROUP BY feature HAVING count(*) FILTER (WHERE value > 0) >= 30)")
add("filter_spots", counts, COUNTS, lambda x: m.spot_filter(x, 15000, 800), _ROWS + " WHERE sample IN (SELECT sample FROM counts GROUP BY sample HAVING sum(value) > 15000) AND feature IN (SELECT feature FROM counts GROUP BY feature HAVING sum(value) > 800)")

for _how, _fill in {"min": "min(value) OVER ()", "half_min": "min(value) OVER (PARTITION BY feature) / 2", "mean": "avg(value) OVER (PARTITION BY feature)", "median": "median(value) OVER (PARTITION BY feature)", "zero": "0.0"}.items():
    add(f"impute_{_how}", gaps, GAPS, lambda x, how=_how: m.impute(x, how).select("sample", "feature", "value"), f"SELECT sample, feature, {R(f'coalesce(value, {_fill})')} AS value FROM gaps", "value")

_S, _F = "OVER (PARTITION BY sample)", "OVER (PARTITION BY feature)"
_NORMS = {
    "cpm": ("counts", f"value / sum(value) {_S} * 1e6"),
    "relative": ("counts", f"value / sum(value) {_S}"),
    "log2": ("expression", "log2(value - least(min(value) OVER (), 0) + 1)"),
    "log10": ("expression", "log10(value - least(min(value) OVER (), 0) + 1)"),
    "vst": ("counts", "sqrt(value + 1)"),
    "zscore": ("expression", f"(value - avg(value) {_F}) / stddev_pop(value) {_F}"),
    "minmax": ("expression", f"(value - min(value) {_F}) / (max(value) {_F} - min(value) {_F})"),
    "robust": ("expression", f"(value - median(value) {_F}) / (quantile_cont(value, 0.75) {_F} - quantile_cont(value, 0.25) {_F})"),
    "pareto": ("expression", f"(value - avg(value) {_F}) / sqrt(stddev_samp(value) {_F})"),
    "median_center": ("expression", f"value - median(value) {_S}"),
    "arcsinh": ("counts", "asinh(value / 5)"),
}
for _name, (_view, _expr) in _NORMS.items():
    _source, _sql = (counts, COUNTS) if _view == "counts" else (expression, EXPRESSION)
    add(f"norm_{_name}", _source, _sql, lambda x, how=_name: m.normalize(x, how).select("sample", "feature", "value"), f"SELECT sample, feature::BIGINT AS feature, {R(_expr)} AS value FROM {_view}", "value", ints=("feature",))

_SUMS = "sums AS (SELECT sample, sum(value) AS s, median(value) AS med FROM counts GROUP BY sample)"
_JOINED = "FROM counts JOIN sums USING (sample)"
for _name, _expr in {
    "tmm": "value / (s / (SELECT median(s) FROM sums))", "log_normalize": "ln(1 + value / (s / (SELECT median(s) FROM sums)))", "rarefaction": "value * (SELECT min(s) FROM sums) / s",
    "median_scale": "value * (SELECT median(med) FROM sums) / med",
}.items():
    add(f"norm_{_name}", counts, f"{COUNTS}, {_SUMS}", lambda x, how=_name: m.normalize(x, how).select("sample", "feature", "value"), f"SELECT sample, feature, {R(_expr)} AS value {_JOINED}", "value")
add("norm_clr", counts, COUNTS, lambda x: m.clr(x).select("sample", "feature", "value"), f"SELECT sample, feature, {R(f'ln(value + 1) - avg(ln(value + 1)) {_S}')} AS value FROM counts", "value")
add("norm_pqn", counts, COUNTS, lambda x: m.pqn(x).select("sample", "feature", "value"), f"""SELECT sample, feature, {R('r / median(r / ref) OVER (PARTITION BY sample)')} AS value FROM (SELECT sample, feature, r, median(r) OVER (PARTITION BY feature) AS ref FROM (SELECT sample, feature, value / sum(value) {_S} AS r FROM counts))""", "value")
add("norm_quantile", expression, EXPRESSION, lambda x: m.quantile_normalize(x.select("sample", "feature", "value")), f"""SELECT sample, r.feature::BIGINT AS feature, {R('mean')} AS value FROM (SELECT sample, feature, rank() OVER (PARTITION BY feature ORDER BY value) AS k FROM expression) r
    JOIN (SELECT k, avg(value) AS mean FROM (SELECT value, row_number() OVER (PARTITION BY feature ORDER BY value, sample) AS k FROM expression) GROUP BY k) USING (k)""", "value", ints=("feature",))
add("norm_vsn", counts, COUNTS, lambda x: m.keep_features(m.vsn(m.keep_features(x, F.count("*") >= 25)), F.count("*") > 0).select("sample", "feature", "value"), f"SELECT sample, feature, {R(f'(l - avg(l) {_F}) / stddev_samp(l) {_F}')} AS value FROM (SELECT sample, feature, log2(value + 1) AS l FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING count(*) >= 25))", "value")
add("norm_bmiq_ranks", expression, EXPRESSION, lambda x: m.ranked(x.select("sample", "feature", "value")).select("sample", "feature", "rank_first", "rank_min", "rank_avg"), """SELECT sample, feature::BIGINT AS feature, row_number() OVER (PARTITION BY feature ORDER BY value, sample) AS rank_first, rank() OVER (PARTITION BY feature ORDER BY value) AS rank_min,
    rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rank_avg FROM expression""", ints=("feature", "rank_first", "rank_min"))
QUERIES["norm_bmiq"] = (lambda spark, sf_dir: integers(rounded(m.rank_normal(expression(spark, sf_dir).select("sample", "feature", "value")), "value"), "feature"), None)
add("size_factors_geometric", counts, COUNTS, m.geometric_size_factors, f"SELECT sample, {R('g / avg(g) OVER ()')} AS size_factor FROM (SELECT sample, exp(avg(ln(1 + value))) AS g FROM counts GROUP BY sample)", "size_factor")
add("size_factors_ratios", counts, COUNTS, m.median_of_ratios, f"SELECT sample, {R('median(exp(ln(value) - g))')} AS size_factor FROM counts JOIN (SELECT feature, avg(ln(value)) AS g FROM counts GROUP BY feature HAVING min(value) > 0) USING (feature) GROUP BY sample", "size_factor")

add("qc_missing_by_feature", gaps, GAPS, lambda x: m.missing_by(x, "feature"), f"SELECT feature, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_missing, {R('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate, count(*) FILTER (WHERE value = 0) AS n_zero FROM gaps GROUP BY feature", "missing_rate")
add("qc_moments", expression, EXPRESSION, m.moments, f"SELECT feature::BIGINT AS feature, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd, {R('var_samp(value)')} AS variance, {R('min(value)')} AS min, {R('max(value)')} AS max, {R('skewness(value)')} AS skewness, {R('kurtosis(value)')} AS kurtosis FROM expression GROUP BY feature", "mean", "sd", "variance", "min", "max", "skewness", "kurtosis", ints=("feature",))
add("qc_iqr_outliers", gaps, GAPS, lambda x: m.iqr_outliers(x, fence=0.6), """SELECT feature, count(*) FILTER (WHERE value < q1 - 0.6 * (q3 - q1) OR value > q3 + 0.6 * (q3 - q1)) AS n_outliers, count(value) AS n
    FROM (SELECT feature, value, quantile_cont(value, 0.25) OVER (PARTITION BY feature) AS q1, quantile_cont(value, 0.75) OVER (PARTITION BY feature) AS q3 FROM gaps) GROUP BY feature""")
add("qc_zscore_outliers", gaps, GAPS, lambda x: m.zscore_outliers(x, limit=1.5), """SELECT feature, count(*) FILTER (WHERE abs((value - a) / s) > 1.5) AS n_outliers, count(value) AS n
    FROM (SELECT feature, value, avg(value) OVER (PARTITION BY feature) AS a, stddev_pop(value) OVER (PARTITION BY feature) AS s FROM gaps) GROUP BY feature""")
add("qc_library_sizes", counts, COUNTS, m.library_sizes, f"""SELECT count(*) AS n_samples, {R('median(size)')} AS median_size, {R('stddev_samp(size) / avg(size)')} AS size_cv, min(size) AS min_size, {R('median(detected)')} AS median_detected,
    (SELECT count(DISTINCT feature) FROM counts) AS n_features, {R('(SELECT avg(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END) FROM counts)')} AS nonzero_rate, {R('(SELECT avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM counts)')} AS completeness
    FROM (SELECT sample, sum(value) AS size, count(*) FILTER (WHERE value > 0) AS detected FROM counts GROUP BY sample)""", "median_size", "size_cv", "median_detected", "nonzero_rate", "completeness")
add("qc_low_coverage", counts, COUNTS, lambda x: m.low_coverage_samples(x, 0.97), "SELECT sample, size FROM (SELECT sample, size, median(size) OVER () AS med FROM (SELECT sample, sum(value) AS size FROM counts GROUP BY sample)) WHERE size < 0.97 * med")
add("qc_value_range", expression, EXPRESSION, lambda x: m.value_range(x, 0, 1), f"SELECT {R('min(value)')} AS min, {R('max(value)')} AS max, count(*) FILTER (WHERE NOT value BETWEEN 0 AND 1) AS n_outside FROM expression", "min", "max")
add("qc_report", counts, COUNTS, lambda x: m.report(m.library_sizes(x).select("n_samples", "n_features", "completeness"), n_samples=50, completeness=0.7), """SELECT 'n_samples' AS metric, count(DISTINCT sample)::DOUBLE AS value, 50.0::DOUBLE AS threshold, count(DISTINCT sample) >= 50 AS passed FROM counts
    UNION ALL SELECT 'n_features', count(DISTINCT feature)::DOUBLE, NULL, true FROM counts UNION ALL SELECT 'completeness', avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.7, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.7 FROM counts""")
