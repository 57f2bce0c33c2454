"""Queries of tests, effect sizes, corrections, correlation, diversity and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import moderated as md
from helixframe.operators import selection as sl
from helixframe.operators import statistics as st
from helixframe.plans.common import COUNTS, EXPRESSION, R, counts, expression, integers, query, rounded, table

QUERIES: dict = {}


def add(name: str, make, sql: str | None, *floats: str, ints: tuple[str, ...] = ()) -> None:
    QUERIES[name] = (lambda spark, sf_dir: integers(rounded(make(spark, sf_dir), *floats), *ints), sql)


_MOMENTS = EXPRESSION + """, moments AS (SELECT feature, count(*) FILTER (WHERE grp = 0) AS n1, count(*) FILTER (WHERE grp = 1) AS n2, avg(value) FILTER (WHERE grp = 0) AS mean1, avg(value) FILTER (WHERE grp = 1) AS mean2,
    var_samp(value) FILTER (WHERE grp = 0) AS var1, var_samp(value) FILTER (WHERE grp = 1) AS var2 FROM expression WHERE grp IN (0, 1) GROUP BY feature)"""
_D = "(mean2 - mean1) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2))"


def _pair(spark, sf_dir):
    return st.two_group_moments(expression(spark, sf_dir), "grp", 0, 1)


add("de_welch", lambda s, d: st.t_test(_pair(s, d)).select("feature", "mean1", "mean2", "statistic", "df"), query(_MOMENTS, sql=f"SELECT feature::BIGINT AS feature, {R('mean1')} AS mean1, {R('mean2')} AS mean2, {R('(mean2 - mean1) / sqrt(var1 / n1 + var2 / n2)')} AS statistic, {R('(var1 / n1 + var2 / n2) ^ 2 / ((var1 / n1) ^ 2 / (n1 - 1) + (var2 / n2) ^ 2 / (n2 - 1))')} AS df FROM moments"), "mean1", "mean2", "statistic", "df", ints=("feature",))
add("de_student", lambda s, d: st.t_test(_pair(s, d), welch=False).select("feature", "statistic", "df"), query(_MOMENTS, sql=f"SELECT feature::BIGINT AS feature, {R('(mean2 - mean1) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))')} AS statistic, {R('(n1 + n2 - 2)::DOUBLE')} AS df FROM moments"), "statistic", "df", ints=("feature",))
add("de_effect_sizes", lambda s, d: st.effect_sizes(_pair(s, d)).select("feature", "cohens_d", "hedges_g", "effect"), query(_MOMENTS, sql=f"SELECT feature::BIGINT AS feature, {R('d')} AS cohens_d, {R('d * (1 - 3.0 / (4 * (n1 + n2) - 9))')} AS hedges_g, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM (SELECT *, {_D} AS d FROM moments)"), "cohens_d", "hedges_g", ints=("feature",))
_RANKS = EXPRESSION + """, ranks AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM expression WHERE grp IN (0, 1)),
    u AS (SELECT feature, sum(r) FILTER (WHERE grp = 1) - count(*) FILTER (WHERE grp = 1) * (count(*) FILTER (WHERE grp = 1) + 1) / 2.0 AS u, count(*) FILTER (WHERE grp = 0) AS n1, count(*) FILTER (WHERE grp = 1) AS n2 FROM ranks GROUP BY feature)"""
add("de_mann_whitney_u", lambda s, d: st.rank_sums(expression(s, d), "grp", 0, 1).select("feature", "u"), query(_RANKS, sql="SELECT feature::BIGINT AS feature, u::DOUBLE AS u FROM u"), ints=("feature",))
add("de_cliffs_delta", lambda s, d: st.rank_sums(expression(s, d), "grp", 0, 1).select("feature", "cliffs_delta"), query(_RANKS, sql=f"SELECT feature::BIGINT AS feature, {R('2 * u / (n1 * n2) - 1')} AS cliffs_delta FROM u"), "cliffs_delta", ints=("feature",))
_ANOVA = EXPRESSION + """, cells AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM expression GROUP BY feature, grp),
    grand AS (SELECT feature, avg(value) AS g, count(*) AS n FROM expression GROUP BY feature),
    ss AS (SELECT feature, sum(c.n * (m - g) ^ 2) AS b, sum((c.n - 1) * v) AS w, count(*) - 1 AS db, any_value(grand.n) - count(*) AS dw FROM cells c JOIN grand USING (feature) GROUP BY feature)"""
add("de_anova_f", lambda s, d: st.anova(expression(s, d), "grp").select("feature", "f", "eta_squared", "omega_squared"), query(_ANOVA, sql=f"SELECT feature::BIGINT AS feature, {R('(b / db) / (w / dw)')} AS f, {R('b / (b + w)')} AS eta_squared, {R('(b - db * w / dw) / (b + w + w / dw)')} AS omega_squared FROM ss"), "f", "eta_squared", "omega_squared", ints=("feature",))
add("de_kruskal_h", lambda s, d: st.kruskal(expression(s, d), "grp").select("feature", "h", "df"), query(EXPRESSION, sql=f"""SELECT feature::BIGINT AS feature, {R('(12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n))')} AS h, df FROM
    (SELECT feature, sum(r2) AS q, sum(ni)::DOUBLE AS n, (count(*) - 1)::DOUBLE AS df, any_value(t) AS t FROM (SELECT feature, grp, sum(r) ^ 2 / count(*) AS r2, count(*) AS ni, any_value(t) AS t FROM
    (SELECT feature, grp, r, sum(c * c - 1) OVER (PARTITION BY feature) AS t FROM (SELECT feature, grp, count(*) OVER (PARTITION BY feature, value) AS c, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM expression)) GROUP BY feature, grp) GROUP BY feature)"""), "h", ints=("feature",))
add("de_levene", lambda s, d: st.levene(expression(s, d), "grp").select("feature", "f"), query(EXPRESSION.replace("expression AS", "raw AS"), "expression AS (SELECT feature, grp, abs(value - avg(value) OVER (PARTITION BY feature, grp)) AS value FROM raw)", _ANOVA[_ANOVA.index("cells AS"):], sql=f"SELECT feature::BIGINT AS feature, {R('(b / db) / (w / dw)')} AS f FROM ss"), "f", ints=("feature",))
_LFC = "CASE WHEN mean1 > 0 AND mean2 > 0 THEN log2(mean2 / mean1) END"
add("de_fold_change", lambda s, d: st.differential(expression(s, d), "grp", 0, 1).select("feature", "log2fc"), query(_MOMENTS, sql=f"SELECT feature::BIGINT AS feature, {R(_LFC)} AS log2fc FROM moments"), "log2fc", ints=("feature",))
add("de_full", lambda s, d: st.volcano(st.differential(expression(s, d), "grp", 0, 1)).select("feature", "p_value", "adjusted", "neg_log10_p", "class"), None, "p_value", "adjusted", "neg_log10_p")
add("de_full_mann_whitney", lambda s, d: st.differential(expression(s, d), "grp", 0, 1, "mann_whitney").select("feature", "statistic", "p_value", "adjusted"), None, "p_value", "adjusted")
add("de_ranking", lambda s, d: st.gene_ranking(st.t_test(_pair(s, d)).withColumn("p_value", F.lit(0.5)).withColumn("log2fc", F.lit(0.0)), "statistic").select("feature", "score"), query(_MOMENTS, sql=f"SELECT feature::BIGINT AS feature, {R('(mean2 - mean1) / sqrt(var1 / n1 + var2 / n2)')} AS score FROM moments"), "score", ints=("feature",))

# digamma and trigamma by their series of 50 terms and Euler's tail, the inverse of trigamma by halving
_PSI = "ln({x} + 50) - 1 / (2 * ({x} + 50)) - 1 / (12 * ({x} + 50) ^ 2) - list_sum(list_transform(range(0, 50), lambda k: 1 / ({x} + k)))"
_TRI = "1 / ({x} + 50) + 1 / (2 * ({x} + 50) ^ 2) + 1 / (6 * ({x} + 50) ^ 3) + list_sum(list_transform(range(0, 50), lambda k: 1 / ({x} + k) ^ 2))"
_MODERATED = f"""s AS (SELECT *, (n1 + n2 - 2)::DOUBLE AS df, ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) AS var FROM moments),
 e AS (SELECT avg(ln(var) - ({_PSI.format(x='(df / 2)')}) + ln(df / 2)) AS m, var_samp(ln(var) - ({_PSI.format(x='(df / 2)')}) + ln(df / 2)) - avg({_TRI.format(x='(df / 2)')}) AS v, sum(df) AS most FROM s),
 h AS (SELECT m, most, v, list_reduce(list_concat([[0.000000001::DOUBLE, 1000000000.0]], list_transform(range(0, 200), lambda i: [0.0::DOUBLE, 0.0])),
   lambda a, i: CASE WHEN ({_TRI.format(x='sqrt(a[1] * a[2])')}) > v THEN [sqrt(a[1] * a[2]), a[2]] ELSE [a[1], sqrt(a[1] * a[2])] END)[1] AS half FROM e),
 p AS (SELECT most, v, 2 * half AS d0, exp(m + ({_PSI.format(x='half')}) - ln(half)) AS s0, exp(m) AS flat FROM h),
 post AS (SELECT *, CASE WHEN v <= 0 THEN flat ELSE (d0 * s0 + df * var) / (d0 + df) END AS var_post, CASE WHEN v <= 0 THEN most ELSE least(df + d0, most) END AS df_total FROM s, p)"""
add("de_moderated", lambda s, d: md.moderated_t(_pair(s, d)).select("feature", "var_post", "statistic", "df_total"), query(_MOMENTS, _MODERATED, sql=f"SELECT feature::BIGINT AS feature, {R('var_post')} AS var_post, {R('(mean2 - mean1) / sqrt(var_post * (1.0 / n1 + 1.0 / n2))')} AS statistic, round(df_total, 3) AS df_total FROM post"), "var_post", "statistic", ints=("feature",))
QUERIES["de_moderated"] = (lambda s, d, make=QUERIES["de_moderated"][0]: make(s, d).withColumn("df_total", F.round("df_total", 3)), QUERIES["de_moderated"][1])


def _expression_counts(spark, sf_dir):
    """Embeddings as counts: hundredths of their absolute values, every feature of every sample a row."""
    return expression(spark, sf_dir).select("sample", "feature", "grp", F.floor(F.abs("value") * 100).alias("value"))


add("de_negative_binomial", lambda s, d: md.negative_binomial(_expression_counts(s, d), "grp", 0, 1, _expression_counts(s, d).groupBy("sample").agg((F.sum("value") / 500).alias("size_factor"))), None, "mean1", "mean2", "log2fc")


# p-values for the corrections: a rank of the order's price, so that every engine has the same numbers
def _tests(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("feature")).agg(F.sum("o_totalprice").alias("total"))
    return orders.withColumn("p_value", F.pow(F.row_number().over(Window.orderBy("total", "feature")) / (F.count("*").over(Window.partitionBy()) + 1), 4)).select("feature", "p_value")


_P = "tests AS (SELECT feature, (row_number() OVER (ORDER BY total, feature) / (count(*) OVER () + 1.0)) ^ 4 AS p FROM (SELECT o_custkey AS feature, sum(o_totalprice) AS total FROM orders GROUP BY 1)), ranked AS (SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS k, count(*) OVER () AS n FROM tests)"
_UP, _DOWN = "OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BH = f"least(min(p * n / k) {_UP}, 1)"
for _name, _expr in {
    "bonferroni": "least(p * n, 1)", "sidak": "1 - (1 - p) ^ n", "holm": f"least(max(p * (n - k + 1)) {_DOWN}, 1)", "holm_sidak": f"max(1 - (1 - p) ^ (n - k + 1)) {_DOWN}", "fdr_bh": _BH,
    "fdr_by": f"least(min(p * n * (SELECT sum(1.0 / k) FROM ranked) / k) {_UP}, 1)",
    "qvalue": f"least(min(p * n / k) {_UP} * (SELECT least(median(c), 1) FROM (SELECT (SELECT count(*) FROM ranked WHERE p > l) / ((SELECT count(*) FROM ranked) * (1 - l)) AS c FROM (SELECT unnest(range(1, 19)) * 0.05 AS l))), 1)",
}.items():
    add(f"adjust_{_name}", lambda s, d, how=_name: st.adjust(_tests(s, d), how).select("feature", "p_value", "adjusted"), query(_P, sql=f"SELECT feature, {R('p')} AS p_value, {R(_expr)} AS adjusted FROM ranked"), "p_value", "adjusted")
for _name, _alpha, _factor in (("fdr_tsbh", "0.05", "1.0"), ("fdr_tsbky", "0.05 / 1.05", "1.05")):
    add(f"adjust_{_name}", lambda s, d, how=_name: st.adjust(_tests(s, d), how).select("feature", "adjusted"), query(_P, f"bh AS (SELECT feature, n, {_BH} AS a FROM ranked)", sql=f"SELECT feature, {R(f'least(a * (SELECT greatest(count(*) FILTER (WHERE a > {_alpha}), 1) / count(*) FROM bh) * {_factor}, 1)')} AS adjusted FROM bh"), "adjusted")
add("significant_features", lambda s, d: st.adjust(_tests(s, d)).where("adjusted < 0.05").groupBy().agg(F.count("*").alias("n")), query(_P, f"bh AS (SELECT {_BH} AS a FROM ranked)", sql="SELECT count(*) AS n FROM bh WHERE a < 0.05"))
add("compare_methods", lambda s, d: st.compare_methods({m: st.adjust(_tests(s, d), m) for m in ("bonferroni", "holm", "fdr_bh")}), query(_P, f"a AS (SELECT feature, least(p * n, 1) < 0.05 AS bonferroni, least(max(p * (n - k + 1)) {_DOWN}, 1) < 0.05 AS holm, {_BH} < 0.05 AS fdr_bh FROM ranked)", sql="SELECT feature, bonferroni, holm, fdr_bh, (bonferroni::INT + holm::INT + fdr_bh::INT)::BIGINT AS n_methods FROM a WHERE bonferroni OR holm OR fdr_bh"))

_PAIRS = "SELECT a.feature::BIGINT AS a, b.feature::BIGINT AS b, {r} AS r, count(*) AS n FROM {v} a JOIN {v} b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2"
add("corr_pearson_pairs", lambda s, d: st.pair_correlations(expression(s, d)), query(EXPRESSION, sql=_PAIRS.format(r=R("corr(a.value, b.value)"), v="expression")), "r", ints=("a", "b"))
add("corr_spearman_pairs", lambda s, d: st.pair_correlations(expression(s, d), "spearman"), query(EXPRESSION, "ranks AS (SELECT sample, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS value FROM expression)", sql=_PAIRS.format(r=R("corr(a.value, b.value)"), v="ranks")), "r", ints=("a", "b"))
add("coexpression_edges", lambda s, d: st.pair_correlations(expression(s, d), threshold=0.1).select("a", "b", "r"), query(EXPRESSION, sql=f"SELECT a, b, {R('r')} AS r FROM (" + _PAIRS.format(r="corr(a.value, b.value)", v="expression") + ") WHERE abs(r) >= 0.1"), "r", ints=("a", "b"))
add("network_hubs", lambda s, d: (lambda e: e.select(F.col("a").alias("node")).unionAll(e.select("b")).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10))(st.pair_correlations(expression(s, d), threshold=0.1)), query(EXPRESSION, "e AS (SELECT a, b FROM (" + _PAIRS.format(r="corr(a.value, b.value)", v="expression") + ") WHERE abs(r) >= 0.1)", sql="SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 10"), ints=("node",))
add("alpha_diversity", lambda s, d: st.alpha_diversity(counts(s, d)), query(COUNTS, sql=f"SELECT sample, {R('-sum(p * ln(p))')} AS shannon, {R('1 - sum(p * p)')} AS simpson, count(*) AS observed FROM (SELECT sample, value / sum(value) OVER (PARTITION BY sample) AS p FROM counts WHERE value > 0) GROUP BY sample"), "shannon", "simpson")
_BETA = f"pairs AS (SELECT a.sample AS a, b.sample AS b, sum(least(a.value, b.value)) AS low, sum(a.value * b.value) AS xy, count(*) AS c FROM counts a JOIN counts b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2), own AS (SELECT sample, sum(value) AS s, sum(value * value) AS q, count(*) AS c FROM counts GROUP BY sample)"
for _name, _expr in {"braycurtis": "1 - 2 * low / (x.s + y.s)", "euclidean": "sqrt(x.q + y.q - 2 * xy)", "manhattan": "x.s + y.s - 2 * low", "jaccard": "1 - pairs.c / (x.c + y.c - pairs.c)"}.items():
    add(f"beta_{_name}", lambda s, d, how=_name: st.beta_diversity(counts(s, d), how), query(COUNTS, _BETA, sql=f"SELECT a, b, {R(_expr)} AS distance FROM pairs JOIN own x ON x.sample = a JOIN own y ON y.sample = b"), "distance")


# part brands as gene sets, parts of large quantity as the query
def _sets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("pathway"), F.col("p_partkey").alias("gene"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("q")).where("q > 900").select("gene")


def _ranking(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") - 1400).alias("score"))


_ORA = "asked AS (SELECT l_partkey AS gene FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 900), uni AS (SELECT DISTINCT p_partkey AS gene FROM part), sets AS (SELECT DISTINCT p_brand AS pathway, p_partkey AS gene FROM part), q AS (SELECT gene FROM asked WHERE gene IN (SELECT gene FROM uni))"
add("ora_contingency", lambda s, d: st.over_representation(_asked(s, d), _ranking(s, d), _sets(s, d)).select("pathway", "set_size", "overlap", "universe_size", "query_size", "odds_ratio"), query(_ORA, sql=f"SELECT pathway, set_size, overlap, u AS universe_size, k AS query_size, {R('CASE WHEN (k - overlap) * (set_size - overlap) > 0 THEN overlap * (u - k - (set_size - overlap)) / ((k - overlap) * (set_size - overlap)) END')} AS odds_ratio FROM (SELECT pathway, count(*) AS set_size, count(*) FILTER (WHERE gene IN (SELECT gene FROM q)) AS overlap, (SELECT count(*) FROM uni) AS u, (SELECT count(*) FROM q) AS k FROM sets GROUP BY pathway HAVING count(*) >= 2)"), "odds_ratio")
add("ora_p_values", lambda s, d: st.over_representation(_asked(s, d), _ranking(s, d), _sets(s, d)).select("pathway", "p_value", "adjusted"), None, "p_value", "adjusted")
add("gsea_prerank", lambda s, d: st.prerank(_ranking(s, d), _sets(s, d)).select("pathway", "size", "es"), query("sets AS (SELECT DISTINCT p_brand AS pathway, p_partkey AS gene FROM part)", "r AS (SELECT p_partkey AS gene, p_retailprice - 1400 AS score, row_number() OVER (ORDER BY p_retailprice - 1400 DESC, p_partkey) AS k, count(*) OVER () AS n FROM part)", "h AS (SELECT pathway, r.k, n, abs(score) AS w, row_number() OVER (PARTITION BY pathway ORDER BY r.k) AS i, count(*) OVER (PARTITION BY pathway) AS size, sum(abs(score)) OVER (PARTITION BY pathway ORDER BY r.k) AS cum, sum(abs(score)) OVER (PARTITION BY pathway) AS tot FROM sets JOIN r USING (gene))", "e AS (SELECT pathway, any_value(size) AS size, max(cum / tot - (k - i) / (n - size)) AS high, min((cum - w) / tot - (k - i) / (n - size)) AS low FROM h GROUP BY pathway)", sql=f"SELECT pathway, size, {R('CASE WHEN high >= -low THEN high ELSE low END')} AS es FROM e"), "es")
add("gsea_significance", lambda s, d: st.prerank_significance(_ranking(s, d), _sets(s, d), min_size=2).select("pathway", "size", "es", "p_value", "nes", "fdr"), None, "es", "p_value", "nes", "fdr")
add("test_selection", lambda s, d: st.select_test(expression(s, d).where("grp IN (0, 1)"), "grp").select("n_groups", "test"), None)
add("rank_set_test", lambda s, d: st.rank_set_test(_ranking(s, d), _sets(s, d)).select("pathway", "mean_rank", "size", "p_value"), None, "mean_rank", "p_value")
_PS = "joined AS (SELECT l_suppkey AS sample, p_brand AS pathway, value FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey)"
for _name in ("mean", "median"):
    add(f"pathway_scores_{_name}", lambda s, d, how=_name: st.pathway_scores(counts(s, d), _sets(s, d), how), query(_PS, sql=f"SELECT sample, pathway, {R(f'{_name}(value)')} AS score, count(*) AS n FROM joined GROUP BY 1, 2 HAVING count(*) >= 2"), "score")
add("pathway_crosstalk", lambda s, d: st.crosstalk(table(s, d, "lineitem").select(F.col("l_suppkey").alias("pathway"), F.col("l_partkey").alias("gene")), 130), query("s AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS g FROM lineitem), z AS (SELECT p, count(*) AS n FROM s GROUP BY p)", sql=f"SELECT a, b, o AS overlap, {R('o / (x.n + y.n - o)')} AS jaccard FROM (SELECT a.p AS a, b.p AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 130) JOIN z x ON x.p = a JOIN z y ON y.p = b"), "jaccard")


def _scores(spark, sf_dir):
    """Three methods' scores of every feature."""
    long = expression(spark, sf_dir).groupBy("feature").agg(F.var_samp("value").alias("variance"), F.max("value").alias("top"), F.avg(F.abs("value")).alias("size"))
    return long.unpivot(["feature"], ["variance", "top", "size"], "method", "score")


_SCORES = EXPRESSION + ", s0 AS (SELECT feature, var_samp(value) AS v, max(value) AS t, avg(abs(value)) AS z FROM expression GROUP BY feature), scores AS (SELECT 'variance' AS method, feature, v AS score FROM s0 UNION ALL SELECT 'top', feature, t FROM s0 UNION ALL SELECT 'size', feature, z FROM s0), rk AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS r, max(score) OVER (PARTITION BY method) AS mx, count(*) OVER (PARTITION BY method) AS m FROM scores)"
for _name, _expr in {"weighted": "avg(CASE WHEN mx > 0 THEN score / mx ELSE 0 END)", "rank_product": "1 / exp(avg(ln(r + 1)))", "borda": "sum(m - r + 1)"}.items():
    add(f"consensus_{_name}", lambda s, d, how=_name: st.consensus(_scores(s, d), how).select("feature", "consensus"), query(_SCORES, sql=f"SELECT feature::BIGINT AS feature, {R(f'({_expr})::DOUBLE')} AS consensus FROM rk GROUP BY feature"), "consensus", ints=("feature",))
add("selection_frequency", lambda s, d: st.selection_frequency(_scores(s, d)), query(_SCORES, sql=f"SELECT feature::BIGINT AS feature, {R('avg(CASE WHEN score > c THEN 1.0 ELSE 0.0 END)')} AS frequency FROM (SELECT feature, score, quantile_cont(score, 0.75) OVER (PARTITION BY method) AS c FROM scores) GROUP BY feature"), "frequency", ints=("feature",))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("target"))


add("selection_stability", lambda s, d: sl.stability(_labelled(s, d), 64, 20), None)
add("selection_elimination", lambda s, d: sl.recursive_elimination(_labelled(s, d), 64), None)
