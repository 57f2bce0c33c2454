"""Queries of networks, integration, models, rules, catalogues and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import centrality as ce
from helixframe.operators import clinical as cl
from helixframe.operators import graph as g
from helixframe.operators import integration as ig
from helixframe.plans.common import EXPRESSION, R, expression, integers, query, rounded, table
from helixframe.streaming import messages as ms

QUERIES: dict = {}


def add(name: str, make, sql: str | None, *floats: str, ints: tuple[str, ...] = ()) -> None:
    QUERIES[name] = (lambda spark, sf_dir: integers(rounded(make(spark, sf_dir), *floats), *ints), sql)


# parts on neighbouring lines of an order as a directed graph
def _edges(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    one = x.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return one.join(x.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]).select("src", "dst").where("src <> dst").distinct()


_EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey), links AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
_DEG = "deg AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node)"
add("graph_degrees", lambda s, d: g.degrees(_edges(s, d)), query(_EDGES, _DEG, sql="SELECT * FROM deg"))
add("graph_degree_distribution", lambda s, d: g.degree_distribution(_edges(s, d)), query(_EDGES, _DEG, sql="SELECT degree, count(*) AS n FROM deg GROUP BY degree"))
add("graph_induced", lambda s, d: g.induced(_edges(s, d), table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))), query(_EDGES, "few AS (SELECT p_partkey FROM part WHERE p_size <= 10)", sql="SELECT src, dst FROM edges WHERE src IN (SELECT p_partkey FROM few) AND dst IN (SELECT p_partkey FROM few)"))
add("graph_clustering", lambda s, d: g.clustering(_edges(s, d)).select("node", "degree", "triangles", "coefficient"), query(_EDGES, "k AS (SELECT src AS node, count(*) AS degree FROM links GROUP BY src), t AS (SELECT a.src AS node, count(*) / 2 AS triangles FROM links a JOIN links b ON a.dst = b.src JOIN links c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst GROUP BY 1)", sql=f"SELECT node, degree, coalesce(triangles, 0)::BIGINT AS triangles, {R('CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END')} AS coefficient FROM k LEFT JOIN t USING (node)"), "coefficient")
add("graph_components", lambda s, d: g.components(_edges(s, d)), None)  # the closure is too large for SQL
add("graph_distances", lambda s, d: g.distances(g.both_ways(_edges(s, d)), 1), "WITH RECURSIVE " + _EDGES + ", walk AS (SELECT 1::BIGINT AS node, 0 AS distance UNION SELECT links.dst, distance + 1 FROM walk JOIN links ON links.src = walk.node WHERE distance < 20) SELECT node, min(distance)::BIGINT AS distance FROM walk GROUP BY node", ints=("distance",))
add("graph_pagerank", lambda s, d: g.pagerank(_edges(s, d)), None, "rank")
add("graph_communities", lambda s, d: g.large_communities(g.label_communities(_edges(s, d), 3)), None)
add("graph_closeness", lambda s, d: ce.closeness(_edges(s, d)), None, "closeness")
add("graph_hubs", lambda s, d: ce.hubs_and_authorities(_edges(s, d)), None, "hub", "authority")
add("graph_eigenvector", lambda s, d: ce.eigenvector(_edges(s, d)), None, "centrality")

add("integration_early_fusion", lambda s, d: ig.early_fusion(_blocks(s, d)).groupBy("block").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")), query(EXPRESSION, "z AS (SELECT CASE WHEN feature < 32 THEN 'rna' ELSE 'protein' END AS block, (value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature) AS z FROM expression)", sql=f"SELECT block, count(*) AS n, {R('sum(z)')} AS total, {R('sum(z * z)')} AS squares FROM z GROUP BY block"), "total", "squares")
add("integration_variance_shares", lambda s, d: ig.variance_shares(ig.early_fusion(_blocks(s, d), scale=False)), query(EXPRESSION, "v AS (SELECT feature, var_pop(value) AS v FROM expression GROUP BY feature), b AS (SELECT CASE WHEN feature < 32 THEN 'rna' ELSE 'protein' END AS block, sum(v) AS v FROM v GROUP BY 1)", sql=f"SELECT block, {R('v / (SELECT sum(v) FROM b)')} AS share FROM b"), "share")
add("integration_align_samples", lambda s, d: ig.align_samples({"a": expression(s, d).where("sample % 2 = 0"), "b": expression(s, d).where("sample % 3 = 0")})["a"].select("sample").distinct(), "SELECT vec_id AS sample FROM embeddings WHERE vec_id % 6 = 0")
add("integration_fuse_predictions", lambda s, d: ig.fuse_predictions(_votes(s, d)), query(EXPRESSION, sql=f"SELECT sample, {R('sum(value * (feature + 1)) / sum(feature + 1)')} AS value FROM expression WHERE feature < 5 GROUP BY sample"), "value")
add("integration_similarity_network", lambda s, d: ig.similarity_network(ig.early_fusion(_blocks(s, d)).join(expression(s, d).select("sample", F.col("grp").alias("cohort")).distinct(), "sample"), "cohort"), None, "weight")
add("integration_pca", lambda s, d: ig.pca(ig.vectors(expression(s, d)), 3)[0].select("sample", *(F.abs(F.col("scores")[i]).alias(f"pc{i + 1}") for i in range(3))), None, "pc1", "pc2", "pc3")
add("integration_kmeans", lambda s, d: ig.cluster(ig.vectors(expression(s, d)), 5), None)
add("network_knn", lambda s, d: g.sample_network(expression(s, d), 5).select("src", "dst", "distance"), query(EXPRESSION, "p AS (SELECT a.sample AS src, b.sample AS dst, sqrt(sum((a.value - b.value) ^ 2)) AS distance FROM expression a JOIN expression b ON a.feature = b.feature AND a.sample <> b.sample GROUP BY 1, 2), n AS (SELECT src, dst, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM p) WHERE r <= 5)", sql=f"SELECT DISTINCT src, dst, {R('distance')} AS distance FROM (SELECT * FROM n UNION ALL SELECT dst, src, distance FROM n)"), "distance")
add("features_statistical", lambda s, d: ig.statistical_features(expression(s, d)).select("sample", "mean", "sd", "p25", "p75", "range", "iqr", "cv"), query(EXPRESSION, sql="SELECT sample, " + ", ".join(f"{R(e)} AS {n}" for n, e in {"mean": "avg(value)", "sd": "stddev_pop(value)", "p25": "quantile_cont(value, 0.25)", "p75": "quantile_cont(value, 0.75)", "range": "max(value) - min(value)", "iqr": "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "cv": "stddev_pop(value) / avg(value)"}.items()) + " FROM expression GROUP BY sample"), "mean", "sd", "p25", "p75", "range", "iqr", "cv")
add("features_interactions", lambda s, d: ig.interaction_features(expression(s, d), 20, 15), query(EXPRESSION, "top AS (SELECT feature FROM expression GROUP BY feature ORDER BY var_pop(value) DESC, feature LIMIT 20)", sql=f"SELECT a::BIGINT AS a, b::BIGINT AS b, {R('v')} AS variance FROM (SELECT x.feature AS a, y.feature AS b, var_pop(x.value * y.value) AS v FROM expression x JOIN expression y ON x.sample = y.sample AND x.feature < y.feature WHERE x.feature IN (SELECT feature FROM top) AND y.feature IN (SELECT feature FROM top) GROUP BY 1, 2 ORDER BY v DESC, a, b LIMIT 15)"), "variance", ints=("a", "b"))
add("metrics_classification", lambda s, d: ig.classification_metrics(_predicted(s, d)), f"WITH p AS (SELECT quality AS l, (doc_id % 3 > 0)::INT AS p FROM labels), c AS (SELECT DISTINCT l AS c FROM p), m AS (SELECT c, (SELECT count(*) FROM p WHERE l = c) AS s, (SELECT count(*) FROM p WHERE l = c AND p.p = c) AS tp, (SELECT count(*) FROM p WHERE p.p = c) AS g FROM c) SELECT {R('sum(tp) / sum(s)')} AS accuracy, {R('sum(s * tp / g) / sum(s)')} AS precision, {R('sum(s * tp / s) / sum(s)')} AS recall, {R('sum(s * (2 * (tp / g) * (tp / s) / (tp / g + tp / s))) / sum(s)')} AS f1 FROM m", "accuracy", "precision", "recall", "f1")
add("metrics_regression", lambda s, d: ig.regression_metrics(table(s, d, "part").select(F.col("p_retailprice").alias("label"), (F.col("p_size") * 20 + 900).cast("double").alias("prediction"))), f"SELECT {R('avg(e * e)')} AS mse, {R('sqrt(avg(e * e))')} AS rmse, {R('avg(abs(e))')} AS mae, {R('1 - avg(e * e) / var_pop(l)')} AS r2 FROM (SELECT p_retailprice AS l, p_retailprice - (p_size * 20 + 900) AS e FROM part)", "mse", "rmse", "mae", "r2")
add("metrics_roc_auc", lambda s, d: ig.roc_auc(table(s, d, "labels").select(F.col("quality").alias("label"), (F.col("doc_id") % 17).alias("score"))), f"SELECT {R('(sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p))')} AS auc FROM (SELECT quality AS label, rank() OVER (ORDER BY doc_id % 17) + (count(*) OVER (PARTITION BY doc_id % 17) - 1) / 2.0 AS r, sum(quality) OVER () AS p, count(*) OVER () AS n FROM labels) GROUP BY p, n", "auc")
add("stratified_folds", lambda s, d: ig.stratified_folds(table(s, d, "labels").select(F.col("doc_id").alias("sample"), F.col("quality").alias("label"))).groupBy("label").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n")), "SELECT quality AS label, 5 AS folds, count(*) AS n FROM labels GROUP BY 1")


def _blocks(spark, sf_dir):
    x = expression(spark, sf_dir)
    return {"rna": x.where("feature < 32"), "protein": x.where("feature >= 32")}


def _votes(spark, sf_dir):
    return expression(spark, sf_dir).where("feature < 5").select("sample", F.col("feature").alias("model"), "value", (F.col("feature") + 1).alias("weight"))


def _predicted(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), (F.col("doc_id") % 3 > 0).cast("int").alias("prediction"))


# --- joins, sets, catalogues, rules ---------------------------------------------------------------------------------

add("join_left_nation", lambda s, d: ig.merge_tables(table(s, d, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey"), table(s, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("key"), "n_name"), "key", "left"), "SELECT c_nationkey AS key, c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_nationkey = c_nationkey")
add("join_outer_parts", lambda s, d: ig.merge_tables(table(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("key"), "p_size"), table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("q")).where("q > 900"), "key", "outer"), "SELECT coalesce(p_partkey, k) AS key, p_size, q FROM (SELECT * FROM part WHERE p_size < 10) FULL JOIN (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 900) ON k = p_partkey")
add("join_anti_customers", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
add("stack_tables", lambda s, d: ig.stack_tables(table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))), "SELECT r_name AS name, r_regionkey AS region, NULL::INT AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation")
add("catalog_page", lambda s, d: cl.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 3, 25, F.desc("o_totalprice"), "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
add("catalog_search", lambda s, d: cl.search(table(s, d, "part"), "Brand#1", ["p_name", "p_brand"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%'")
add("catalog_tags", lambda s, d: cl.tagged(table(s, d, "part").select("p_partkey", F.split("p_type", " ").alias("tags")), ["STEEL", "BRASS"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS'])")
add("value_counts", lambda s, d: table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
add("driver_genes", lambda s, d: cl.drivers(table(s, d, "part"), "p_brand", 1000, 0.08), "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 80")
add("class_totals", lambda s, d: cl.class_totals(table(s, d, "part"), "p_type", "p_retailprice"), f"SELECT regexp_extract(p_type, '^([^( ]+)', 1) AS class, {R('sum(p_retailprice)')} AS total FROM part GROUP BY 1", "total")
# the rule's values are written out in the SQL
_STAGE = "CASE o_orderkey % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.4 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 0.5 END + CASE WHEN o_custkey % 3 = 0 THEN 0.2 WHEN o_custkey % 3 = 1 THEN 0.1 ELSE 0 END - CASE WHEN o_orderkey % 7 = 0 THEN 0.1 ELSE 0 END + CASE WHEN o_custkey % 100 > 70 THEN 0.1 ELSE 0 END + CASE WHEN o_orderkey % 5 >= 2 THEN 0.2 ELSE 0 END"


def _risks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stage = F.element_at(F.array(*map(F.lit, ("I", "stage ii", "Stage III", "IV", "unknown"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    genes = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in (("TP53", "PIK3CA"), ("BRAF", "MYC"), ("ALK", "RET")))), (F.col("o_custkey") % 3 + 1).cast("int"))
    rows = o.select(F.round(cl.risk_score(stage, genes, F.col("o_custkey") % 100, F.col("o_orderkey") % 5, F.col("o_orderkey") % 7 == 0), 6).alias("score"))
    return rows.groupBy("score", cl.risk_level(F.col("score")).alias("level")).agg(F.count("*").alias("n"))


add("clinical_risk", _risks, f"SELECT score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'intermediate' ELSE 'low' END AS level, count(*) AS n FROM (SELECT round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_STAGE})::DOUBLE)), 6) AS score FROM orders) GROUP BY 1, 2")
_GENES = ("TP53", "KRAS", "BRAF", "EGFR", "PIK3CA", "PTEN", "APC", "RB1", "MYC", "ERBB2")
_PGX = ("rs1_cyp2d6", "rs2_CYP2C19", "x_HLA-A", "ABCB1_3435", "abcg2", "NUDT15", "G6PD")
add("oncogenic_mutations", lambda s, d: cl.oncogenic(table(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _GENES)), (F.col("p_partkey") % 10 + 1).cast("int")).alias("gene")), "gene"), "SELECT p_partkey, gene FROM (SELECT p_partkey, ['TP53', 'KRAS', 'BRAF', 'EGFR', 'PIK3CA', 'PTEN', 'APC', 'RB1', 'MYC', 'ERBB2'][p_partkey % 10 + 1] AS gene FROM part) WHERE gene NOT IN ('MYC', 'ERBB2')")
add("pgx_variants", lambda s, d: table(s, d, "part").select("p_partkey", cl.first_gene_in(F.element_at(F.array(*map(F.lit, _PGX)), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("gene")).where("gene IS NOT NULL"), "SELECT p_partkey, gene FROM (SELECT p_partkey, ['CYP2D6', 'CYP2C19', 'HLA-A', 'ABCB1', 'ABCG2', NULL, NULL][p_partkey % 7 + 1] AS gene FROM part) WHERE gene IS NOT NULL")

# --- batch twins of the streams --------------------------------------------------------------------------------------


def _messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gene = F.element_at(F.array(*map(F.lit, ("EGFR", "BRCA2", "kras", "HER2", "MET"))), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 11 == 0, "nonsense").when(F.col("event_id") % 3 == 0, "data_update").otherwise("mutation_detected")
    return e.select("event_id", F.to_json(F.struct(kind.alias("type"), gene.alias("gene"), F.lit("V600E").alias("mutation"), F.col("user_id").cast("string").alias("sample_id"))).alias("value"))


_MSG = "m AS (SELECT event_id, ['EGFR', 'BRCA2', 'kras', 'HER2', 'MET'][event_id % 5 + 1] AS gene, CASE WHEN event_id % 11 = 0 THEN 'nonsense' WHEN event_id % 3 = 0 THEN 'data_update' ELSE 'mutation_detected' END AS type, user_id::VARCHAR AS sample_id FROM events)"
add("stream_mutation_alerts", lambda s, d: ms.mutation_alerts(ms.parsed(_messages(s, d))).groupBy("gene", "type", "severity").agg(F.count("*").alias("n")), query(_MSG, sql="SELECT gene, CASE WHEN gene IN ('EGFR', 'BRAF', 'KRAS', 'ALK', 'ROS1', 'BRCA1', 'BRCA2') THEN 'alert' ELSE 'status_update' END AS type, CASE WHEN gene IN ('EGFR', 'BRAF', 'KRAS', 'ALK', 'ROS1', 'BRCA1', 'BRCA2') THEN 'high' ELSE 'info' END AS severity, count(*) AS n FROM m WHERE type = 'mutation_detected' GROUP BY ALL"))
add("stream_processed", lambda s, d: ms.processed(ms.parsed(_messages(s, d))).groupBy("type").agg(F.count("*").alias("n")), query(_MSG, sql="SELECT CASE WHEN type = 'nonsense' THEN 'error' WHEN type = 'mutation_detected' AND gene IN ('EGFR', 'BRAF', 'KRAS', 'ALK', 'ROS1', 'BRCA1', 'BRCA2') THEN 'alert' ELSE 'status_update' END AS type, count(*) AS n FROM m GROUP BY 1"))
add("stream_rates", lambda s, d: ms.rates(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "1 hour", "1 hour").select("event_type", F.unix_micros("start").alias("start"), "n"), "SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, count(*) AS n FROM events GROUP BY 1, 2")
