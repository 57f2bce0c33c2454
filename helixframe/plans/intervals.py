"""Queries over intervals, alignments and survival times."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import intervals as iv
from helixframe.operators import survival as sv
from helixframe.plans.common import R, integers, query, rounded, table

QUERIES: dict = {}


def add(name: str, make, sql: str | None, *floats: str, ints: tuple[str, ...] = ()) -> None:
    QUERIES[name] = (lambda spark, sf_dir: integers(rounded(make(spark, sf_dir), *floats), *ints), sql)


# order lines as reads: the reference is the supplier modulo 4, the start follows from the order, the length from the quantity
def _reads(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_suppkey") % 4).alias("ref"), (F.col("l_orderkey") * 3).alias("start"), (F.col("l_orderkey") * 3 + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("name"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), (F.col("l_partkey") % 60).alias("mapq"), (F.col("l_orderkey") % 4096).alias("flag"))


_READS = "reads AS (SELECT l_suppkey % 4 AS ref, l_orderkey * 3 AS start, l_orderkey * 3 + l_quantity::BIGINT AS \"end\", l_orderkey * 8 + l_linenumber AS name, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_partkey % 60 AS mapq, l_orderkey % 4096 AS flag FROM lineitem)"
_MERGED = "m AS (SELECT ref, start, \"end\", sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY ref ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(\"end\") OVER (PARTITION BY ref ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}))"
add("merge_intervals", lambda s, d: iv.merged(_reads(s, d), "ref"), query(_READS, _MERGED.format(src="reads"), sql="SELECT ref, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM m GROUP BY ref, k"))
add("range_overlap", lambda s, d: iv.overlaps(_reads(s, d).where("strand = '-'").withColumn("id", F.col("name")), _reads(s, d).where("strand = '+'").withColumn("id", F.col("name")), "ref", 64), query(_READS, sql="SELECT a.name AS a_id, b.name AS b_id, least(a.\"end\", b.\"end\") - greatest(a.start, b.start) AS overlap FROM reads a JOIN reads b ON a.ref = b.ref AND a.start < b.\"end\" AND b.start < a.\"end\" WHERE a.strand = '-' AND b.strand = '+'"))
_STEPS = "ev AS (SELECT ref, pt, sum(d) AS d FROM (SELECT ref, start AS pt, 1 AS d FROM reads UNION ALL SELECT ref, \"end\", -1 FROM reads) GROUP BY 1, 2), steps AS (SELECT * FROM (SELECT ref, pt AS start, lead(pt) OVER (PARTITION BY ref ORDER BY pt) AS \"end\", (sum(d) OVER (PARTITION BY ref ORDER BY pt))::BIGINT AS depth FROM ev) WHERE \"end\" IS NOT NULL)"
add("coverage_depth", lambda s, d: iv.depth_steps(_reads(s, d), "ref"), query(_READS, _STEPS, sql="SELECT ref, start, \"end\", depth FROM steps"))
add("coverage_summary", lambda s, d: iv.coverage_summary(iv.depth_steps(_reads(s, d), "ref"), "ref", levels=(1, 10)), query(_READS, _STEPS, sql="SELECT ref, sum(n)::BIGINT AS span, " + ", ".join(f"{R(e)} AS {n}" for n, e in {"breadth": "sum(CASE WHEN depth > 0 THEN n ELSE 0 END) / sum(n)", "mean_depth": "sum(n * depth) / sum(n)", "at_least_1": "sum(CASE WHEN depth >= 1 THEN n ELSE 0 END) / sum(n)", "at_least_10": "sum(CASE WHEN depth >= 10 THEN n ELSE 0 END) / sum(n)"}.items()) + ", max(depth) AS max_depth FROM (SELECT *, \"end\" - start AS n FROM steps) GROUP BY ref"), "breadth", "mean_depth", "at_least_1", "at_least_10")
add("low_coverage_regions", lambda s, d: iv.low_regions(iv.depth_steps(_reads(s, d), "ref"), "ref", threshold=6, least=12), query(_READS, _STEPS, "low AS (SELECT ref, start, \"end\" FROM steps WHERE depth < 6)", _MERGED.format(src="low"), sql="SELECT * FROM (SELECT ref, min(start) AS start, max(\"end\") AS \"end\" FROM m GROUP BY ref, k) WHERE \"end\" - start >= 12"))
add("filter_alignments", lambda s, d: iv.filter_alignments(_reads(s, d)).select("name", "mapq"), query(_READS, sql="SELECT name, mapq FROM reads WHERE flag & 4 = 0 AND mapq >= 20 AND flag & 256 = 0 AND flag & 2048 = 0"))
add("dedup_best", lambda s, d: iv.without_duplicates(_reads(s, d)).select("name"), query(_READS, sql="SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY ref, CASE WHEN strand = '-' THEN \"end\" ELSE start END, strand ORDER BY mapq DESC, name) AS k FROM reads) WHERE k = 1"))
add("mark_duplicates", lambda s, d: iv.with_duplicates(_reads(s, d)).groupBy("ref").agg(F.count_if("duplicate").alias("n")), query(_READS, sql="SELECT ref, count(*) FILTER (WHERE k > 1) AS n FROM (SELECT ref, row_number() OVER (PARTITION BY ref, CASE WHEN strand = '-' THEN \"end\" ELSE start END, strand ORDER BY mapq DESC, name) AS k FROM reads) GROUP BY ref"))
add("alignment_statistics", lambda s, d: iv.alignment_statistics(_reads(s, d)), query(_READS, sql="SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE flag & {b} <> 0) AS {n}" for n, b in {"proper_pairs": 2, "secondary": 256, "supplementary": 2048, "duplicates": 1024, "reverse": 16}.items()) + f", count(*) FILTER (WHERE flag & 4 = 0) AS mapped, {R('avg(mapq) FILTER (WHERE flag & 4 = 0)')} AS mean_mapq, {R('''avg("end" - start) FILTER (WHERE flag & 4 = 0)''')} AS mean_length FROM reads"), "mean_mapq", "mean_length")
add("insert_size_stats", lambda s, d: iv.insert_sizes(table(s, d, "orders").select((F.col("o_orderkey") % 5).alias("lib"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("insert_size")), "insert_size", "lib").select("lib", "q1", "median", "q3", "n", "mean", "sd"), query("x AS (SELECT o_orderkey % 5 AS lib, floor(o_totalprice / 1000)::BIGINT AS s FROM orders WHERE floor(o_totalprice / 1000) <> 0), q AS (SELECT lib, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.75) AS q3 FROM x GROUP BY lib)", sql=f"SELECT lib, q1, median, q3, count(*) AS n, {R('avg(s)')} AS mean, {R('stddev_samp(s)')} AS sd FROM x JOIN q USING (lib) WHERE s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"), "mean", "sd")
add("pileup_consensus", lambda s, d: iv.pileup_consensus(iv.pileup(table(s, d, "benchmark").select((F.col("item_id") % 3).alias("ref"), (F.col("item_id") * 2).alias("start"), F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq")), "seq", "ref"), "ref"), query("p AS (SELECT ref, start + i - 1 AS pos, substr(seq, i, 1) AS base, count(*) AS n FROM (SELECT item_id % 3 AS ref, item_id * 2 AS start, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM benchmark), (SELECT unnest(range(1, 33)) AS i) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY ref, pos ORDER BY n DESC, base) AS k, sum(n) OVER (PARTITION BY ref, pos)::BIGINT AS depth FROM p)", sql=f"SELECT ref, pos, depth, CASE WHEN n / depth >= 0.5 THEN base ELSE 'N' END AS base, {R('n / depth')} AS share FROM r WHERE k = 1"), "share")
add("gene_clusters", lambda s, d: iv.clusters(_reads(s, d), "ref", 5).groupBy("ref", "cluster").agg(F.count("*").alias("n")).where("n >= 5"), query(_READS, sql="SELECT ref, cluster::BIGINT AS cluster, count(*) AS n FROM (SELECT ref, sum(b) OVER (PARTITION BY ref ORDER BY start, \"end\") AS cluster FROM (SELECT *, CASE WHEN start - lag(\"end\") OVER (PARTITION BY ref ORDER BY start, \"end\") > 5 THEN 1 ELSE 0 END AS b FROM reads)) GROUP BY 1, 2 HAVING count(*) >= 5"))
add("misassembly_gaps", lambda s, d: iv.misassemblies(_reads(s, d).withColumnRenamed("ref", "contig"), 20), query(_READS, sql="SELECT * FROM (SELECT ref AS contig, start, start - lag(\"end\") OVER (PARTITION BY ref ORDER BY start, \"end\") AS gap FROM reads) WHERE abs(gap) > 20"))
add("length_histogram", lambda s, d: iv.histogram(table(s, d, "documents"), "n_chars", 20, 0, 10000), "SELECT CASE WHEN n_chars < 0 THEN 0 WHEN n_chars >= 10000 THEN 21 ELSE floor(n_chars / 500)::BIGINT + 1 END AS bin, count(*) AS n FROM documents GROUP BY 1")
add("length_percentiles", lambda s, d: table(s, d, "documents").groupBy("lang").agg(*iv.percentiles("n_chars")), "SELECT lang, " + ", ".join(f"floor(quantile_cont(n_chars, {x / 100}))::BIGINT AS p{x}" for x in (10, 25, 50, 75, 90, 95, 99)) + " FROM documents GROUP BY lang")
add("best_non_overlapping", lambda s, d: iv.best_non_overlapping(_reads(s, d).select("ref", "start", "end", F.col("mapq").alias("score")), "ref", 5).groupBy("ref").agg(F.count("*").alias("n")), None)
add("merge_alignments", lambda s, d: iv.merge_sorted(_reads(s, d).where("strand = '-'"), _reads(s, d).where("strand = '+'")).select("ref", "start", "name"), query(_READS, sql="SELECT ref, start, name FROM reads ORDER BY ref, start, name"))
add("synteny_blocks", lambda s, d: iv.synteny_blocks(table(s, d, "lineitem").select((F.col("l_suppkey") % 3).cast("string").alias("chrom1"), F.col("l_orderkey").alias("pos1"), F.lit("x").alias("chrom2"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("pos2")), 1000), None)


# --- survival: days from a user's first event to the first purchase ------------------------------------------------------------


def _times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = lambda c: F.floor(F.unix_micros(c) / 86_400_000_000)
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("stop"))
    u = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("bought"), F.avg("value").alias("marker"))
    return u.crossJoin(F.broadcast(last)).select("user_id", (F.col("user_id") % 2).alias("arm"), (day(F.coalesce("bought", "stop")) - day(F.col("first"))).alias("time"), F.col("bought").isNotNull().alias("event"), "marker")


_TIMES = "times AS (SELECT user_id, user_id % 2 AS arm, floor(epoch_us(coalesce(bought, (SELECT max(ts) FROM events))) / 86400000000.0)::BIGINT - floor(epoch_us(first) / 86400000000.0)::BIGINT AS time, bought IS NOT NULL AS event, marker FROM (SELECT user_id, min(ts) AS first, min(ts) FILTER (WHERE event_type = 'purchase') AS bought, avg(value) AS marker FROM events GROUP BY user_id))"
_RISK = "risk AS (SELECT arm, time, sum(event::INT)::BIGINT AS events, count(*) AS c, (sum(count(*)) OVER (PARTITION BY arm ORDER BY time DESC))::BIGINT AS at_risk FROM times GROUP BY arm, time)"
add("km_risk_table", lambda s, d: sv.risk_table(_times(s, d), "arm").drop("leaving"), query(_TIMES, _RISK, sql="SELECT arm, time, events, at_risk FROM risk"))
_CURVE = "curve AS (SELECT arm, time, events, at_risk, CASE WHEN min(1 - events / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w) END AS survival, min(at_risk - events) OVER w AS left_, sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) END) OVER w AS g FROM risk WHERE events > 0 WINDOW w AS (PARTITION BY arm ORDER BY time ROWS UNBOUNDED PRECEDING))"
add("km_curve", lambda s, d: sv.kaplan_meier(_times(s, d), "arm").select("arm", "time", "events", "at_risk", "survival", "std_error"), query(_TIMES, _RISK, _CURVE, sql=f"SELECT arm, time, events, at_risk, {R('coalesce(survival, 0)')} AS survival, CASE WHEN left_ > 0 THEN {R('survival * sqrt(g)')} END AS std_error FROM curve"), "survival", "std_error")
add("km_median", lambda s, d: sv.median_survival(sv.kaplan_meier(_times(s, d), "arm"), "arm"), query(_TIMES, _RISK, _CURVE, sql="SELECT arm, min(time) FILTER (WHERE survival <= 0.5) AS median FROM curve GROUP BY arm"))
_LR = "t AS (SELECT time, sum(event::INT) AS d, count(*) AS c, sum(event::INT) FILTER (WHERE arm = 0) AS d1, count(*) FILTER (WHERE arm = 0) AS c1 FROM times GROUP BY time), r AS (SELECT time, d, coalesce(d1, 0) AS d1, sum(c) OVER (ORDER BY time DESC) AS n, sum(c1) OVER (ORDER BY time DESC) AS n1 FROM t)"
add("logrank_oev", lambda s, d: sv.logrank(_times(s, d), "arm").drop("p_value"), query(_TIMES, _LR, sql=f"SELECT o AS observed, {R('e')} AS expected, {R('v')} AS variance, {R('(o - e) ^ 2 / v')} AS chi2 FROM (SELECT sum(d1)::BIGINT AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r WHERE d > 0)"), "expected", "variance", "chi2")
add("logrank_groups", lambda s, d: sv.logrank_groups(_times(s, d).withColumn("arm", F.col("user_id") % 3), "arm"), query(_TIMES, "h AS (SELECT time, sum(d / n) OVER (ORDER BY time) AS cum FROM (SELECT time, sum(event::INT) AS d, sum(count(*)) OVER (ORDER BY time DESC) AS n FROM times GROUP BY time) WHERE d > 0)", sql=f"SELECT user_id % 3 AS arm, sum(event::INT)::BIGINT AS observed, {R('sum(coalesce((SELECT max(cum) FROM h WHERE h.time <= times.time), 0))')} AS expected, count(*) AS n FROM times GROUP BY 1"), "expected")
for _how, _sql in {"median": "CASE WHEN marker > (SELECT median(marker) FROM times) THEN 'high' ELSE 'low' END", "mean": "CASE WHEN marker > (SELECT avg(marker) FROM times) THEN 'high' ELSE 'low' END", "quartile": "CASE WHEN marker <= (SELECT quantile_cont(marker, 0.25) FROM times) THEN 'low' WHEN marker > (SELECT quantile_cont(marker, 0.75) FROM times) THEN 'high' ELSE 'middle' END"}.items():
    add(f"cutoff_{_how}", lambda s, d, how=_how: sv.cutoff_groups(_times(s, d), "marker", how).groupBy("level").agg(F.count("*").alias("n"), F.count_if("event").alias("events")), query(_TIMES, sql=f"SELECT {_sql} AS level, count(*) AS n, count(*) FILTER (WHERE event) AS events FROM times GROUP BY 1"))
add("cox_univariate", lambda s, d: sv.cox(_times(s, d).withColumn("arm", F.lit(0)), "arm", ["marker"]), None, "coefficient", "hazard_ratio", "std_error", "z", "p_value")
