"""Queries of annotation and scaffolding: proteins and long DNA made of whole texts, orders and their lines as assembly graphs and read pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import annotation as an
from helixframe.operators import scaffolds as sc
from helixframe.plans.common import DNA, EXPRESSION, PROTEINS, TEXT_DNA, R, dna, expression, proteins, query, rounded, table, text_dna

QUERIES: dict = {}


def add(name: str, make, sql: str | None, *floats: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: rounded(make(spark, sf_dir), *floats), sql)


# the values of the SQL are written out, so that a wrong table in the operators shows
_HITS = "hits AS (SELECT * FROM (VALUES ('PF00069', 'Pkinase', 'GAGGV', 42.0::DOUBLE, 0.00002::DOUBLE), ('PF00001', 'Rhodopsin', 'DRYLAIV', 30.0, 0.0005), ('PF00076', 'RRM_1', 'RNPXKG', 28.0, 0.001)) AS t(domain_id, name, motif, score, evalue))"
add("protein_profile_hits", lambda s, d: an.profile_hits(proteins(s, d), "doc_id"), query(PROTEINS, _HITS, sql=f"SELECT doc_id, domain_id, name, strpos(seq, motif)::BIGINT - 1 AS start, strpos(seq, motif)::BIGINT - 1 + length(motif) AS end, score, {R('evalue')} AS evalue, {R('length(motif) / length(seq)')} AS coverage FROM proteins, hits WHERE strpos(seq, motif) > 0"), "evalue", "coverage")


def _n(chars: str) -> str:
    return f"(length(seq) - length(translate(seq, '{chars}', '')))"


_TERMS = f"""
SELECT doc_id,
 CASE WHEN seq LIKE '%GAGGV%' THEN 'Protein kinase domain-containing protein' WHEN seq LIKE '%DRYLAIV%' THEN '7 transmembrane receptor-containing protein' WHEN seq LIKE '%RNPXKG%' THEN 'RNA recognition motif-containing protein' END AS product,
 CASE WHEN length(seq) > 0 THEN {R("CASE WHEN seq LIKE '%GAGGV%' THEN 0.42::DOUBLE WHEN seq LIKE '%DRYLAIV%' THEN 0.3 WHEN seq LIKE '%RNPXKG%' THEN 0.28 ELSE 0 END")} END AS confidence,
 CASE WHEN length(seq) = 0 THEN NULL WHEN {_n("C")} / length(seq) > 0.08 THEN 'GO:0005576,GO:0008150' WHEN seq LIKE '%RRRK%' OR seq LIKE '%KRAR%' THEN 'GO:0003677,GO:0006355,GO:0008150'
  WHEN seq LIKE '%DE%' AND {_n("E")} / length(seq) > 0.12 THEN 'GO:0003824,GO:0008150' ELSE 'GO:0008150' END AS go_terms,
 CASE WHEN seq LIKE '%MEEPQ%' THEN 'K04451' WHEN seq LIKE '%GAGGV%' THEN 'K00001' END AS ko,
 CASE WHEN seq LIKE '%MEEPQ%' THEN 'map04115' WHEN seq LIKE '%GAGGV%' THEN 'map00010,map00071' END AS pathways,
 CASE WHEN seq NOT LIKE '%MEEPQ%' AND seq LIKE '%GAGGV%' THEN '1.1.1.1' END AS kegg_enzyme,
 CASE WHEN length(seq) = 0 THEN NULL WHEN {_n("AILVFWYM")} / length(seq) > 0.34 THEN 'COG0207' WHEN {_n("DEKRH")} / length(seq) > 0.22 THEN 'COG0533' ELSE 'COG0539' END AS cog,
 CASE WHEN length(seq) = 0 THEN NULL WHEN {_n("AILVFWYM")} / length(seq) > 0.34 THEN 'M' WHEN {_n("DEKRH")} / length(seq) > 0.22 THEN 'T' ELSE 'S' END AS cog_category,
 CASE WHEN seq LIKE '%GAGGV%' THEN '2.7.11.1' WHEN seq LIKE '%GHSAG%' THEN '3.1.1.3' END AS enzyme
FROM proteins"""
add("protein_terms", lambda s, d: an.protein_terms(proteins(s, d), "doc_id").withColumns({c: F.array_join(c, ",") for c in ("go_terms", "pathways")}), query(PROTEINS, sql=_TERMS), "confidence")

_STRANDS = "strands AS (SELECT doc_id, length(seq) AS n, '+' AS strand, seq AS s FROM text_dna UNION ALL SELECT doc_id, length(seq), '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM text_dna)"
_PLACE = "CASE strand WHEN '+' THEN a + 1 ELSE n - b + 1 END::BIGINT AS first, CASE strand WHEN '+' THEN b ELSE n - a END::BIGINT AS last, strand"
_PAIRS = " + ".join(f"CASE WHEN substr(w, {j}, 1) || substr(w, {73 - j}, 1) IN ('AT', 'TA', 'GC', 'CG', 'GT', 'TG') THEN 5 ELSE 0 END" for j in range(1, 8))
_WINDOWS = "w AS (SELECT doc_id, n, strand, i AS a, i + 75 AS b, substr(s, i + 1, 95) AS w FROM (SELECT *, unnest(range(0, n - 73)) AS i FROM strands))"
_SCORED = f"scored AS (SELECT *, (CASE WHEN w LIKE '%CCA' THEN 20 ELSE 0 END + CASE WHEN substr(w, 8, 1) = 'T' THEN 10 ELSE 0 END + CASE WHEN substr(w, 14, 1) = 'A' THEN 10 ELSE 0 END + {_PAIRS})::DOUBLE AS score FROM w)"
add("trna_scan", lambda s, d: an.transfer_rna(text_dna(s, d), "doc_id"), query(TEXT_DNA, _STRANDS, _WINDOWS, _SCORED, sql=f"SELECT doc_id, {_PLACE}, score, substr(w, 34, 3) AS anticodon FROM scored WHERE score > 50"))
_STRETCHES = "m AS (SELECT * FROM (VALUES ('16S', 700, 'GGATTAGATACCC'), ('16S', 700, 'TTTAATTGACTCAACG'), ('23S', 1400, 'GACTAAGG'), ('23S', 1400, 'GTCCTGACT')) AS t(kind, half, motif))"
_FOUND = "f AS (SELECT doc_id, n, strand, kind, motif, greatest(0, i - half) AS a, least(n, i + half) AS b FROM (SELECT *, unnest(range(0, n)) AS i FROM strands, m WHERE s LIKE '%' || motif || '%') WHERE substr(s, i + 1, length(motif)) = motif)"
add("rrna_find", lambda s, d: an.ribosomal_rna(text_dna(s, d), "doc_id"), query(TEXT_DNA, _STRANDS, _STRETCHES, _FOUND, sql=f"SELECT doc_id, {_PLACE}, kind || ' ribosomal RNA' AS product, {R('least(100.0, length(motif) * 12.0 + least(60.0, greatest(1, b - a) * 0.02))::DOUBLE')} AS score FROM f"), "score")
add("crispr_arrays", lambda s, d: an.crispr_arrays(text_dna(s, d), "doc_id"), None)
_MARKS = "m AS (SELECT unnest(['GTAGTCATATGCTTGTCTC', 'ACCTGTTGATCCGCCA', 'AGAGTTTGATCCTGGCTCAG', 'ATGGCAATCGCTGAA', 'ATGAGCGATCTGGCG']) AS w), c AS (SELECT lang, w, sum((length(seq) - length(replace(seq, w, ''))) // length(w)) AS k, bool_or(seq LIKE '%' || left(w, length(w) // 2) || '%' OR seq LIKE '%' || right(w, length(w) // 2) || '%') AS part FROM text_dna, m GROUP BY 1, 2)"
add("marker_completeness", lambda s, d: an.marker_completeness(text_dna(s, d), ["lang"]), query(TEXT_DNA, _MARKS, sql="SELECT lang, count(*) FILTER (WHERE k > 0) AS complete, count(*) FILTER (WHERE k = 1) AS single, count(*) FILTER (WHERE k > 1) AS duplicated, count(*) FILTER (WHERE k = 0 AND part) AS fragmented, count(*) FILTER (WHERE k = 0 AND NOT part) AS missing, count(*) AS total FROM c GROUP BY lang"))


def _nodes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (F.col("o_orderkey") % 2000).alias("length"))
    return orders.union(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.col("c_custkey") % 2000))


def _bought(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))


add("assembly_tips", lambda s, d: sc.tips(_bought(s, d), _nodes(s, d)), "SELECT 'o' || o_orderkey AS node, o_orderkey % 2000 AS length FROM orders WHERE o_orderkey % 2000 <= 1000 UNION ALL SELECT 'c' || c_custkey, c_custkey % 2000 FROM customer JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1) ON c_custkey = o_custkey WHERE c_custkey % 2000 <= 1000")


def _ways(spark, sf_dir):
    """Orders to their lines, lines to suppliers, those to nations and regions."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("l"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    return lines.select(F.col("o").alias("src"), F.col("l").alias("dst")).union(lines.select("l", "s")).union(suppliers).union(nations)


_TWO = "l AS (SELECT DISTINCT l_orderkey, l_suppkey, 'l' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS node FROM lineitem), x AS (SELECT l_orderkey, min(node) AS i, max(node) AS j, min_by(l_suppkey, node) AS s, max_by(l_suppkey, node) AS t FROM l GROUP BY 1 HAVING count(*) = 2)"
_PATH = "{i} || ',s' || {s} || ',n' || {a}.s_nationkey || ',r' || {r}.n_regionkey"
add("assembly_bubbles", lambda s, d: sc.bubbles(_ways(s, d)).withColumns({c: F.array_join(c, ",") for c in ("path1", "path2")}), query(_TWO, sql=f"SELECT 'o' || l_orderkey AS source, 'r' || p.n_regionkey AS sink, {_PATH.format(i='i', s='s', a='a', r='p')} AS path1, {_PATH.format(i='j', s='t', a='b', r='q')} AS path2 FROM x JOIN supplier a ON a.s_suppkey = s JOIN supplier b ON b.s_suppkey = t JOIN nation p ON p.n_nationkey = a.s_nationkey JOIN nation q ON q.n_nationkey = b.s_nationkey WHERE p.n_regionkey = q.n_regionkey"))


def _mates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("mate"), (F.col("l_suppkey") % 20).alias("contig"), (F.col("l_partkey") % 400).alias("pos"))


_MATES = "mates AS (SELECT l_orderkey AS pair, l_linenumber AS mate, contig, e, CASE e WHEN '3' THEN length - pos ELSE pos END AS rest FROM (SELECT *, CASE WHEN pos > length / 2 THEN '3' ELSE '5' END AS e FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS contig, l_partkey % 400 AS pos, 400 + l_suppkey % 20 AS length FROM lineitem)))"
_GAPS = "gaps AS (SELECT x.contig AS contig1, x.e AS end1, y.contig AS contig2, y.e AS end2, 500 - x.rest - y.rest AS gap FROM mates x JOIN mates y ON x.pair = y.pair AND x.mate < y.mate JOIN (SELECT pair FROM mates GROUP BY pair HAVING count(*) = 2) z ON z.pair = x.pair WHERE x.contig <> y.contig)"
add("scaffold_links", lambda s, d: sc.pair_links(_mates(s, d), s.range(20).select(F.col("id").alias("contig"), (F.col("id") + 400).alias("length"))), query(_MATES, _GAPS, sql="SELECT contig1, end1, contig2, end2, trunc(median(gap))::BIGINT AS gap, count(*) AS support FROM gaps GROUP BY ALL HAVING count(*) >= 2"))


def _drafts(spark, sf_dir):
    """One draft for each different DNA, with base 20 put wrong."""
    one = dna(spark, sf_dir).groupBy("seq").agg(F.min("doc_id").alias("draft"))
    return one.select("draft", F.concat(F.substring("seq", 1, 20), F.translate(F.substring("seq", 21, 1), "ACGT", "TGCA"), F.substring("seq", 22, 43)).alias("seq"))


_SHARED = """drafts AS (SELECT min(doc_id) AS draft, substr(seq, 1, 20) || translate(substr(seq, 21, 1), 'ACGT', 'TGCA') || substr(seq, 22, 43) AS seq FROM dna GROUP BY dna.seq), places AS (SELECT unnest(range(1, 65)) AS i),
 dw AS (SELECT draft, length(seq) AS size, i AS p, substr(seq, i, 15) AS kmer FROM drafts JOIN places ON i <= length(seq) - 14), rw AS (SELECT doc_id, length(seq) AS size, i, substr(seq, i, 15) AS kmer FROM dna JOIN places ON i <= length(seq) - 14),
 hits AS (SELECT doc_id, draft, p - i AS start, count(*) AS n FROM dw JOIN rw USING (kmer) WHERE p - i BETWEEN 0 AND dw.size - rw.size GROUP BY ALL),
 placed AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, draft ORDER BY n DESC, start) = 1)"""
_AGREED = """w AS (SELECT draft, start + i - 1 AS pos, substr(seq, i, 1) AS base, 10 * count(*) AS w FROM placed JOIN dna USING (doc_id) JOIN places ON i <= length(seq) GROUP BY ALL),
 won AS (SELECT draft, pos, base, w, sum(w) OVER (PARTITION BY draft, pos)::BIGINT AS weight FROM w QUALIFY row_number() OVER (PARTITION BY draft, pos ORDER BY w DESC, base) = 1),
 old AS (SELECT draft, i - 1 AS pos, substr(seq, i, 1) AS old FROM drafts JOIN places ON i <= length(seq)),
 changes AS (SELECT draft, pos, old, base AS new, weight FROM won JOIN old USING (draft, pos) WHERE weight >= 3 AND w >= weight * 0.6 AND old <> base)"""
add("polish_corrections", lambda s, d: sc.corrections(_drafts(s, d), dna(s, d), "draft", "doc_id"), query(DNA, _SHARED, _AGREED, sql="SELECT * FROM changes"))
add("polish_drafts", lambda s, d: sc.polished(_drafts(s, d), dna(s, d), "draft", "doc_id"), query(DNA, _SHARED, _AGREED, "mended AS (SELECT draft, string_agg(coalesce(new, old), '' ORDER BY pos) AS seq, count(new) AS n FROM old LEFT JOIN changes USING (draft, pos, old) GROUP BY draft)", sql="SELECT draft, mended.seq AS seq, coalesce(n, 0) AS n_corrections FROM drafts LEFT JOIN mended USING (draft)"))



def _orders_of_parts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("gene"))


def _alike(spark, sf_dir):
    """Each part is alike itself and the part before it."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("gene1"), F.col("p_partkey").alias("gene2"), F.lit(1.0).alias("score")).union(p.select("p_partkey", F.col("p_partkey") - 1, (F.col("p_partkey") % 10) / 10))


def _next_orders(spark, sf_dir):
    return _orders_of_parts(spark, sf_dir).select(F.col("cluster").alias("cluster1"), (F.col("cluster") + 1).alias("cluster2")).distinct()


_MEMBERS = "g AS (SELECT DISTINCT l_orderkey AS cluster, l_partkey AS gene FROM lineitem), z AS (SELECT cluster, count(*) AS n FROM g GROUP BY 1), p AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + 1 AS b FROM lineitem), h AS (SELECT p.a, p.b, count(DISTINCT x.gene) AS matched FROM p JOIN g x ON x.cluster = p.a JOIN g y ON y.cluster = p.b WHERE (x.gene = y.gene AND EXISTS (SELECT 1 FROM part WHERE p_partkey = x.gene)) OR (y.gene = x.gene - 1 AND x.gene % 10 > 5 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = x.gene)) OR (x.gene = y.gene - 1 AND y.gene % 10 > 5 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = y.gene)) GROUP BY 1, 2)"
add("cluster_similarity", lambda s, d: an.cluster_similarity(_orders_of_parts(s, d), _alike(s, d), _next_orders(s, d)), query(_MEMBERS, sql=f"SELECT p.a AS cluster1, p.b AS cluster2, coalesce(matched, 0)::BIGINT AS matched, {R('coalesce(matched, 0) / (x.n + coalesce(y.n, 0) - coalesce(matched, 0))')} AS similarity FROM p LEFT JOIN h USING (a, b) JOIN z x ON x.cluster = p.a LEFT JOIN z y ON y.cluster = p.b"), "similarity")


def _lipids(spark, sf_dir):
    name = F.concat(F.lit("PC(16:"), F.col("o_orderkey") % 3, F.lit("/18:"), F.col("o_orderkey") % 4, F.lit(")"))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("sample"), name.alias("feature"), (F.col("o_orderkey") % 100).cast("double").alias("value"))


_CHAIN = "sum(o_orderkey % 100 * (CASE WHEN o_orderkey % 3 {c} THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 {c} THEN 1 ELSE 0 END))::DOUBLE"
add("fatty_acids", lambda s, d: an.fatty_acids(_lipids(s, d)), f"SELECT o_custkey % 50 AS sample, {_CHAIN.format(c='= 0')} AS saturated, {_CHAIN.format(c='= 1')} AS monounsaturated, {_CHAIN.format(c='> 1')} AS polyunsaturated FROM orders GROUP BY 1")
add("methylation_age", lambda s, d: (lambda x: an.methylation_age(x, x.select("feature").distinct().withColumn("weight", (F.col("feature") % 5 - 2).cast("double"))))(expression(s, d)), query(EXPRESSION, "c AS (SELECT DISTINCT feature, (feature % 5 - 2)::DOUBLE AS weight FROM expression), t AS (SELECT sample, sum(value * weight) / (SELECT sqrt(sum(weight * weight)) + 1e-9 FROM c) AS s FROM expression JOIN c USING (feature) GROUP BY sample)", sql=f"SELECT sample, {R('greatest(0, least(110, 21 + 50 * (exp(2 * s) - 1) / (exp(2 * s) + 1)))')} AS age FROM t"), "age")


def _articles(spark, sf_dir):
    person = F.array(F.struct(F.col("source").alias("last_name"), F.col("lang").alias("first_name")), F.struct(F.lit("Roe").alias("last_name"), F.lit("R").alias("first_name")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), F.md5("text").alias("title"), person.alias("authors"), F.col("source").alias("journal"), F.when(F.col("doc_id") % 3 > 0, 2000 + F.col("doc_id") % 20).alias("year"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), "doc_id")).alias("doi"))


add("bibtex_entries", lambda s, d: an.bibtex(_articles(s, d)), "SELECT doc_id AS pmid, concat('@article{', doc_id, ',', chr(10), '  title = {', md5(text), '},', chr(10), '  author = {', source, ', ', lang, ' and Roe, R},', chr(10), '  journal = {', source, '},', chr(10), '  year = {', CASE WHEN doc_id % 3 > 0 THEN (2000 + doc_id % 20)::VARCHAR ELSE 'n.d.' END, '},', chr(10), '  pmid = {', doc_id, '},', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '  doi = {10.1/', doc_id, '},') ELSE '' END, chr(10), '}') AS entry FROM documents")
_LENGTHS = "c AS (SELECT lang, length(seq) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(seq) DESC, doc_id) AS k, sum(length(seq)) OVER (PARTITION BY lang ORDER BY length(seq) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum, sum(length(seq)) OVER (PARTITION BY lang) AS total FROM text_dna WHERE seq IS NOT NULL), r AS (SELECT lang, max(len) FILTER (WHERE cum >= total * 0.5) AS n50, max(total)::BIGINT AS total, count(*) AS n FROM c GROUP BY lang)"
add("assembly_ranking", lambda s, d: sc.rank_assemblies(text_dna(s, d), "lang"), query(TEXT_DNA, _LENGTHS, sql=f"SELECT lang, n50, total, n, 0.0::DOUBLE AS n_percent, {R('n50 * 0.3 / 1000000 + total * 0.2 / 1000000000 - n * 0.1 / 1000')} AS score FROM r"), "n_percent", "score")


def _gapped(spark, sf_dir):
    """One scaffold for each different DNA: its first 24 bases, 8 unknown ones, and its last 32, turned for every other scaffold."""
    one = dna(spark, sf_dir).groupBy("seq").agg(F.min("doc_id").alias("scaffold"))
    turned = F.col("scaffold") % 2 == 1
    second = F.substring("seq", 33, 32)
    first = one.select("scaffold", F.lit(0).alias("i"), F.substring("seq", 1, 24).alias("seq"), F.lit("+").alias("orientation"), F.lit(0).alias("gap"))
    return first.union(one.select("scaffold", F.lit(1), F.when(turned, F.reverse(F.translate(second, "ACGT", "TGCA"))).otherwise(second), F.when(turned, "-").otherwise("+"), F.lit(8)))


add("fill_gaps", lambda s, d: sc.fill_gaps(_gapped(s, d), dna(s, d), "doc_id"), query(DNA, sql="SELECT min(doc_id) AS scaffold, 1 AS i, min(doc_id) AS doc_id, substr(seq, 25, 8) AS fill FROM dna WHERE seq IS NOT NULL GROUP BY seq"))
