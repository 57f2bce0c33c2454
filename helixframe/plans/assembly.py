"""Queries of read mapping and assembly: reads cut from the DNA of whole texts, with planted changes, held against all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import assembly as am
from helixframe.operators import chaining as ch
from helixframe.operators import genes as gn
from helixframe.operators import layout as ly
from helixframe.operators import mapping as mp
from helixframe.plans.common import TEXT_DNA, R, query, rounded, table, text_dna

QUERIES: dict = {}


def add(name: str, make, sql: str | None, *floats: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: rounded(make(spark, sf_dir), *floats), sql)


def _long(spark, sf_dir):
    """text_dna with its expression evaluated once a row, however often it is used."""
    return text_dna(spark, sf_dir).select("doc_id", F.explode(F.array("seq")).alias("seq"))


def _changed(s, at):
    """`s` with the base at `at` (from 1) replaced by the next one."""
    return F.overlay(s, F.translate(s.substr(at, F.lit(1)), "ACGT", "CGTA"), at, F.lit(1))


def _mates(spark, sf_dir):
    """Of every text of 400 bases or more a read with up to two changes and its mate from the other strand: read_id, one, two."""
    rows = _long(spark, sf_dir).where(F.length("seq") >= 400).withColumn("pos", (F.col("doc_id") * 37 % (F.length("seq") - 340)).cast("int"))
    one = F.col("seq").substr(F.col("pos") + 1, F.lit(48))
    one = _changed(_changed(one, (F.col("doc_id") % 48 + 1).cast("int")), ((F.col("doc_id") * 7 + 11) % 48 + 1).cast("int"))
    two = sq.reverse_complement(F.col("seq").substr((F.col("pos") + 81 + F.col("doc_id") % 200).cast("int"), F.lit(48)))
    odd = F.col("doc_id") % 2 == 1
    return rows.select(F.col("doc_id").alias("read_id"), F.when(odd, sq.reverse_complement(one)).otherwise(one).alias("one"), F.when(odd, sq.reverse_complement(two)).otherwise(two).alias("two"))


def _contigs(spark, sf_dir):
    return _long(spark, sf_dir).select(F.col("doc_id").alias("contig"), "seq")


_READS = """raw AS (SELECT doc_id, substr(seq, (doc_id * 37 % (length(seq) - 340) + 1)::INT, 48) AS s, substr(seq, (doc_id * 37 % (length(seq) - 340) + 81 + doc_id % 200)::INT, 48) AS t, (doc_id % 48 + 1)::INT AS i, ((doc_id * 7 + 11) % 48 + 1)::INT AS j FROM text_dna WHERE length(seq) >= 400),
 once AS (SELECT *, substr(s, 1, i - 1) || translate(substr(s, i, 1), 'ACGT', 'CGTA') || substr(s, i + 1) AS u FROM raw), twice AS (SELECT *, substr(u, 1, j - 1) || translate(substr(u, j, 1), 'ACGT', 'CGTA') || substr(u, j + 1) AS v FROM once),
 mates AS (SELECT doc_id AS read_id, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(v, 'ACGT', 'TGCA')) ELSE v END AS one, CASE WHEN doc_id % 2 = 1 THEN t ELSE reverse(translate(t, 'ACGT', 'TGCA')) END AS two FROM twice)"""
_WINDOWS = "w AS (SELECT doc_id AS contig, i - 1 AS place, substr(seq, i, 16) AS k FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 14)) AS i FROM text_dna))"


def _places(name: str, reads: str, both: bool = True) -> str:
    """The SQL of all places of the reads (read_id, s), by thirds of 16 bases."""
    strands = f"SELECT read_id, '+' AS strand, s FROM {reads}" + (f" UNION ALL SELECT read_id, '-', reverse(translate(s, 'ACGT', 'TGCA')) FROM {reads}" if both else "")
    return f"""{name}_s AS ({strands}), {name}_o AS (SELECT DISTINCT read_id, strand, s, contig, place - p * 16 AS start FROM (SELECT *, unnest([0, 1, 2]) AS p FROM {name}_s) AS r JOIN w ON substr(s, p * 16 + 1, 16) = k),
 {name} AS (SELECT * FROM (SELECT read_id, contig, start, strand, CASE WHEN start >= 0 AND start + length(s) <= length(seq) THEN hamming(substr(seq, start::INT + 1, length(s)), s) ELSE 9 END AS mismatches FROM {name}_o JOIN text_dna ON doc_id = contig) WHERE mismatches <= 2)"""


_ONE, _TWO = "r1 AS (SELECT read_id, one AS s FROM mates)", "r2 AS (SELECT read_id, two AS s FROM mates)"
add("map_reads", lambda s, d: mp.best_places(_mates(s, d).select("read_id", F.col("one").alias("seq")), _contigs(s, d)), query(TEXT_DNA, _READS, _WINDOWS, _ONE, _places("p", "r1"), sql="""
SELECT read_id, b.contig AS contig, b.start AS start, b.strand AS strand, b.mismatches AS mismatches, (60 - 10 * b.mismatches)::INT AS quality, '48M' AS cigar, n_places, n_best FROM
 (SELECT read_id, min({'mismatches': mismatches, 'contig': contig, 'start': start, 'strand': strand}) AS b, count(*) AS n_places, count(*) FILTER (mismatches = least) AS n_best FROM (SELECT *, min(mismatches) OVER (PARTITION BY read_id) AS least FROM p) GROUP BY read_id)"""))
add("map_pairs", lambda s, d: mp.best_pairs(_mates(s, d), _contigs(s, d)), query(TEXT_DNA, _READS, _WINDOWS, _ONE, _TWO, _places("p", "r1"), _places("q", "r2"), sql="""
SELECT read_id, b.contig AS contig, b.a AS start1, b.s AS strand1, b.b AS start2, b.t AS strand2, b.m AS mismatches, b.b - b.a + 48 AS template FROM
 (SELECT read_id, min({'m': p.mismatches + q.mismatches, 'contig': contig, 'a': p.start, 'b': q.start, 's': p.strand, 't': q.strand}) AS b FROM p JOIN q USING (read_id, contig) WHERE p.strand <> q.strand AND abs(q.start - p.start) + 48 BETWEEN 100 AND 1000 GROUP BY read_id)"""))


def _transcripts(spark, sf_dir):
    """Reads over an intron from the first GT behind 60 bases to the first AG 160 bases on."""
    rows = _long(spark, sf_dir).withColumn("a", F.explode(F.array(F.expr("locate('GT', seq, 61)")))).withColumn("b", F.explode(F.array(F.expr("locate('AG', seq, a + 160)")))).where("a > 0 AND b > 0 AND length(seq) >= b + 50")
    return rows.select(F.col("doc_id").alias("read_id"), F.concat(F.col("seq").substr(F.col("a") - 48, F.lit(48)), F.col("seq").substr(F.col("b") + 2, F.lit(48))).alias("seq")).withColumn("seq", F.explode(F.array("seq")))


_TRANSCRIPTS = """f AS (SELECT doc_id, seq, strpos(substr(seq, 61), 'GT') AS x FROM text_dna), g AS (SELECT *, x + 60 AS a, strpos(substr(seq, x + 220), 'AG') AS y FROM f WHERE x > 0),
 t AS (SELECT doc_id AS read_id, substr(seq, a - 48, 48) || substr(seq, y + a + 161, 48) AS s FROM g WHERE y > 0 AND length(seq) >= y + a + 159 + 50)"""
_WHOLE = "w2 AS (SELECT doc_id AS contig, i - 1 AS place, substr(seq, i, 32) AS k FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 30)) AS i FROM text_dna))"
_FITS = "fits AS (SELECT DISTINCT read_id FROM (SELECT *, unnest([0, 1, 2]) AS p FROM t) AS o JOIN w2 ON substr(s, p * 32 + 1, 32) = k JOIN text_dna ON doc_id = contig WHERE CASE WHEN place - p * 32 >= 0 AND place - p * 32 + 96 <= length(seq) THEN hamming(substr(seq, (place - p * 32)::INT + 1, 96), s) ELSE 9 END <= 2)"
_HALVES = "h1 AS (SELECT read_id, substr(s, 1, 48) AS s FROM t WHERE read_id NOT IN (SELECT read_id FROM fits)), h2 AS (SELECT read_id, substr(s, 49) AS s FROM t WHERE read_id NOT IN (SELECT read_id FROM fits))"
add("map_spliced", lambda s, d: mp.spliced(_transcripts(s, d), _contigs(s, d)), query(TEXT_DNA, _TRANSCRIPTS, _WINDOWS, _WHOLE, _FITS, _HALVES, _places("p", "h1", False), _places("q", "h2", False), sql="""
SELECT read_id, b.contig AS contig, b.start AS start, b.start + 48 AS intron_start, b.e AS intron_end, '48M' || (b.e - b.start - 48) || 'N48M' AS cigar, b.m AS mismatches FROM
 (SELECT read_id, min({'m': p.mismatches + q.mismatches, 'contig': contig, 'start': p.start, 'e': q.start}) AS b FROM p JOIN q USING (read_id, contig) JOIN text_dna ON doc_id = contig
  WHERE q.start - p.start - 48 > 50 AND q.start - p.start - 48 < 500000 AND substr(seq, p.start::INT + 49, 2) = 'GT' AND substr(seq, q.start::INT - 1, 2) = 'AG' GROUP BY read_id)"""))


def _passages(spark, sf_dir):
    """The DNA of all benchmark passages: item_id, g."""
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"))).alias("g"))


def planted_reads(spark, sf_dir):
    """Reads of 60 bases at every sixth base of the DNA of all benchmark passages, every eighth with a wrong base: read_id, seq, truth."""
    cut = _passages(spark, sf_dir).where(F.length("g") >= 60).select("item_id", "g", F.explode(F.sequence(F.lit(0), F.length("g") - 60, F.lit(6))).alias("i")).select(F.concat_ws(":", "item_id", "i").alias("read_id"), (F.col("i") / 6).cast("int").alias("n"), F.explode(F.array(F.col("g").substr(F.col("i") + 1, F.lit(60)))).alias("truth"))
    return cut.select("read_id", F.when(F.col("n") % 8 == 3, _changed(F.col("truth"), F.col("n") % 17 + 20)).otherwise(F.col("truth")).alias("seq"), "truth")


add("correct_reads", lambda s, d: am.correct_reads(planted_reads(s, d).select("read_id", "seq"), "read_id", 21), None)
add("assemble_contigs", lambda s, d: am.assemble(planted_reads(s, d).select("read_id", "seq"), "read_id", 21), None, "coverage")
add("gene_prediction", lambda s, d: gn.predict(_long(s, d), "doc_id"), None, "score", "coding")
add("gene_fragments", lambda s, d: gn.predict(_long(s, d), "doc_id", least=60, fragments=True).groupBy("doc_id", "strand").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.sum(F.col("end") - F.col("start") + 1).alias("bases")), None, "best")


def _pieces(spark, sf_dir):
    """Contigs of 90 bases at every 110th base of the passages, some reversed: contig, seq."""
    rows = _passages(spark, sf_dir).where(F.length("g") >= 90).select("item_id", "g", F.explode(F.sequence(F.lit(0), F.floor((F.length("g") - 90) / 110).cast("int"))).alias("k"))
    piece = F.col("g").substr(F.col("k") * 110 + 1, F.lit(90))
    return rows.select(F.concat_ws(":", "item_id", "k").alias("contig"), F.when((F.col("item_id") + 7 * F.col("k")) % 3 == 0, sq.reverse_complement(piece)).otherwise(piece).alias("seq")).withColumn("seq", F.explode(F.array("seq")))


def _long_reads(spark, sf_dir):
    """Reads of 250 bases at every 40th base of the passages."""
    rows = _passages(spark, sf_dir).where(F.length("g") >= 250).select("item_id", "g", F.explode(F.sequence(F.lit(0), F.floor((F.length("g") - 250) / 40).cast("int"))).alias("i"))
    return rows.select(F.concat_ws(":", "item_id", "i").alias("read_id"), F.col("g").substr(F.col("i") * 40 + 1, F.lit(250)).alias("seq")).withColumn("seq", F.explode(F.array("seq")))


_PASSAGES = "passages AS (SELECT item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS g FROM benchmark)"
_NEXT = """pieces AS (SELECT item_id, length(g) AS n, unnest(range(0, (length(g) - 90) // 110 + 1)) AS k FROM passages WHERE length(g) >= 90),
 starts AS (SELECT item_id, unnest(range(0, (length(g) - 250) // 40 + 1)) * 40 AS i FROM passages WHERE length(g) >= 250),
 pairs AS (SELECT x.item_id, x.k, (SELECT count(*) FROM starts AS s WHERE s.item_id = x.item_id AND i <= x.k * 110 + 60 AND i + 250 >= (x.k + 1) * 110 + 30) AS weight FROM pieces AS x JOIN pieces AS y ON x.item_id = y.item_id AND y.k = x.k + 1),
 named AS (SELECT item_id || ':' || k || '|' || CASE WHEN (item_id + 7 * k) % 3 = 0 THEN '5' ELSE '3' END AS x, item_id || ':' || (k + 1) || '|' || CASE WHEN (item_id + 7 * (k + 1)) % 3 = 0 THEN '3' ELSE '5' END AS y, weight FROM pairs WHERE weight >= 2)"""


def _links(spark, sf_dir):
    return ly.long_read_links(_long_reads(spark, sf_dir), _pieces(spark, sf_dir), anchor=30, most=0)


add("scaffold_joins", lambda s, d: ly.matched(_links(s, d)).select("a", "b", "weight", F.col("gap").cast("long").alias("gap")), query(_PASSAGES, _NEXT, sql="SELECT least(x, y) AS a, greatest(x, y) AS b, weight::DOUBLE AS weight, 20::BIGINT AS gap FROM named"))
add("scaffold_walks", lambda s, d: ly.scaffolds(_pieces(s, d), _links(s, d)), None)
add("overlap_contigs", lambda s, d: ly.overlap_consensus(ly.overlap_layout(planted_reads(s, d).select("read_id", F.col("truth").alias("seq")), 30), planted_reads(s, d).select("read_id", F.col("truth").alias("seq"))), None, "coverage")
add("chain_reads", lambda s, d: ch.best_chains(ch.chains(ch.anchors(_passages(s, d).select(F.col("item_id").alias("read_id"), F.col("g").alias("seq")), _contigs(s, d)))), None)


def _gapped(spark, sf_dir):
    """Passages of 260 bases or more as two parts with a gap of 100 bases before the second."""
    rows = _passages(spark, sf_dir).where(F.length("g") >= 260)
    part = F.struct(F.lit(0).alias("i"), F.substring("g", 1, 80).alias("seq"), F.lit(0).alias("gap")), F.struct(F.lit(1).alias("i"), F.substring("g", 181, 80).alias("seq"), F.lit(100).alias("gap"))
    return rows.select(F.col("item_id").alias("scaffold"), F.explode(F.array(*part)).alias("p")).select("scaffold", "p.i", "p.seq", F.lit("+").alias("orientation"), "p.gap")


add("fill_gaps_by_graph", lambda s, d: am.fill_gaps_by_graph(_gapped(s, d), planted_reads(s, d).select("read_id", "seq"), "read_id", 21), None, "coverage")
_COVERED = """p AS (SELECT item_id, g, (length(g) - 60) // 6 * 6 AS last FROM passages WHERE length(g) >= 60), r AS (SELECT item_id, last, unnest(range(0, last + 1, 6)) AS i FROM p WHERE last + 48 >= 200),
 d AS (SELECT item_id, pos, count(*) AS n FROM (SELECT item_id, unnest(range(i, i + 60)) AS pos FROM r) GROUP BY ALL HAVING count(*) >= 2), y AS (SELECT item_id, min(pos) AS a, max(pos) + 1 AS b, avg(n) AS coverage FROM d GROUP BY item_id)"""
add("guided_contigs", lambda s, d: mp.guided_contigs(planted_reads(s, d).select("read_id", "seq"), _passages(s, d).select(F.col("item_id").alias("contig"), F.col("g").alias("seq"))), query(_PASSAGES, _COVERED, sql=f"SELECT item_id AS contig, a AS start, b AS \"end\", {R('coverage')} AS coverage, substr(g, a::INT + 1, (b - a)::INT) AS seq FROM y JOIN passages USING (item_id)"), "coverage")
