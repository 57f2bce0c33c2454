"""Assembly graphs and what joins and mends contigs: tips, bubbles, links of read pairs, consensus of mapped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import graph, sequences


def tips(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """Nodes (node, length) of at most `most` bases with one edge in all: (1 in, 0 out) or (0 in, 1 out)."""
    ends = graph.degrees(edges).where("in_degree + out_degree = 1").select("node")
    return nodes.where(F.col("length") <= most).join(ends, "node", "left_semi")


def bubbles(edges: DataFrame, most: int = 10) -> DataFrame:
    """(source, sink, path1, path2): nodes with two successors from which the only ways on, of two to `most` nodes, end in one node.

    The first path is that of the smaller successor.
    """
    distinct = edges.select("src", "dst").distinct()
    out = distinct.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    only = out.where("n = 1").select(F.col("src").alias("at"), F.col("a").alias("_next"))
    start = out.where("n = 2").select(F.col("src").alias("source"), F.explode(F.array("a", "b")).alias("head"))
    walk = start.select("source", "head", F.col("head").alias("at"), F.array("head").alias("path"))
    for _ in range(most - 1):  # walks that have ended get a null place and meet nothing more
        walk = walk.join(only, "at", "left").select("source", "head", F.col("_next").alias("at"), F.when(F.col("_next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_next"))).alias("path"))
    paths = walk.where(F.size("path") > 1).groupBy("source").agg(F.count("*").alias("n"), F.min_by("path", "head").alias("path1"), F.max_by("path", "head").alias("path2"))
    sink = F.element_at("path1", -1)
    return paths.where((F.col("n") == 2) & (sink == F.element_at("path2", -1))).select("source", sink.alias("sink"), "path1", "path2")


def pair_links(mates: DataFrame, contigs: DataFrame, insert: int = 500, support: int = 2) -> DataFrame:
    """(contig1, end1, contig2, end2, gap, support) from mapped mates (pair, mate, contig, pos) and contigs (contig, length).

    Counted are pairs with two placed mates on different contigs. An end is 3 behind the middle of the contig, else 5; the gap is the whole part of
    the median of the insert length less both distances to the ends.
    """
    x = mates.join(contigs, "contig").withColumn("end", F.when(F.col("pos") > F.col("length") / 2, "3").otherwise("5"))
    x = x.withColumn("rest", F.when(F.col("end") == "3", F.col("length") - F.col("pos")).otherwise(F.col("pos")))
    place = F.struct("contig", "end", "rest")
    pairs = x.groupBy("pair").agg(F.count("*").alias("n"), F.min_by(place, "mate").alias("x"), F.max_by(place, "mate").alias("y")).where("n = 2 AND x.contig <> y.contig")
    gaps = pairs.select(F.col("x.contig").alias("contig1"), F.col("x.end").alias("end1"), F.col("y.contig").alias("contig2"), F.col("y.end").alias("end2"), (F.lit(insert) - F.col("x.rest") - F.col("y.rest")).alias("gap"))
    links = gaps.groupBy("contig1", "end1", "contig2", "end2").agg(F.median("gap").cast("long").alias("gap"), F.count("*").alias("support"))
    return links.where(F.col("support") >= support)


def placed_reads(drafts: DataFrame, reads: DataFrame, key: str, read: str, k: int = 15, seq: str = "seq") -> DataFrame:
    """(read, key, start, n): the place of each read on each draft with the most shared k-mers, the leftmost of equal ones; only places inside the draft."""
    def words(df: DataFrame, name: str) -> DataFrame:
        at = F.posexplode(sq.windows(F.upper(seq), k)).alias("i", "kmer")
        return df.select(name, F.length(seq).alias("_size"), at).where(~F.col("kmer").contains("N"))

    d = words(drafts, key).select(key, F.col("_size").alias("_draft"), F.col("i").alias("at"), "kmer")
    hits = d.join(words(reads, read), "kmer").withColumn("start", F.col("at") - F.col("i"))
    hits = hits.where((F.col("start") >= 0) & (F.col("start") <= F.col("_draft") - F.col("_size"))).groupBy(read, key, "start").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("start", "n"), F.struct("n", -F.col("start")))
    return hits.groupBy(read, key).agg(best.alias("b")).select(read, key, "b.start", "b.n")


def corrections(drafts: DataFrame, reads: DataFrame, key: str, read: str, k: int = 15, least: int = 3, share: float = 0.6, seq: str = "seq") -> DataFrame:
    """(key, pos, old, new, weight): places, from 0, where the reads on a draft agree on another base.

    A read counts 10 at each base. A base wins with a weight of at least `least` in all and `share` of it for itself; of equal ones the smaller wins.
    """
    bases = placed_reads(drafts, reads, key, read, k, seq).join(reads.select(read, F.upper(seq).alias("_r")), read)
    bases = bases.select(key, "start", F.posexplode(F.split("_r", "")).alias("i", "base")).groupBy(key, (F.col("start") + F.col("i")).alias("pos"), "base").agg((F.count("*") * 10).alias("w"))
    won = bases.groupBy(key, "pos").agg(F.sum("w").alias("weight"), F.min_by(F.struct("base", "w"), F.struct(-F.col("w"), "base")).alias("b")).where((F.col("weight") >= least) & (F.col("b.w") >= F.col("weight") * share))
    old = drafts.select(key, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "old"))
    return won.join(old, [key, "pos"]).where("old <> b.base").select(key, F.col("pos").cast("long").alias("pos"), "old", F.col("b.base").alias("new"), "weight")


def polished(drafts: DataFrame, reads: DataFrame, key: str, read: str, k: int = 15, least: int = 3, share: float = 0.6, seq: str = "seq") -> DataFrame:
    """(key, seq, n_corrections): the drafts, in capitals, with the corrections put in; a draft without any stays as it is."""
    changes = corrections(drafts, reads, key, read, k, least, share, seq).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("_m"))
    bases = F.transform(F.split(F.upper(seq), ""), lambda b, i: F.coalesce(F.try_element_at(F.col("_m"), i.cast("long")), b))
    return drafts.select(key, seq).join(changes, key, "left").select(key, F.when(F.col("_m").isNull(), F.upper(seq)).otherwise(F.array_join(bases, "")).alias(seq), F.coalesce(F.size("_m"), F.lit(0)).cast("long").alias("n_corrections"))


def rank_assemblies(contigs: DataFrame, group: str, seq: str = "seq", n50: float = 0.3, total: float = 0.2, number: float = -0.1, unknown: float = -0.1) -> DataFrame:
    """(group, n50, total, n, n_percent, score), the score weighing N50 in millions, length in billions, contigs in thousands and the percentage of N.

    Contigs of null sequences do not count. Sort by falling score for the ranking.
    """
    sized = contigs.where(F.col(seq).isNotNull()).withColumn("length", F.length(seq).cast("long"))
    gaps = sized.groupBy(group).agg((F.sum(sq.count_of(F.upper(seq), "N")) * 100 / F.sum("length")).alias("_p"))
    x = sequences.nx(sized, [group], "length", (50,)).select(group, "n50", "total", "n").join(gaps, group).withColumn("n_percent", F.coalesce("_p", F.lit(0.0)))
    score = F.col("n50") * n50 / 1e6 + F.col("total") * total / 1e9 + F.col("n") * number / 1e3 + F.col("n_percent") * unknown
    return x.select(group, "n50", "total", "n", "n_percent", score.alias("score"))


def fill_gaps(parts: DataFrame, reads: DataFrame, read: str, overlap: int = 20, seq: str = "seq") -> DataFrame:
    """(scaffold, i, read, fill) of gaps that a read spans, from scaffold parts (scaffold, i, seq, orientation, gap: the length before the part).

    A read spans a gap if the last `overlap` bases before it have a place left of one of the first ones behind it, and the bases between differ from the
    gap's length by less than half of it. Of a read's several places those nearest to the gap's length win, then the leftmost; of several reads the smallest.
    Parts shorter than `overlap` take no part; a gap that no read spans has no row.
    """
    strand = F.when(F.col("orientation") == "-", sq.reverse_complement(seq)).otherwise(F.upper(seq))
    before = F.lag("_s").over(Window.partitionBy("scaffold").orderBy("i"))
    flanks = parts.select("scaffold", "i", "gap", strand.alias("_s")).withColumn("_b", before).where((F.col("gap") > 0) & (F.length("_b") >= overlap) & (F.length("_s") >= overlap))
    sides = F.array(F.struct(F.lit("left").alias("side"), F.right("_b", F.lit(overlap)).alias("kmer")), F.struct(F.lit("right").alias("side"), F.left("_s", F.lit(overlap)).alias("kmer")))
    words = reads.select(read, F.posexplode(sq.windows(F.upper(seq), overlap)).alias("at", "kmer"))
    hits = words.join(flanks.select("scaffold", "i", "gap", F.inline(sides)), "kmer")
    # a place before the gap stands where the one behind it is expected: the nearest are next to it
    spots = hits.withColumn("spot", F.when(F.col("side") == "left", F.col("at") + overlap + F.col("gap")).otherwise(F.col("at")))
    behind, line = F.when(F.col("side") == "right", F.col("at")), Window.partitionBy("scaffold", "i", "gap", read).orderBy("spot")
    near = F.array(F.last(behind, True).over(line.rangeBetween(Window.unboundedPreceding, 0)), F.first(behind, True).over(line.rangeBetween(0, Window.unboundedFollowing)))
    pairs = spots.withColumn("_near", near).where("side = 'left'").select("scaffold", "i", "gap", read, "at", F.explode("_near").alias("right"))
    size = F.col("right") - F.col("at") - overlap
    off = F.abs(size - F.col("gap"))
    spans = pairs.where(off < F.col("gap") * 0.5).groupBy("scaffold", "i").agg(F.min(F.struct(F.col(read), off.alias("off"), (F.col("at") + overlap + 1).alias("start"), size.alias("size"))).alias("_x"))
    chosen = spans.select("scaffold", "i", F.col(f"_x.{read}").alias(read), "_x.start", "_x.size")
    return chosen.join(reads.select(read, F.upper(seq).alias("_r")), read).select("scaffold", "i", read, F.substring(F.col("_r"), F.col("start"), F.col("size")).alias("fill"))
