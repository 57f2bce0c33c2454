"""Reads to contigs: correction by trusted k-mers, and de Bruijn graphs cleaned of tips and bubbles round by round.

Graphs are tables of edges; a pass that joins unbranched paths doubles its steps, so a path of n edges takes log n joins. Every decision
(what is a tip, which way through a bubble stays, which base is right) is an aggregation over its place in the graph or read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators.graph import settled
from helixframe.operators.sequences import _walked, kmers


def _canonical(seq: str) -> Column:
    return F.least(F.col(seq), sq.reverse_complement(seq))


def edges_of(reads: DataFrame, key: str, k: int, seq: str = "seq", least: int = 1) -> DataFrame:
    """The de Bruijn graph of both strands: (edge, src, dst, n_kmers, weight, seq), an edge a k-mer seen at least `least` times on either strand, its nodes the ends of k - 1 bases."""
    counts = kmers(reads, key, k, seq, canonical=True).groupBy("kmer").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    both = counts.select(F.explode(F.array_distinct(F.array("kmer", sq.reverse_complement("kmer")))).alias("kmer"), "weight")
    return both.select(F.col("kmer").alias("edge"), F.substring("kmer", 1, k - 1).alias("src"), F.substring("kmer", 2, k - 1).alias("dst"), F.lit(1).cast("long").alias("n_kmers"), "weight", F.col("kmer").alias("seq"))


def compressed(edges: DataFrame, k: int) -> DataFrame:
    """The graph with each unbranched path as one edge, named by its first; a ring without a branch starts at its smallest edge. Other nodes stay."""
    edges = settled(edges)
    into, out = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("edge").alias("before")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    inner = into.join(out, "node").where("i = 1 AND o = 1").select(F.col("node").alias("src"), "before")
    single = settled(edges.join(inner, "src", "left").select(F.col("edge").alias("kmer"), F.coalesce("before", "edge").alias("back"), F.col("before").isNotNull().cast("long").alias("steps"), F.col("edge").alias("low")))
    n = edges.count()
    links = _walked(single, n)
    placed = settled(links.join(links.select(F.col("kmer").alias("back"), F.col("steps").alias("rest")), "back"))
    paths, rings = placed.where("rest = 0").select("kmer", "back", "steps"), placed.where("rest > 0").select("kmer", "low")
    if rings.limit(1).count():
        cut = F.col("kmer") == F.col("low")
        again = single.drop("low").join(rings, "kmer").select("kmer", F.when(cut, F.col("kmer")).otherwise(F.col("back")).alias("back"), F.when(cut, 0).otherwise(1).cast("long").alias("steps"), "low")
        paths = paths.unionAll(_walked(settled(again), n).select("kmer", "back", "steps"))
    joined = paths.join(edges.select(F.col("edge").alias("kmer"), "src", "dst", "n_kmers", "weight", "seq"), "kmer")
    pieces = F.array_sort(F.collect_list(F.struct("steps", "seq")))
    text = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x["seq"]).otherwise(F.substring(x["seq"], k, 1 << 30))), "")
    made = joined.groupBy(F.col("back").alias("edge")).agg(F.min_by("src", "steps").alias("src"), F.max_by("dst", "steps").alias("dst"), F.sum("n_kmers").alias("n_kmers"), F.sum("weight").alias("weight"), text.alias("seq"))
    return settled(made)


def _ranked(edges: DataFrame) -> DataFrame:
    """With `strength`, which orders edges alike on both strands: coverage, then (for equal ones the smaller is stronger) the sequence that both strands share."""
    return edges.withColumn("strength", F.struct((F.col("weight") / F.col("n_kmers")).alias("coverage"), (-F.length("seq")).alias("size"))).withColumn("shared", _canonical("seq"))


def weak_tips(edges: DataFrame, most: int) -> DataFrame:
    """Edges (edge) of at most `most` k-mers that end in nothing at one side and at the other leave a node by which a stronger edge leaves too."""
    e = _ranked(edges)
    starts, ends = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
    found = None
    for side, other, reached in (("src", "dst", starts), ("dst", "src", ends)):
        rivals = e.groupBy(side).agg(F.max("strength").alias("best"), F.count("*").alias("n"))
        first = e.join(rivals, side).where(F.col("strength") == F.col("best")).groupBy(F.col(side).alias("s")).agg(F.min("shared").alias("winner"))
        dead = e.where(F.col("n_kmers") <= most).join(reached.withColumnRenamed("node", other), other, "left_anti")
        weak = dead.join(rivals, side).where("n > 1").join(first, F.col(side) == F.col("s")).where((F.col("strength") < F.col("best")) | (F.col("shared") != F.col("winner"))).select("edge")
        found = weak if found is None else found.unionAll(weak)
    return found.distinct()


def weak_bubbles(edges: DataFrame, most: int) -> DataFrame:
    """Edges (edge) of at most `most` k-mers between two nodes that a stronger edge joins as well."""
    e = _ranked(edges)
    best = e.groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("strength").alias("best")).where("n > 1")
    met = e.join(best, ["src", "dst"])
    winner = met.where(F.col("strength") == F.col("best")).groupBy("src", "dst").agg(F.min("shared").alias("winner"))
    return met.where(F.col("n_kmers") <= most).join(winner, ["src", "dst"]).where((F.col("strength") < F.col("best")) | (F.col("shared") != F.col("winner"))).select("edge")


def weak_detours(edges: DataFrame, most: int) -> DataFrame:
    """Edges (edge) of at most `most` k-mers whose nodes a walk along the strongest edges joins as well, in at most `most` k-mers and by stronger edges alone: bubbles that others interrupt."""
    e = edges.select("edge", "src", "dst", "n_kmers", (F.col("weight") / F.col("n_kmers")).alias("coverage"), _canonical("seq").alias("shared"))
    best = settled(e.groupBy("src").agg(F.max_by(F.struct("edge", "dst", "n_kmers", "coverage"), F.struct("coverage", F.struct(-F.length("shared"), -F.xxhash64("shared")))).alias("b"), F.count("*").alias("n")).select("src", "b.*", "n"))
    onward = best.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("n_kmers").alias("more"), F.col("coverage").alias("over"))
    walkers = e.where(F.col("n_kmers") <= most).join(best.where("n > 1").select("src", F.col("edge").alias("first")), "src").where("edge <> first").select("edge", F.col("dst").alias("target"), "coverage", F.col("src").alias("at"), F.lit(0).cast("long").alias("walked"))
    found = None
    while True:
        walkers = settled(walkers.join(onward, "at").where((F.col("over") > F.col("coverage")) & (F.col("walked") + F.col("more") <= most)).select("edge", "target", "coverage", F.col("to").alias("at"), (F.col("walked") + F.col("more")).alias("walked")))
        reached = walkers.where("at = target").select("edge")
        found = reached if found is None else found.unionAll(reached)
        if not walkers.where("at <> target").limit(1).count():
            return found
        walkers = walkers.where("at <> target")


def cleaned(edges: DataFrame, k: int, tip: int | None = None, bubble: int = 100) -> DataFrame:
    """The compressed graph without weak tips (of at most 2k k-mers) and bubbles, by rounds until none is left; both strands lose the same."""
    edges = compressed(edges, k)
    while True:
        named = edges.select("edge", _canonical("seq").alias("shared"))
        weak = weak_tips(edges, 2 * k if tip is None else tip).unionAll(weak_bubbles(edges, bubble)).unionAll(weak_detours(edges, bubble))
        weak = settled(named.join(named.join(weak, "edge", "left_semi").select("shared"), "shared", "left_semi").select("edge"))  # both strands
        if not weak.limit(1).count():
            return edges
        edges = compressed(edges.join(weak, "edge", "left_anti"), k)


def assemble(reads: DataFrame, key: str, k: int, seq: str = "seq", least: int = 1, tip: int | None = None, bubble: int = 100) -> DataFrame:
    """(contig, n_kmers, coverage, seq): contigs of the cleaned graph, each once for its two strands, as the smaller of them; a ring on the strand that has the smallest k-mer.

    Reads are of either strand; places with N and reads of fewer than k bases give nothing. A contig is named by its first k-mer.
    """
    found = cleaned(edges_of(reads, key, k, seq, least), k, tip, bubble).withColumn("other", sq.reverse_complement("seq"))
    words = sq.windows(F.col("seq"), k)
    smallest = F.array_min(F.transform(words, lambda w: F.least(w, sq.reverse_complement(w))))
    kept = F.when(F.col("src") == F.col("dst"), F.array_contains(words, smallest)).otherwise(F.col("seq") <= F.col("other"))
    return found.where(kept).select(F.substring("seq", 1, k).alias("contig"), "n_kmers", (F.col("weight") / F.col("n_kmers")).alias("coverage"), "seq")


def valley(counts: DataFrame, most: int = 1000) -> int:
    """The least count of a trusted k-mer: the first count from which the number of k-mers stops falling, 2 at least. Counts above `most` are one."""
    rows = {r.n: r.kmers for r in counts.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("kmers")).collect()}  # a row a count
    n = 1
    while n < most and rows.get(n + 1, 0) < rows.get(n, 0):
        n += 1
    return max(2, n)


def correct_reads(reads: DataFrame, key: str, k: int, seq: str = "seq", least: int | None = None) -> DataFrame:
    """(key, seq, changes): reads with single wrong bases put right by the k-mers of all reads (either strand).

    K-mers of at least `least` occurrences (the valley of their counts) are trusted. A stretch of weak places names its wrong base: the last base of
    its first k-mer, or the first one of its last if it begins the read. The base becomes the one with which most k-mers over it are trusted, among them
    the k-mer at the edge of the stretch, if that is a single base; else it stays. Rounds go on while reads change, each with fewer weak
    places. Reads without a trusted k-mer, short, null and empty ones stay as they are, in upper case. Keys must be unique.
    """
    rows = reads.select(F.col(key).alias("read"), F.upper(seq).alias("seq"))
    counts = settled(kmers(rows, "read", k, "seq", canonical=True).groupBy("kmer").agg(F.count("*").alias("n")))
    trusted = counts.where(F.col("n") >= (valley(counts) if least is None else least)).select("kmer", F.lit(True).alias("ok"))
    open_, done = settled(rows.withColumn("changes", F.lit(0))), None
    while True:
        places = open_.select("read", (F.length("seq") - k + 1).alias("n"), F.posexplode(sq.windows(F.col("seq"), k)).alias("pos", "kmer")).withColumn("kmer", _canonical("kmer"))
        weak = places.join(trusted, "kmer", "left").where("ok IS NULL")
        stretch = weak.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("read").orderBy("pos"))).groupBy("read", "island", "n").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
        edge = F.when(F.col("a") > 0, F.col("a")).when(F.col("b") < F.col("n") - 1, F.col("b"))
        wrong = stretch.select("read", "a", "b", edge.alias("edge"), F.when(F.col("a") > 0, F.col("a") + k - 1).otherwise(F.col("b")).alias("at")).where("edge IS NOT NULL").join(open_.select("read", "seq"), "read")
        tried = wrong.withColumn("base", F.explode(F.array(*map(F.lit, "ACGT")))).where(F.col("base") != F.col("seq").substr(F.col("at") + 1, F.lit(1))).withColumn("seq", F.overlay("seq", "base", F.col("at") + 1, F.lit(1)))
        over = F.sequence(F.greatest("a", F.col("at") - k + 1), F.least("b", "at"))
        words = tried.select("read", "at", "base", "edge", "seq", F.explode(over).alias("pos")).select("read", "at", "base", (F.col("pos") == F.col("edge")).alias("first"), F.col("seq").substr(F.col("pos") + 1, F.lit(k)).alias("kmer"))
        scored = words.withColumn("kmer", _canonical("kmer")).join(trusted, "kmer").groupBy("read", "at", "base").agg(F.count("*").alias("hits"), F.max("first").alias("first")).where("first")
        chosen = scored.groupBy("read", "at", "hits").agg(F.count("*").alias("n"), F.min("base").alias("base")).groupBy("read", "at").agg(F.max(F.struct("hits", "n", "base")).alias("b")).where("b.n = 1").select("read", F.struct("at", "b.base").alias("fix"))
        fixes = chosen.groupBy("read").agg(F.collect_list("fix").alias("fixes"))
        mended = settled(open_.join(fixes, "read", "left").select("read", F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<at:int,base:string>>")), F.col("seq"), lambda s, f: F.overlay(s, f["base"], f["at"] + 1, F.lit(1))).alias("seq"), (F.col("changes") + F.coalesce(F.size("fixes"), F.lit(0))).alias("changes"), F.col("fixes").isNotNull().alias("moved")))
        still = mended.where("NOT moved").drop("moved")
        done, open_ = still if done is None else done.unionAll(still), mended.where("moved").drop("moved")
        if not open_.limit(1).count():
            return done.select(F.col("read").alias(key), "seq", F.col("changes").cast("long").alias("changes"))


def fill_gaps_by_graph(parts: DataFrame, reads: DataFrame, key: str, k: int = 31, least: int = 2, over: int = 50, steps: int = 8, seq: str = "seq") -> DataFrame:
    """(scaffold, i, fill, edges, coverage): gaps of more than `over` bases of scaffold parts (scaffold, i, seq, orientation, gap: the length before the part) filled from the cleaned graph of all reads, which may be shorter than the gaps.

    A walk leaves the edge that holds the last k-mer before the gap and goes along edges to the one with the first k-mer behind it. It takes at most `steps`
    edges and must differ from the gap's length by less than half of it; of several the one closest to the length wins, then the better covered, then the smaller
    text. A k-mer is on one edge alone, so common ones do not multiply. Parts shorter than k take no part; a gap without a walk has no row.
    """
    strand = F.when(F.col("orientation") == "-", sq.reverse_complement(seq)).otherwise(F.upper(seq))
    before = F.lag("_s").over(Window.partitionBy("scaffold").orderBy("i"))
    flanks = parts.select("scaffold", "i", "gap", strand.alias("_s")).withColumn("_b", before).where((F.col("gap") > over) & (F.length("_b") >= k) & (F.length("_s") >= k))
    gaps = settled(flanks.select("scaffold", "i", "gap", F.right("_b", F.lit(k)).alias("left"), F.substring("_s", 1, k).alias("right")))
    edges = cleaned(edges_of(reads, key, k, seq, least), k).select("edge", "src", "dst", "seq", (F.col("weight") / F.col("n_kmers")).alias("coverage"))
    words = edges.select("edge", "dst", F.col("seq").alias("text"), "coverage", F.posexplode(sq.windows(F.col("seq"), k)).alias("at", "kmer"))
    asked = gaps.select(F.explode(F.array("left", "right")).alias("kmer")).distinct()
    held = settled(words.join(asked, "kmer", "left_semi"))
    goal = gaps.join(held.select(F.col("kmer").alias("right"), F.col("edge").alias("goal"), F.col("at").alias("goal_at")), "right")
    # text: what follows the last k-mer before the gap, to the end of the edges walked so far
    walk = settled(goal.join(held.select(F.col("kmer").alias("left"), "edge", "dst", "at", F.col("text").alias("whole"), "coverage"), "left").select(
        "scaffold", "i", "gap", "goal", "goal_at", "edge", "dst", F.lit(1).alias("edges"), "coverage", F.col("whole").substr(F.col("at") + k + 1, F.length("whole")).alias("text"), (F.length("whole") - k - F.col("at")).alias("reach"), (F.length("whole") - k).alias("last"), F.col("at").alias("first")))
    found = None
    for step in range(steps):
        # the goal lies `last - goal_at` places before the end of the text, and its k-mer ends the walk
        size = F.col("reach") - (F.col("last") - F.col("goal_at")) - k
        here = walk.where((F.col("edge") == F.col("goal")) & ((F.col("edges") > 1) | (F.col("goal_at") > F.col("first")))).withColumn("size", F.greatest(size, F.lit(0)))
        hits = here.where((size > -k) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap") * 0.5)).select("scaffold", "i", "gap", F.expr("substring(text, 1, size)").alias("fill"), "edges", "coverage")
        found = hits if found is None else found.unionAll(hits)
        if step + 1 == steps:
            break
        onward = edges.select(F.col("edge").alias("next"), F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("seq").alias("more"), F.col("coverage").alias("over"))
        walk = settled(walk.join(onward, "dst").where(F.col("reach") <= F.col("gap") * 1.5 + k).select(
            "scaffold", "i", "gap", "goal", "goal_at", F.col("next").alias("edge"), F.col("to").alias("dst"), (F.col("edges") + 1).alias("edges"), F.least("coverage", "over").alias("coverage"),
            F.concat("text", F.substring("more", k, 1 << 30)).alias("text"), (F.col("reach") + F.length("more") - k + 1).alias("reach"), (F.length("more") - k).alias("last"), F.lit(-1).alias("first")))
        if not walk.limit(1).count():
            break
    best = F.min(F.struct(F.abs(F.length("fill") - F.col("gap")).alias("off"), (-F.col("coverage")).alias("c"), "fill", "edges"))
    return settled(found.groupBy("scaffold", "i").agg(best.alias("b")).select("scaffold", "i", "b.fill", "b.edges", (-F.col("b.c")).alias("coverage")))
