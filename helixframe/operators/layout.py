"""Order and orientation: links between the ends of contigs or reads, matched heaviest first, and the walks that they make.

An end takes part in one join. In each round every free end points at its heaviest link, and links that both ends point at are taken; this is
the result of going through all links by falling weight, without going through them one by one. Walks are numbered by doubling steps back over
oriented contigs, so that a chromosome of n contigs takes log n joins; a ring is cut at its lightest link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators.graph import settled
from helixframe.operators.mapping import placements
from helixframe.operators.sequences import _walked, overlap_edges


def _end(contig: str, end: str) -> Column:
    """The name of an end; ends of one contig differ in the last sign."""
    return F.concat(F.col(contig).cast("string"), F.lit("|"), F.col(end))


def matched(links: DataFrame) -> DataFrame:
    """Of links (contig1, end1, contig2, end2, weight, gap) those that a run by falling weight takes, if an end is used once and no contig meets itself: (a, b, weight, gap), a < b the ends' names.

    Links given more than once, from either side, count as their heaviest; of equal weights the smaller names go first.
    """
    ends = links.where(F.col("contig1") != F.col("contig2")).select(_end("contig1", "end1").alias("x"), _end("contig2", "end2").alias("y"), F.col("weight").cast("double").alias("weight"), "gap")
    rest = settled(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight", "gap").groupBy("a", "b").agg(F.max("weight").alias("weight"), F.max_by("gap", "weight").alias("gap")))
    taken = None
    while rest.limit(1).count():
        both = rest.select(F.col("a").alias("end"), "a", "b", "weight").unionAll(rest.select("b", "a", "b", "weight"))
        choice = both.groupBy("end").agg(F.min(F.struct((-F.col("weight")).alias("w"), "a", "b")).alias("c")).select("c.a", "c.b")
        won = settled(choice.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").join(rest, ["a", "b"]).drop("n"))
        taken = won if taken is None else taken.unionAll(won)
        used = won.select(F.col("a").alias("u")).unionAll(won.select("b"))
        rest = settled(rest.join(used, F.col("a") == F.col("u"), "left_anti").join(used, F.col("b") == F.col("u"), "left_anti"))
    return rest if taken is None else settled(taken)


def _steps(contigs: DataFrame, joins: DataFrame) -> DataFrame:
    """(kmer, back, steps, low) of oriented contigs, named contig|+ and contig|-: one that is left by its end 3 (or 5 if reversed) leads to the contig at the other side of the join."""
    states = contigs.select(F.explode(F.array(F.concat(F.col("contig").cast("string"), F.lit("|+")), F.concat(F.col("contig").cast("string"), F.lit("|-")))).alias("kmer"))
    both = joins.select(F.col("a").alias("out"), F.col("b").alias("into")).unionAll(joins.select("b", "a"))
    name = lambda end, three, five: F.concat(F.expr(f"substring({end}, 1, length({end}) - 1)"), F.when(F.substring(end, -1, 1) == "3", three).otherwise(five))
    before = both.select(name("into", "-", "+").alias("kmer"), name("out", "+", "-").alias("back"))
    return settled(states.join(before, "kmer", "left").select("kmer", F.coalesce("back", "kmer").alias("back"), F.col("back").isNotNull().cast("long").alias("steps"), F.col("kmer").alias("low")))


def _flipped(state: str) -> Column:
    return F.concat(F.expr(f"substring({state}, 1, length({state}) - 1)"), F.when(F.substring(state, -1, 1) == "+", "-").otherwise("+"))


def walks(contigs: DataFrame, joins: DataFrame) -> DataFrame:
    """(scaffold, position, contig, strand, gap) of contigs (contig) and joins of `matched`: every contig once, in the order and orientation of its walk.

    gap is that of the join before it (null for the first). Of a walk's two directions the one that starts with the smaller name is taken; a
    contig without joins is a scaffold of its own, forward. A scaffold has the name of its first contig.
    """
    n = contigs.count()
    while True:
        links = _walked(_steps(contigs, joins), 2 * n)
        placed = settled(links.join(links.select(F.col("kmer").alias("back"), F.col("steps").alias("rest")), "back"))
        rings = placed.where("rest > 0").select(F.expr("substring(kmer, 1, length(kmer) - 1)").alias("c"), "low").groupBy("c").agg(F.min("low").alias("low"))
        if not rings.limit(1).count():
            break
        # both directions of a ring have the same contigs and so the same smallest name
        in_ring = joins.withColumn("c", F.expr("substring(a, 1, length(a) - 1)")).join(rings, "c")
        cut = in_ring.groupBy("low").agg(F.min(F.struct("weight", "a", "b")).alias("x")).select("x.a", "x.b")
        joins = settled(joins.join(cut, ["a", "b"], "left_anti"))
    walk = placed.groupBy("back").agg(F.max_by("kmer", "steps").alias("tail")).where(F.col("back") <= _flipped("tail")).select("back")
    gaps = joins.select(F.col("a").alias("end"), "gap").unionAll(joins.select("b", "gap"))
    contig = F.expr("substring(kmer, 1, length(kmer) - 2)")
    strand = F.substring("kmer", -1, 1)
    rows = placed.join(walk, "back").select(F.expr("substring(back, 1, length(back) - 2)").alias("scaffold"), F.col("steps").alias("position"), contig.alias("contig"), strand.alias("strand"), F.concat(contig, F.when(strand == "+", "|5").otherwise("|3")).alias("end"))
    return rows.join(gaps, "end", "left").select("scaffold", "position", "contig", "strand", F.when(F.col("position") > 0, F.col("gap")).alias("gap"))


def scaffolds(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """`walks` along the matched links of contigs (contig, seq)."""
    return walks(contigs.select("contig"), matched(links))


def scaffold_sequences(placed: DataFrame, contigs: DataFrame, least_gap: int = 1) -> DataFrame:
    """(scaffold, n, seq): the contigs of each scaffold in order, reversed ones as their reverse complement, with N for each base of a gap (`least_gap` at least)."""
    text = F.when(F.col("strand") == "+", F.upper("seq")).otherwise(sq.reverse_complement("seq"))
    filled = F.when(F.col("position") > 0, F.repeat(F.lit("N"), F.greatest(F.coalesce("gap", F.lit(0)), F.lit(least_gap)).cast("int"))).otherwise("")
    rows = placed.join(contigs.select(F.col("contig").cast("string").alias("contig"), "seq"), "contig").select("scaffold", F.struct("position", F.concat(filled, text).alias("text")).alias("x"))
    return rows.groupBy("scaffold").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "").alias("seq"))


# --- where links come from ----------------------------------------------------------------------------------------------


def long_read_links(reads: DataFrame, contigs: DataFrame, read: str = "read_id", anchor: int = 50, most: int = 2, support: int = 2) -> DataFrame:
    """(contig1, end1, contig2, end2, gap, weight) from contigs (contig, seq) of at least two anchors and long reads: ends that follow each other on `support` reads or more, with the median of the bases between.

    The anchors are the outer `anchor` bases of both ends, placed with at most `most` mismatches on either strand.
    """
    long = contigs.where(F.length("seq") >= 2 * anchor)
    ends = long.select(F.concat(F.col("contig").cast("string"), F.lit("|5")).alias("name"), F.substring("seq", 1, anchor).alias("seq")).unionAll(long.select(F.concat(F.col("contig").cast("string"), F.lit("|3")), F.substring("seq", -anchor, anchor)))
    found = placements(ends, reads, "name", read, most=most).withColumn("end", F.substring("name", -1, 1)).withColumn("contig", F.expr("substring(name, 1, length(name) - 2)"))
    leaves = (F.col("end") == "3") == (F.col("strand") == "+")  # the contig lies before its anchor
    order = Window.partitionBy(read).orderBy("start", "name", "strand")
    pairs = found.withColumn("leaves", leaves).withColumn("next", F.lead(F.struct("contig", "end", "start", "leaves")).over(order)).where(F.col("leaves") & ~F.col("next.leaves") & (F.col("contig") != F.col("next.contig")))
    one = pairs.select(F.col("contig").alias("c1"), F.col("end").alias("e1"), F.col("next.contig").alias("c2"), F.col("next.end").alias("e2"), (F.col("next.start") - F.col("start") - anchor).alias("gap"))
    return _summed(one, support)


def _summed(rows: DataFrame, support: int) -> DataFrame:
    """Links (c1, e1, c2, e2, gap) counted from either side alike."""
    first = F.struct(F.col("c1").cast("string").alias("c"), F.col("e1").alias("e"))
    second = F.struct(F.col("c2").cast("string").alias("c"), F.col("e2").alias("e"))
    ordered = rows.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y"), "gap")
    return ordered.groupBy("x", "y").agg(F.median("gap").cast("long").alias("gap"), F.count("*").alias("weight")).where(F.col("weight") >= support).select(F.col("x.c").alias("contig1"), F.col("x.e").alias("end1"), F.col("y.c").alias("contig2"), F.col("y.e").alias("end2"), "gap", "weight")


def contact_links(contacts: DataFrame, contigs: DataFrame, support: int = 2) -> DataFrame:
    """Links from proximity contacts (contig1, pos1, contig2, pos2) and contigs (contig, length): contacts between the nearer ends of two contigs (end 3 behind the middle) are counted, per 1000 possible pairs of bases of the halves."""
    half = lambda k: F.when(F.col(f"pos{k}") > F.col(f"length{k}") / 2, "3").otherwise("5")
    sized = contacts
    for k in (1, 2):
        sized = sized.join(contigs.select(F.col("contig").alias(f"contig{k}"), F.col("length").alias(f"length{k}")), f"contig{k}")
    rows = _summed(sized.where(F.col("contig1") != F.col("contig2")).select(F.col("contig1").alias("c1"), half(1).alias("e1"), F.col("contig2").alias("c2"), half(2).alias("e2"), F.lit(0).alias("gap")), support)
    for k in (1, 2):
        rows = rows.join(contigs.select(F.col("contig").cast("string").alias(f"contig{k}"), F.col("length").alias(f"length{k}")), f"contig{k}")
    return rows.select("contig1", "end1", "contig2", "end2", "gap", (F.col("weight") * 4000.0 / (F.col("length1") * F.col("length2"))).alias("weight"))


# --- overlap, layout, consensus -----------------------------------------------------------------------------------------


def without_contained(reads: DataFrame, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """Reads that lie in no longer read on either strand; of equal ones the smallest key stays."""
    rows = reads.select(F.col(read).alias("r"), F.upper(seq).alias("s")).where("length(s) > 0")
    one = rows.groupBy(F.least("s", sq.reverse_complement("s")).alias("s")).agg(F.min("r").alias("r"))
    longer = one.select(F.col("r").alias("contig"), F.col("s").alias("seq"))
    inside = placements(one.select("r", F.col("s").alias("seq")), longer, "r", "contig", most=0).where("r <> contig").select("r").distinct()
    return reads.join(one.join(inside, "r", "left_anti").select(F.col("r").alias(read)), read, "left_semi")


def overlap_layout(reads: DataFrame, least: int, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(scaffold, position, contig, strand, gap) of reads that are in no other, joined by their longest overlaps of `least` bases or more on either strand; gap is minus the overlap."""
    own = without_contained(reads, read, seq).select(F.col(read).cast("string").alias("contig"), F.upper(seq).alias("seq"))
    both = own.select(F.concat("contig", F.lit("|+")).alias("state"), "seq").unionAll(own.select(F.concat("contig", F.lit("|-")), sq.reverse_complement("seq")))
    met = overlap_edges(both, "state", least)
    name, sign = (lambda c: F.expr(f"substring({c}, 1, length({c}) - 2)")), (lambda c: F.substring(c, -1, 1))
    links = met.select(name("a").alias("contig1"), F.when(sign("a") == "+", "3").otherwise("5").alias("end1"), name("b").alias("contig2"), F.when(sign("b") == "+", "5").otherwise("3").alias("end2"), F.col("overlap").alias("weight"), (-F.col("overlap")).alias("gap"))
    return walks(own.select("contig"), matched(links))


def overlap_consensus(placed: DataFrame, reads: DataFrame, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(contig, n_reads, coverage, seq): of each layout of two reads or more the commonest base at each place (the smallest of equals), reads standing where their overlaps put them."""
    rows = placed.join(reads.select(F.col(read).cast("string").alias("contig"), F.upper(seq).alias("s")), "contig").withColumn("s", F.when(F.col("strand") == "+", F.col("s")).otherwise(sq.reverse_complement("s")))
    order = Window.partitionBy("scaffold").orderBy("position")
    step = F.coalesce(F.lag(F.length("s")).over(order) + F.col("gap"), F.lit(0))
    at = rows.withColumn("step", step).withColumn("offset", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bases = at.select("scaffold", "offset", F.posexplode(F.split("s", "")).alias("i", "base")).groupBy("scaffold", (F.col("offset") + F.col("i")).alias("pos"), "base").agg(F.count("*").alias("n"))
    won = bases.groupBy("scaffold", "pos").agg(F.sum("n").alias("depth"), F.min_by("base", F.struct(-F.col("n"), "base")).alias("base"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
    made = won.groupBy("scaffold").agg(F.avg("depth").alias("coverage"), text.alias("seq"))
    counted = placed.groupBy("scaffold").agg(F.count("*").alias("n_reads")).where("n_reads > 1")
    return made.join(counted, "scaffold").select(F.col("scaffold").alias("contig"), "n_reads", "coverage", "seq")
