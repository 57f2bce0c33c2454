"""Half-open intervals from 0 on named sequences: merging, overlaps, coverage, gaps, and alignments as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import flag
from helixframe.operators.graph import settled

#: Places of a stretch. What runs along a sequence is computed stretch by stretch, and what one hands on to the next comes from a row a stretch.
SPAN = 65_536


def _runs(df: DataFrame, keys: list[str], new, span: int | None = None) -> DataFrame:
    """Adds `__bin`, the stretch of `span` (SPAN) places of `start`, and `__run`: how many intervals of the stretch up to this one begin a run, so that 0 is the run open from before.

    `new` tells of the largest end of all earlier intervals of the key (by start and end; null at the first) whether a run begins.
    """
    rows = df.withColumn("__bin", F.floor(F.col("start") / (span or SPAN)))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "__bin").agg(F.max("end").alias("end")).withColumn("end", F.max("end").over(before)).withColumn("__own", F.lit(0))
    order = Window.partitionBy(*keys, "__bin").orderBy("__own", "start", "end")
    both = rows.withColumn("__own", F.lit(1)).unionByName(carried, allowMissingColumns=True).withColumn("__reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when((F.col("__own") == 0) | ~F.coalesce(new(F.col("__reach")), F.lit(True)), 0).otherwise(1)
    return both.withColumn("__new", begins).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__own = 1").drop("__own", "__reach", "__new")


def merged(df: DataFrame, *keys: str, gap: int = 0) -> DataFrame:
    """(keys, start, end, n): overlapping or touching intervals of a key joined, those within `gap` too."""
    runs = _runs(df.select(*keys, "start", "end"), list(keys), lambda reach: F.col("start") > reach + gap)
    parts = runs.groupBy(*keys, "__bin", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    parts = settled(parts.withColumn("__last", F.max("__run").over(Window.partitionBy(*keys, "__bin"))))
    inner = "__run > 0 AND __run < __last"
    edges = parts.where(f"NOT ({inner})")  # two a stretch at most
    number = F.sum((F.col("__run") > 0).cast("int")).over(Window.partitionBy(*keys).orderBy("__bin", "__run").rowsBetween(Window.unboundedPreceding, 0))
    joined = edges.withColumn("__id", number).groupBy(*keys, "__id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return parts.where(inner).select(*keys, "start", "end", "n").unionAll(joined.drop("__id"))


def overlaps(a: DataFrame, b: DataFrame, key: str, bin_size: int = 10_000) -> DataFrame:
    """(a_id, b_id, overlap) of overlapping intervals with the same key; both tables have id, start, end.

    Intervals are listed in every bin they touch and joined by bin; a pair counts in the bin where its overlap begins.
    """

    def binned(df: DataFrame, p: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / bin_size))
        return df.select(F.col(key), F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(bins).alias("bin"))

    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    met = binned(a, "a").join(binned(b, "b"), [key, "bin"]).where((start < end) & (F.col("bin") == F.floor(start / bin_size)))
    return met.select("a_id", "b_id", (end - start).alias("overlap"))


def depth_steps(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end, depth): stretches of equal depth, by +1 and -1 events; no position is expanded."""
    single = df.select(*keys, F.col("start").alias("at"), F.lit(1).alias("d")).unionAll(df.select(*keys, F.col("end").alias("at"), F.lit(-1).alias("d"))).withColumn("__bin", F.floor(F.col("at") / SPAN))
    along = Window.partitionBy(*keys).orderBy("__bin")
    bins = single.groupBy(*keys, "__bin").agg(F.sum("d").alias("d"), F.min("at").alias("at"))
    before = bins.select(*keys, "__bin", F.lit(None).cast(bins.schema["at"].dataType).alias("at"), F.coalesce(F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("d"), F.lit(0).alias("__own"))
    behind = bins.select(*keys, "__bin", F.lead("at").over(along).alias("at"), F.lit(0).cast("long").alias("d"), F.lit(2).alias("__own"))
    events = single.groupBy(*keys, "__bin", "at").agg(F.sum("d").alias("d")).withColumn("__own", F.lit(1))
    order = Window.partitionBy(*keys, "__bin").orderBy("__own", "at")
    steps = events.unionByName(before).unionByName(behind).withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("at").over(order))
    return steps.where("__own = 1 AND end IS NOT NULL").select(*keys, F.col("at").alias("start"), "end", "depth")


def coverage_summary(steps: DataFrame, *keys: str, levels: tuple[int, ...] = (1, 10, 30, 100)) -> DataFrame:
    """Span, breadth, mean depth and the share of the span with at least each level, from `depth_steps`."""
    n = F.col("end") - F.col("start")
    total = F.sum(n)
    return steps.groupBy(*keys).agg(total.alias("span"), (F.sum(F.when(F.col("depth") > 0, n).otherwise(0)) / total).alias("breadth"), (F.sum(n * F.col("depth")) / total).alias("mean_depth"), F.max("depth").alias("max_depth"), *((F.sum(F.when(F.col("depth") >= x, n).otherwise(0)) / total).alias(f"at_least_{x}") for x in levels))


def low_regions(steps: DataFrame, *keys: str, threshold: int = 10, least: int = 100) -> DataFrame:
    """(keys, start, end): stretches of at least `least` whose depth stays below the threshold."""
    return merged(steps.where(F.col("depth") < threshold), *keys).where(F.col("end") - F.col("start") >= least).drop("n")


def pileup(reads: DataFrame, seq: str = "seq", *keys: str) -> DataFrame:
    """(keys, pos, base, n): bases of ungapped reads over every position."""
    return reads.select(*keys, F.col("start"), F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("i", "base")).where("base <> ''").groupBy(*keys, (F.col("start") + F.col("i")).alias("pos"), "base").agg(F.count("*").alias("n"))


def pileup_consensus(counts: DataFrame, *keys: str, least: float = 0.5) -> DataFrame:
    """(keys, pos, depth, base, share): the commonest base (ties: the smaller), N if its share is below `least`."""
    best = counts.groupBy(*keys, "pos").agg(F.sum("n").alias("depth"), F.min(F.struct((-F.col("n")).alias("m"), "base")).alias("b"))
    share = -F.col("b.m") / F.col("depth")
    return best.select(*keys, "pos", "depth", F.when(share >= least, F.col("b.base")).otherwise("N").alias("base"), share.alias("share"))


def allele_fraction(counts: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, vaf): share of bases that differ from the reference (keys, pos, ref)."""
    joined = counts.join(reference, [*keys, "pos"])
    return joined.groupBy(*keys, "pos").agg((F.sum(F.when(F.col("base") != F.col("ref"), F.col("n")).otherwise(0)) / F.sum("n")).alias("vaf"))


# --- alignment records (ref, start, end, strand, mapq, flag, name) -------------------------------------------------------


def filter_alignments(df: DataFrame, min_mapq: int = 20, secondary: bool = False) -> DataFrame:
    """Mapped records of enough quality, without secondary and supplementary ones unless asked for."""
    kept = df.where(~flag("flag", "unmapped") & (F.col("mapq") >= min_mapq))
    return kept if secondary else kept.where(~flag("flag", "secondary") & ~flag("flag", "supplementary"))


def with_duplicates(df: DataFrame, order: str = "name") -> DataFrame:
    """Adds `duplicate`: not the best of its (ref, 5' end, strand) by mapping quality, then name."""
    five = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    rank = F.row_number().over(Window.partitionBy("ref", five, "strand").orderBy(F.desc("mapq"), order))
    return df.withColumn("duplicate", rank > 1)


def without_duplicates(df: DataFrame, order: str = "name") -> DataFrame:
    """The best record of each (ref, 5' end, strand) by mapping quality, then name; only each task's best ones are shuffled."""
    five = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")).alias("__five")
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy("ref", five, "strand").agg(F.min_by(whole, F.struct((-F.col("mapq")).alias("m"), F.col(order).alias("o"))).alias("best")).select("best.*")


def alignment_statistics(df: DataFrame) -> DataFrame:
    """One row of counts by flag, means of mapped records."""
    mapped = ~flag("flag", "unmapped")
    return df.agg(F.count("*").alias("n"), F.count_if(mapped).alias("mapped"), F.count_if(flag("flag", "proper_pair")).alias("proper_pairs"), F.count_if(flag("flag", "secondary")).alias("secondary"), F.count_if(flag("flag", "supplementary")).alias("supplementary"), F.count_if(flag("flag", "duplicate")).alias("duplicates"), F.count_if(flag("flag", "reverse")).alias("reverse"), F.avg(F.when(mapped, F.col("mapq"))).alias("mean_mapq"), F.avg(F.when(mapped, F.col("end") - F.col("start"))).alias("mean_length"))


def insert_sizes(df: DataFrame, size: str = "insert_size", *keys: str) -> DataFrame:
    """Quartiles, and mean, deviation, number within the 1.5 fences, and the commonest size (the smallest of equals)."""
    s = F.abs(F.col(size))
    some = df.where(F.col(size) != 0)
    q = some.groupBy(*keys).agg(F.percentile(s, F.lit(0.25)).alias("q1"), F.percentile(s, F.lit(0.5)).alias("median"), F.percentile(s, F.lit(0.75)).alias("q3"), F.mode(s, True).alias("mode"))
    joined = some.join(q, list(keys)) if keys else some.crossJoin(F.broadcast(q))
    inside = s.between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return joined.where(inside).groupBy(*keys, "q1", "median", "q3", "mode").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"))


def recalibration(pairs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(quality, n, errors, empirical): observed base quality -10 log10 of the error rate, at most 40, of (keys, base, ref, quality) outside known sites."""
    rows = pairs.join(known, keys, "left_anti").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("base") != F.col("ref")).alias("errors"))
    return rows.withColumn("empirical", F.when(F.col("errors") == 0, F.lit(40.0)).otherwise(F.least(F.lit(40.0), -10 * F.log10(F.col("errors") / F.col("n")))))


# --- order along a sequence ------------------------------------------------------------------------------------------


def clusters(df: DataFrame, key: str, max_gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Adds `cluster`: neighbours on the key no further apart than `max_gap`. Equal intervals are in one cluster."""
    order = Window.partitionBy(key).orderBy(start, end)
    broken = F.when(F.col(start) - F.lag(end).over(order) > max_gap, 1).otherwise(0)
    return df.withColumn("__b", broken).withColumn("cluster", F.sum("__b").over(order).cast("long")).drop("__b")


def misassemblies(df: DataFrame, limit: int = 1000) -> DataFrame:
    """(contig, start, gap) of consecutive alignments of a contig whose distance exceeds the limit either way."""
    gap = F.col("start") - F.lag("end").over(Window.partitionBy("contig").orderBy("start", "end"))
    return df.withColumn("gap", gap).where(F.abs("gap") > limit).select("contig", "start", "gap")


def synteny_blocks(df: DataFrame, max_gap: int = 100_000, least: int = 3) -> DataFrame:
    """(chrom1, chrom2, block, n, start1, end1, start2, end2, same_direction) of ortholog positions (chrom1, pos1, chrom2, pos2).

    Ordered by pos1, a block ends where the direction of pos2 turns or either gap exceeds `max_gap`.
    """
    keys = ["chrom1", "chrom2"]
    rows = df.select(*keys, "pos1", "pos2").withColumn("__bin", F.floor(F.col("pos1") / SPAN))
    last = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(F.desc("pos1"), F.desc("pos2")))
    along = Window.partitionBy(*keys).orderBy("__bin", "pos1", "pos2")
    place = F.struct("pos1", "pos2")
    tails = rows.withColumn("__r", last).where("__r <= 2").withColumn("__b", F.array(F.lag(place, 2).over(along), F.lag(place, 1).over(along)))
    heads = tails.withColumn("__h", F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy("pos1", "pos2"))).where("__h = 1").select(*keys, "__bin", F.explode("__b").alias("x")).where("x IS NOT NULL")
    heads = heads.select(*keys, "x.pos1", "x.pos2", "__bin", F.lit(0).alias("__own"))  # the two places before each stretch
    order = Window.partitionBy(*keys, "__bin").orderBy("__own", "pos1", "pos2")
    both = rows.withColumn("__own", F.lit(1)).unionByName(heads).withColumn("__d", F.signum(F.col("pos2") - F.lag("pos2").over(order))).withColumn("__p", F.lag("__d").over(order))
    far = (F.col("pos1") - F.lag("pos1").over(order) > max_gap) | (F.abs(F.col("pos2") - F.lag("pos2").over(order)) > max_gap)
    ends = both.withColumn("__b", F.when((F.col("__own") == 1) & (far | (F.col("__d") != F.col("__p"))), 1).otherwise(0)).withColumn("__part", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = settled(ends.where("__own = 1").groupBy(*keys, "__bin", "__part").agg(F.count("*").alias("n"), F.min("pos1").alias("start1"), F.max("pos1").alias("end1"), F.min("pos2").alias("start2"), F.max("pos2").alias("end2"), F.min(place).alias("first"), F.max(place).alias("last")))
    earlier = F.coalesce(F.sum("k").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = parts.groupBy(F.col("chrom1").alias("c1"), F.col("chrom2").alias("c2"), F.col("__bin").alias("b")).agg(F.max("__part").alias("k")).withColumnsRenamed({"c1": "chrom1", "c2": "chrom2"}).withColumn("earlier", earlier).withColumnsRenamed({"chrom1": "c1", "chrom2": "c2"}).drop("k")
    known = parts.join(begun, parts["chrom1"].eqNullSafe(begun["c1"]) & parts["chrom2"].eqNullSafe(begun["c2"]) & parts["__bin"].eqNullSafe(begun["b"])).withColumn("block", (F.col("earlier") + F.col("__part")).cast("long"))
    whole = known.groupBy(*keys, "block").agg(F.sum("n").alias("n"), F.min("start1").alias("start1"), F.max("end1").alias("end1"), F.min("start2").alias("start2"), F.max("end2").alias("end2"), (F.max("last")["pos2"] >= F.min("first")["pos2"]).alias("same_direction"))
    return whole.where(F.col("n") >= least)


def best_non_overlapping(df: DataFrame, key: str, max_overlap: int = 60, together: int | None = None) -> DataFrame:
    """Sweeps a key's intervals by start, end and score; of two that overlap by more than `max_overlap` the higher score stays (compared with the last kept one).

    Runs of overlapping intervals do not touch each other: those that begin in one stretch of `together` (SPAN) places are streamed by a task in order, with the last kept
    interval as all it holds.
    """
    import pandas as pd

    names = df.columns
    runs = settled(_runs(df, [key], lambda reach: F.col("start") >= reach, together))
    along = Window.partitionBy("__key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    begun = runs.groupBy(F.col(key).alias("__key"), F.col("__bin").alias("b")).agg(F.max("__run").alias("k")).withColumn("__from", F.last(F.when(F.col("k") > 0, F.col("b")), ignorenulls=True).over(along)).drop("k")
    known = runs.where("__run > 0").select(*names, F.col("__bin").alias("__from"))
    open_ = runs.where("__run = 0")
    known = known.unionAll(open_.join(begun, open_[key].eqNullSafe(begun["__key"]) & open_["__bin"].eqNullSafe(begun["b"])).select(*names, "__from"))

    def sweep(batches):
        held, at = None, {c: i for i, c in enumerate(names)}
        group, start, end, score = at[key], at["start"], at["end"], at["score"]
        for batch in batches:
            kept = []
            for *row, begin in batch.itertuples(index=False, name=None):
                if held is not None and held[1] == (row[group], begin) and held[0][end] - row[start] > max_overlap:
                    if row[score] > held[0][score]:
                        held = row, held[1]
                else:
                    if held is not None:
                        kept.append(held[0])
                    held = row, (row[group], begin)
            yield pd.DataFrame(kept, columns=names)
        if held is not None:
            yield pd.DataFrame([held[0]], columns=names)

    return known.repartition(key, "__from").sortWithinPartitions(key, "__from", "start", "end", "score").mapInPandas(sweep, df.schema)


def merge_sorted(*tables: DataFrame) -> DataFrame:
    """The records of several alignment tables in one, by reference, start and name; columns that one lacks are null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).orderBy("ref", "start", "name")


def reciprocal_best(hits: DataFrame) -> DataFrame:
    """(a, b, score) of hits (genome1, a, genome2, b, score) that are best for both sides; ties to the smaller partner."""
    forth = hits.withColumn("r", F.row_number().over(Window.partitionBy("a", "genome2").orderBy(F.desc("score"), "b"))).where("r = 1").drop("r")
    back = hits.withColumn("r", F.row_number().over(Window.partitionBy("b", "genome1").orderBy(F.desc("score"), "a"))).where("r = 1").select("a", "b")
    return forth.join(back, ["a", "b"]).select("a", "b", "score")


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): equal widths over low to high; below is bin 0, above bin bins + 1."""
    return df.groupBy(F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def percentiles(value: str, levels: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> list[Column]:
    return [F.percentile(value, F.lit(x / 100)).cast("long").alias(f"p{x}") for x in levels]
