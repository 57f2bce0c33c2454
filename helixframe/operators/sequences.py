"""Tables of sequences: k-mers, motifs, windows, codon use, assembly statistics, consensus, minimizers, open reading frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq


def filter_length(df: DataFrame, seq: str = "seq", least: int = 0, most: int | None = None) -> DataFrame:
    n = F.length(seq)
    return df.where((n >= least) & (n <= most if most is not None else F.lit(True)))


def filter_gc(df: DataFrame, seq: str = "seq", least: float = 0.0, most: float = 1.0) -> DataFrame:
    return df.where(sq.gc_content(seq).between(least, most))


def kmers(df: DataFrame, key: str, k: int, seq: str = "seq", canonical: bool = False, step: int = 1) -> DataFrame:
    """(key, pos, kmer) of every window without N; canonical: the smaller of a k-mer and its reverse complement."""
    rows = df.select(F.col(key), F.posexplode(sq.windows(F.upper(F.col(seq)), k, step)).alias("pos", "kmer")).where(~F.col("kmer").contains("N"))
    rows = rows.withColumn("pos", F.col("pos") * step)
    return rows.withColumn("kmer", F.least("kmer", sq.reverse_complement("kmer"))) if canonical else rows


def kmer_counts(df: DataFrame, key: str, k: int, seq: str = "seq", canonical: bool = True, per_sequence: bool = False) -> DataFrame:
    rows = kmers(df, key, k, seq, canonical)
    return rows.groupBy(*([key] if per_sequence else []), "kmer").agg(F.count("*").alias("n"))


def kmer_frequency(counts: DataFrame) -> DataFrame:
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("kmer", "n", (F.col("n") / F.col("total")).alias("frequency"))


def kmer_similarity(df: DataFrame, key: str, k: int, seq: str = "seq", most_common: int = 200, candidates: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, jaccard, containment of a in b, cosine) of sequence pairs a < b that share a k-mer.

    `candidates`: a table (a, b) of the pairs to compare; without it every pair that meets in a k-mer.
    """
    counts = kmer_counts(df, key, k, seq, per_sequence=True)
    sizes = counts.groupBy(key).agg(F.count("*").alias("size"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    one, two = counts.select("kmer", F.col(key).alias("a"), F.col("n").alias("x")), counts.select("kmer", F.col(key).alias("b"), F.col("n").alias("y"))
    met = candidates.join(one, "a").join(two, ["b", "kmer"]) if candidates is not None else one.join(two, "kmer").where("a < b")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("x") * F.col("y")).alias("dot"))
    pairs = pairs.join(sizes.select(F.col(key).alias("a"), F.col("size").alias("sa"), F.col("norm").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("size").alias("sb"), F.col("norm").alias("nb")), "b")
    return pairs.select("a", "b", "shared", (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("sa")).alias("containment"), (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def bottom_sketch(df: DataFrame, key: str, k: int, size: int, seq: str = "seq") -> DataFrame:
    """(key, hashes): the `size` smallest k-mer hashes of each sequence."""
    rows = kmers(df, key, k, seq, canonical=True).select(key, F.xxhash64("kmer").alias("h")).distinct()
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= size)
    return best.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("hashes"))


def sketch_similarity(a, b) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def solid_kmers(reads: DataFrame, key: str, k: int, least: int = 3, seq: str = "seq") -> DataFrame:
    return kmer_counts(reads, key, k, seq).where(F.col("n") >= least)


def kmer_completeness(assembly: DataFrame, reads: DataFrame, key: str, k: int, least: int = 3) -> DataFrame:
    """One row: solid read k-mers, how many of them the assembly has, their share, and the quality value of the assembly's own k-mers."""
    solid = solid_kmers(reads, key, k, least).select("kmer")
    own = kmer_counts(assembly, key, k).select("kmer").withColumn("own", F.lit(1))
    both = solid.withColumn("solid", F.lit(1)).join(own, "kmer", "full")
    row = both.agg(F.count("solid").alias("n_solid"), F.count("own").alias("n_assembly"), F.count(F.when(F.col("solid").isNotNull() & F.col("own").isNotNull(), 1)).alias("n_shared"))
    error = 1 - F.pow(F.col("n_shared") / F.col("n_assembly"), F.lit(1.0 / k))
    return row.withColumn("completeness", F.when(F.col("n_solid") > 0, F.col("n_shared") / F.col("n_solid"))).withColumn("qv", F.when(error > 0, -10 * F.log10(error)))


def exact_motifs(df: DataFrame, key: str, k: int, least: int = 2, seq: str = "seq") -> DataFrame:
    """K-mers by the number of different sequences that hold them."""
    return kmers(df, key, k, seq).select(key, "kmer").distinct().groupBy("kmer").agg(F.count("*").alias("n_sequences")).where(F.col("n_sequences") >= least)


def position_weights(df: DataFrame, key: str, k: int, seq: str = "seq", pseudocount: float = 1.0) -> DataFrame:
    """(pos, base, n, weight): counts over all windows and their log2 odds to a quarter."""
    rows = kmers(df, key, k, seq).select(F.posexplode(F.split("kmer", "")).alias("pos", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    n = rows.groupBy("pos", "base").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("pos"))
    return n.withColumn("weight", F.log2((F.col("n") + pseudocount) / (total + 4 * pseudocount) / 0.25))


def score_motif(df: DataFrame, weights: dict[int, dict[str, float]], key: str, seq: str = "seq", threshold: float = 0.0) -> DataFrame:
    """(key, pos, score) of the windows whose summed weights reach the threshold, best first within a sequence."""
    k = len(weights)
    rows = kmers(df, key, k, seq)
    total = F.lit(0.0)
    for i, of in weights.items():
        base = F.substring("kmer", i + 1, 1)
        value = F.lit(0.0)
        for b, w in of.items():
            value = F.when(base == b, F.lit(float(w))).otherwise(value)
        total = total + value
    return rows.withColumn("score", total).where(F.col("score") >= threshold).select(key, "pos", "kmer", "score")


def codon_usage(df: DataFrame, frame: int = 0, seq: str = "seq") -> DataFrame:
    """(codon, n, frequency) over all sequences, codons with N left out."""
    n = df.select(F.explode(sq.codons(seq, frame)).alias("codon")).where(~F.col("codon").contains("N")).groupBy("codon").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("codon", "n", (F.col("n") / F.col("total")).alias("frequency"))


def codon_adaptation(df: DataFrame, weights: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, cai): exp of the mean ln of the codons' positive weights (codon, w)."""
    rows = df.select(key, F.explode(sq.codons(seq)).alias("codon")).join(weights.where("w > 0"), "codon")
    return rows.groupBy(key).agg(F.exp(F.avg(F.log("w"))).alias("cai"))


def gc_windows(df: DataFrame, key: str, size: int, step: int, seq: str = "seq") -> DataFrame:
    """(key, start, gc, skew, entropy) of sliding windows; skew is (G - C) / (G + C)."""
    rows = df.select(F.col(key), F.posexplode(sq.windows(F.upper(F.col(seq)), size, step)).alias("i", "w"))
    g, c = sq.count_of("w", "G"), sq.count_of("w", "C")
    return rows.select(key, (F.col("i") * step).cast("long").alias("start"), sq.gc_content("w").alias("gc"), F.when(g + c > 0, (g - c) / (g + c)).otherwise(F.lit(0.0)).alias("skew"), sq.shannon_entropy("w", "ACGT").alias("entropy"))


def cumulative_skew(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, skew): the running sum of +1 for G and -1 for C."""
    rows = df.select(F.col(key), F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("pos", "base")).where("base <> ''")
    step = F.when(F.col("base") == "G", 1).when(F.col("base") == "C", -1).otherwise(0)
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.sum(step).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("skew"))


def cpg_islands(df: DataFrame, key: str, size: int = 200, step: int = 50, min_gc: float = 0.5, min_ratio: float = 0.6, seq: str = "seq") -> DataFrame:
    """(key, start, end): windows with enough GC and observed over expected CpG, overlapping ones merged."""
    from helixframe.operators.intervals import merged

    rows = df.select(F.col(key), F.posexplode(sq.windows(F.upper(F.col(seq)), size, step)).alias("i", "w"))
    expected = sq.count_of("w", "C") * sq.count_of("w", "G") / F.lit(float(size))
    good = rows.where((sq.gc_content("w") >= min_gc) & (expected > 0) & (sq.count_pattern("w", "CG") / expected >= min_ratio))
    return merged(good.select(key, (F.col("i") * step).cast("long").alias("start"), (F.col("i") * step + size).cast("long").alias("end")), key)


def nx(df: DataFrame, group: list[str], length: str = "length", levels: tuple[int, ...] = (50,)) -> DataFrame:
    """n, total, mean, min, max, and for each level x: Nx (the length at which the sum, longest first, reaches x %) and Lx (how many are needed).

    Lengths are counted first, so a group needs one row for each different length.
    """
    counts = df.groupBy(*group, F.col(length).alias("len")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*group).orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*group)
    run = counts.withColumns({"cum": F.sum(F.col("len") * F.col("c")).over(order), "k": F.sum("c").over(order), "total": F.sum(F.col("len") * F.col("c")).over(every)})
    marks = []
    for x in levels:
        need = F.col("total") * (x / 100)
        reached = F.col("cum") >= need
        more = F.ceil(F.try_divide(need - (F.col("cum") - F.col("len") * F.col("c")), F.col("len")))  # none for a length of 0, whose first one will do
        marks += [F.max(F.when(reached, F.col("len"))).alias(f"n{x}"), F.min(F.when(reached, F.col("k") - F.col("c") + F.greatest(more, F.lit(1)))).cast("long").alias(f"l{x}")]
    return run.groupBy(*group).agg(F.sum("c").alias("n"), F.max("total").alias("total"), (F.max("total") / F.sum("c")).alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"), *marks)


def contig_statistics(df: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """Counts by length class, GC weighted by length, and N's."""
    n = F.length(seq)
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(n).alias("total"), *(F.count_if(n >= x).alias(f"n_{x}") for x in (1000, 5000, 10000, 50000)), (F.sum(sq.count_of(F.upper(F.col(seq)), "GC")) / F.sum(n)).alias("gc"), F.sum(sq.count_of(F.upper(F.col(seq)), "N")).alias("n_count"))


def consensus(df: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """Most common character of every column, gaps skipped, ties to the smaller; one string a group of aligned sequences."""
    rows = df.select(*group, F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("pos", "base")).where(~F.col("base").isin("-", ".", ""))
    counts = rows.groupBy(*group, "pos", "base").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(*group, "pos").orderBy(F.desc("n"), "base"))).where("r = 1")
    return best.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))


def minimizers(df: DataFrame, key: str, k: int, w: int, seq: str = "seq") -> DataFrame:
    """(key, pos, kmer): of every w consecutive k-mers the smallest canonical one (first of equals)."""
    rows = kmers(df, key, k, seq, canonical=True)
    span = Window.partitionBy(key).orderBy("pos").rowsBetween(0, w - 1)
    picked = rows.withColumn("m", F.min(F.struct("kmer", "pos")).over(span)).withColumn("c", F.count("*").over(span)).where(F.col("c") == w)
    return picked.select(key, F.col("m.pos").alias("pos"), F.col("m.kmer").alias("kmer")).distinct()


def mismatch_neighbours(seed, alphabet: str = "ACGT") -> Column:
    """The seed and all strings with one other character."""
    s = sq._col(seed)
    others = F.flatten(F.transform(sq.positions(F.length(s)), lambda i: F.transform(F.array(*map(F.lit, alphabet)), lambda c: F.concat(F.substring(s, F.lit(1), i - 1), c, F.substring(s, i + 1, F.length(s))))))
    return F.array_distinct(F.concat(F.array(s), others))


def seed_hits(reads: DataFrame, reference: DataFrame, k: int, read: str = "read_id", contig: str = "contig") -> DataFrame:
    """(read, contig, diagonal, n): shared seeds by diagonal, the best diagonal of each read and contig."""
    a, b = kmers(reads, read, k).withColumnRenamed("pos", "rp"), kmers(reference, contig, k).withColumnRenamed("pos", "cp")
    hits = a.join(b, "kmer").groupBy(read, contig, (F.col("cp") - F.col("rp")).alias("diagonal")).agg(F.count("*").alias("n"))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(read, contig).orderBy(F.desc("n"), "diagonal"))).where("r = 1").drop("r")


_START, _STOP = {"ATG", "GTG", "TTG"}, {"TAA", "TAG", "TGA"}
_REVERSE = str.maketrans("ACGTN", "TGCAN")


def open_reading_frames(seq: str, least: int = 100, starts=frozenset({"ATG"}), both: bool = True) -> list[tuple[int, int, str, int, int]]:
    """(start, end, strand, frame, length) from 0, half-open, on the forward strand; every start up to its stop is one."""
    found, n = [], len(seq)
    for strand, text in (("+", seq),) + ((("-", seq.translate(_REVERSE)[::-1]),) if both else ()):
        for frame in range(3):
            open_at: list[int] = []
            for i in range(frame, n - 2, 3):
                codon = text[i : i + 3]
                if codon in starts:
                    open_at.append(i)
                elif codon in _STOP:
                    for a in open_at:
                        if i + 3 - a >= least:
                            found.append((a, i + 3, strand, frame, i + 3 - a) if strand == "+" else (n - i - 3, n - a, strand, frame, i + 3 - a))
                    open_at = []
    return sorted(found)


def find_orfs(df: DataFrame, key: str, seq: str = "seq", least: int = 100, starts: tuple[str, ...] = ("ATG",), both: bool = True) -> DataFrame:
    """Open reading frames of every sequence, each sequence on its own."""
    allowed = frozenset(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *orf) for k, s in zip(batch["k"], batch["s"]) for orf in open_reading_frames((s or "").upper().replace("U", "T"), least, allowed, both)]
            yield pd.DataFrame(rows, columns=["k", "start", "end", "strand", "frame", "length"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInPandas(run, f"k {kind}, start long, end long, strand string, frame int, length long").withColumnRenamed("k", key)


def tandem_repeats(seq: str, least: int = 3, copies: int = 2, longest: int = 50) -> list[tuple[int, int, str, int]]:
    """(start, end, unit, copies), greedy from the left without overlap, the shortest unit that repeats first."""
    found, i = [], 0
    while i < len(seq):
        for size in range(1, longest + 1):
            unit, n = seq[i : i + size], 1
            while len(unit) == size and seq.startswith(unit, i + n * size):
                n += 1
            if n >= copies and n * size >= least:
                found.append((i, i + n * size, unit, n))
                i += n * size
                break
        else:
            i += 1
    return found


#: Bases that are laid end to end and searched at once, and cells of alignments that are filled at once.
TOGETHER, CELLS = 200_000, 4_000_000


def _laid(sequences: list[str], codec: str = "utf-32-le", kind=np.uint32, errors: str = "surrogatepass") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, owner, left) of sequences end to end: each place's sequence and how many places its sequence has from there on."""
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    codes = np.frombuffer("".join(sequences).encode(codec, errors), dtype=kind)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return codes, owner, np.cumsum(sizes)[owner] - np.arange(len(codes))


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most `most`; a larger one stands alone."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


_OPPOSITE = np.arange(128, dtype=np.uint32)
_OPPOSITE[[ord(c) for c in "ACGTN"]] = [ord(c) for c in "TGCAN"]


def _palindromes(sequences: list[str], shortest: int, longest: int, gap: int) -> dict[str, np.ndarray]:
    codes, owner, left = _laid(sequences)
    opposite = np.where(codes < 128, _OPPOSITE[np.minimum(codes, 127)], codes)
    total, found = len(codes), []
    for g in range(0, gap + 1, 2):
        arms, best = np.ones(total + 1, dtype=bool), np.zeros(total, dtype=np.int32)
        for arm in range(1, longest + 1):  # an arm is one of the next place that is shorter by a base, and its outermost pair
            width, longer = 2 * arm + g, np.zeros(total + 1, dtype=bool)
            if width <= total:
                n = total - width + 1
                longer[:n] = arms[1 : n + 1] & (opposite[:n] == codes[width - 1 :]) & (left[:n] >= width)
            arms = longer
            if arm >= shortest:
                best[arms[:total]] = arm
            if not arms.any():
                break
        at = np.flatnonzero(best)
        found.append((at, best[at], np.full(len(at), g)))
    at, arm, g = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((g, at))
    at, arm, g = at[order], arm[order], g[order]
    start = at - (np.searchsorted(owner, owner[at]) if len(at) else at)
    return {"owner": owner[at], "start": start, "end": start + 2 * arm + g, "arm": arm, "gap": g}


def palindromes(seq: str, shortest: int = 4, longest: int = 20, gap: int = 10) -> list[tuple[int, int, int, int]]:
    """(start, end, arm, gap): an arm, an even gap, and the arm's reverse complement; the longest arm of each start and gap."""
    found = _palindromes([seq], shortest, longest, gap)
    return list(zip(*(found[c].tolist() for c in ("start", "end", "arm", "gap"))))


def _tables(df: DataFrame, key: str, seq: str, function: Callable[[list[str]], dict[str, np.ndarray]], schema: str, upper: bool = True) -> DataFrame:
    """A table function of sequences, many at once; it tells whose each row is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = [(s or "").upper() if upper else s for s in batch["s"]], batch["k"]
            for i, j in _slices([len(s) for s in texts], TOGETHER):
                found = function(texts[i:j])
                yield pd.DataFrame({"k": keys.iloc[i + found.pop("owner")].array, **found})

    return df.select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, {schema}").withColumnRenamed("k", key)


def _table(df: DataFrame, key: str, seq: str, function, schema: str) -> DataFrame:
    """A table function of single sequences."""
    names = ["k", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *row) for k, s in zip(batch["k"], batch["s"]) for row in function((s or "").upper())], columns=names)

    return df.select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, {schema}").withColumnRenamed("k", key)


def find_tandem_repeats(df: DataFrame, key: str, seq: str = "seq", least: int = 3, copies: int = 2) -> DataFrame:
    return _table(df, key, seq, lambda s: tandem_repeats(s, least, copies), "start long, end long, unit string, copies long")


def find_palindromes(df: DataFrame, key: str, seq: str = "seq", shortest: int = 4) -> DataFrame:
    return _tables(df, key, seq, lambda s: _palindromes(s, shortest, 20, 10), "start long, end long, arm int, gap int")


_PAIRS = {("A", "U"), ("U", "A"), ("G", "C"), ("C", "G"), ("G", "U"), ("U", "G")}


def _stem_loops(sequences: list[str], stem: int, loops: range, share: float, longest: int) -> dict[str, np.ndarray]:
    codes, owner, left = _laid([s.replace("T", "U") for s in sequences], "latin-1", np.uint8, "replace")
    total, pairs = len(codes), np.zeros((256, 256), dtype=bool)
    for a, b in _PAIRS:
        pairs[ord(a), ord(b)] = True
    found = []
    for loop in loops:
        paired = np.zeros(total + 1, dtype=np.int32)
        for size in range(1, longest + 1):  # a stem is one of the next place that is shorter by a pair, and its outermost pair
            width = 2 * size + loop
            if width > total:
                break
            n = total - width + 1
            paired = paired[1 : n + 1] + pairs[codes[:n], codes[width - 1 :]]
            if size >= stem:
                at = np.flatnonzero((paired >= size * share) & (left[:n] >= width))
                found.append((at, np.full(len(at), size), np.full(len(at), loop), paired[at] / size))
    at, size, loop, share_ = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
    order = np.lexsort((loop, size, 2 * size + loop, at))
    at, size, loop = at[order], size[order], loop[order]
    start = at - np.searchsorted(owner, owner[at])
    return {"owner": owner[at], "start": start, "end": start + 2 * size + loop, "stem": size, "loop": loop, "paired": share_[order].astype(float)}


def stem_loops(seq: str, stem: int = 4, loops: range = range(3, 9), share: float = 0.8, longest: int = 14) -> list[tuple[int, int, int, int, float]]:
    """(start, end, stem, loop, paired share) of stems of `stem` to `longest` bases that pair, G-U included, in at least that share."""
    found = _stem_loops([seq], stem, loops, share, longest)
    return list(zip(*(found[c].tolist() for c in ("start", "end", "stem", "loop", "paired"))))


def find_stem_loops(df: DataFrame, key: str, seq: str = "seq", stem: int = 4) -> DataFrame:
    return _tables(df, key, seq, lambda s: _stem_loops(s, stem, range(3, 9), 0.8, 14), "start long, end long, stem int, loop int, paired double")


# --- exact search -----------------------------------------------------------------------------------------------------


def _suffixes(sequences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(order, owner, left, ranks) of sequences, which are not empty, end to end: their places by sequence and suffix, and ranks of all places by 1, 2, 4, ... characters.

    Prefix doubling: places are ranked by one character, then by pairs of ranks at double distance, until no two of a sequence are equal.
    """
    codes, owner, left = _laid(sequences)
    total = len(codes)
    key, width, ranks = owner * (1 << 21) + codes, 1, []
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(total, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]]))
        ranks.append(rank.astype(np.int32))
        if not total or rank[order[-1]] == total:
            return order, owner, left, ranks
        ahead = np.zeros(total, dtype=np.int64)
        ahead[: max(0, total - width)] = rank[width:]
        key, width = rank * (total + 1) + np.where(left > width, ahead, 0), 2 * width


def _suffix_table(sequences: list[str]) -> dict[str, np.ndarray]:
    ended = [s + "$" for s in sequences]
    order, owner, _, _ = _suffixes(ended)
    first = np.concatenate([[0], np.cumsum([len(s) for s in ended])])
    whose, text = owner[order], np.array(list("".join(ended)), dtype=object)
    before = np.where(order == first[whose], first[whose + 1] - 1, order - 1)
    return {"owner": whose, "rank": np.arange(len(order)) - first[whose], "pos": order - first[whose], "bwt": text[before]}


def _whole_tables(df: DataFrame, key: str, seq: str, function: Callable[[list[str]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """`_tables` of sequences as they are; null ones have no rows."""
    return _tables(df.where(F.col(seq).isNotNull()), key, seq, function, schema, upper=False)


def suffix_array(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, rank, pos, bwt): the places of each sequence in the order of its suffixes, an end sign included, and the character before each; nothing is shuffled."""
    return _whole_tables(df, key, seq, _suffix_table, "rank long, pos long, bwt string")


def search_all(df: DataFrame, patterns: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, pattern, pos): every place of every pattern (column pattern), overlapping ones too; patterns meet sequences by their first bases."""
    k = patterns.agg(F.min(F.length("pattern"))).first()[0] or 1
    seeds = df.select(F.col(key), F.col(seq).alias("s"), F.posexplode(sq.windows(F.col(seq), k)).alias("pos", "seed"))
    met = seeds.join(patterns.select("pattern", F.substring("pattern", 1, k).alias("seed")).distinct(), "seed")
    return met.where(F.col("s").substr(F.col("pos") + 1, F.length("pattern")) == F.col("pattern")).select(key, "pattern", F.col("pos").cast("long").alias("pos"))


def _repeats(sequences: list[str]) -> dict[str, np.ndarray]:
    ended = [s + "$" for s in sequences]
    order, owner, left, ranks = _suffixes(ended)
    one, two = order[:-1], order[1:]
    beside = owner[one] == owner[two]
    one, two = one[beside], two[beside]
    most, common = np.minimum(left[one], left[two]) - 1, np.zeros(len(one), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # equal ranks stand for 2 ** k equal characters, or for equal rests
        p, q = one + common, two + common
        fits = common + (1 << k) <= most
        same = fits & (ranks[k][np.where(fits, p, 0)] == ranks[k][np.where(fits, q, 0)])
        common += same << k
    whose, first = owner[one], np.concatenate([[0], np.cumsum([len(s) for s in ended])])
    best = np.lexsort((np.arange(len(one)), -common, whose))  # the first of equals in the order of suffixes is the smallest
    best = best[np.concatenate([[True], whose[best][1:] != whose[best][:-1]])] if len(best) else best
    texts = [ended[w][p : p + n] for w, p, n in zip(whose[best].tolist(), (one[best] - first[whose[best]]).tolist(), common[best].tolist())]
    return {"owner": whose[best], "length": common[best], "repeat": np.array(texts, dtype=object)}


def longest_repeat(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, length, repeat): the longest substring found twice or more in a sequence (the smallest of equals), from the common prefixes of neighbouring suffixes."""
    return _whole_tables(df, key, seq, _repeats, "length long, repeat string")


# --- assembly ---------------------------------------------------------------------------------------------------------


def _walked(links: DataFrame, most: int) -> DataFrame:
    """(kmer, back, steps, low) after doubling steps back: the first edge of each edge's path, the steps to it and the smallest edge on the way."""
    from helixframe.operators.graph import settled

    width = 1
    while width < 2 * most:
        jump = links.select(F.col("kmer").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"), F.col("low").alias("lower"))
        new = settled(links.join(jump, "back").select("kmer", F.col("further").alias("back"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "lower").alias("low"), (F.col("back") != F.col("further")).alias("moved")))
        moved, links, width = new.where("moved").limit(1).count(), new.drop("moved"), 2 * width
        if not moved:
            break
    return links


def unitigs(reads: DataFrame, key: str, k: int, seq: str = "seq", least: int = 1) -> DataFrame:
    """(contig, n_kmers, coverage, seq): maximal unbranched paths of the de Bruijn graph whose edges are k-mers seen `least` times or more, and whose nodes are their ends.

    Each edge finds the first edge of its path by doubling steps back over inner nodes (one edge in, one out), so a path of n edges
    takes log n rounds. Closed rings without a branch start at their smallest k-mer. A contig is named by its first k-mer.
    """
    from helixframe.operators.graph import settled

    edges = kmers(reads, key, k, seq).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    edges = settled(edges.select("kmer", "n", F.substring("kmer", 1, k - 1).alias("src"), F.substring("kmer", 2, k - 1).alias("dst")))
    out, into = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("kmer").alias("before"))
    inner = out.join(into, "node").where("o = 1 AND i = 1").select(F.col("node").alias("src"), "before")
    # back: an edge of the same path, and how many steps before; an edge without one before it is its own
    single = settled(edges.join(inner, "src", "left").select("kmer", F.coalesce("before", "kmer").alias("back"), F.col("before").isNotNull().cast("long").alias("steps"), F.col("kmer").alias("low")))
    n = edges.count()
    links = _walked(single, n)
    # in a ring every edge still moves on: it is cut before its smallest k-mer and walked again
    rest = links.select(F.col("kmer").alias("back"), F.col("steps").alias("rest"))
    placed = settled(links.join(rest, "back"))
    paths = placed.where("rest = 0").select("kmer", "back", "steps")
    rings = placed.where("rest > 0").select("kmer", "low")
    if rings.limit(1).count():
        cut = F.col("kmer") == F.col("low")
        again = single.drop("low").join(rings, "kmer").select("kmer", F.when(cut, F.col("kmer")).otherwise(F.col("back")).alias("back"), F.when(cut, 0).otherwise(1).cast("long").alias("steps"), "low")
        paths = paths.unionAll(_walked(settled(again), n).select("kmer", "back", "steps"))
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("steps", F.substring("kmer", k, 1).alias("base")))), lambda x: x["base"]), "")
    made = paths.join(edges.select("kmer", "n"), "kmer").groupBy(F.col("back").alias("contig")).agg(F.count("*").alias("n_kmers"), F.avg("n").alias("coverage"), tail.alias("tail"))
    return made.select("contig", "n_kmers", "coverage", F.concat(F.substring("contig", 1, k - 1), "tail").alias("seq"))


def overlap_edges(reads: DataFrame, key: str, least: int, seq: str = "seq", seed: int = 16) -> DataFrame:
    """(a, b, overlap): for different reads the longest suffix of a, of at least `least` bases, that b starts with (not all of either).

    Suffixes meet the starts of reads by their length and all their bases, those of more than `seed` bases by their first ones, which are then compared whole.
    """
    seed, n, size = max(seed, least), F.col("n"), F.length(seq)
    short = F.sequence(F.lit(least), F.least(F.lit(seed), size - 1))
    starts = reads.where(size > least).select(F.col(key).alias("b"), F.col(seq).alias("sb"), F.explode(short).alias("k"))
    starts = starts.select("b", F.when(F.col("k") == seed, F.col("sb")).alias("sb"), "k", F.col("sb").substr(F.lit(1), F.col("k")).alias("bases"))
    ends = reads.where(size > least).select(F.col(key).alias("a"), F.col(seq).alias("sa"), F.explode(F.sequence(F.lit(least), size - 1)).alias("n"))
    ends = ends.select("a", "n", F.least(n, F.lit(seed)).alias("k"), F.expr("right(sa, n)").alias("end")).select("a", "n", "k", F.when(n > seed, F.col("end")).alias("end"), F.substring("end", 1, seed).alias("bases"))
    met = ends.join(starts, ["k", "bases"]).where((F.col("a") != F.col("b")) & ((n <= seed) | ((n < F.length("sb")) & F.startswith("sb", "end"))))
    return met.groupBy("a", "b").agg(F.max("n").cast("long").alias("overlap"))


def quality_by_position(reads: DataFrame, quality: str = "quality", offset: int = 33) -> DataFrame:
    """(pos, n, mean): mean quality of each place of the reads."""
    rows = reads.select(F.posexplode(sq.phred(quality, offset)).alias("pos", "q")).where("q >= 0")
    return rows.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.avg("q").alias("mean"))


def error_profile(pairs: DataFrame) -> DataFrame:
    """(ref, base, n, rate) of aligned bases (columns ref, base; a gap is -): substitutions, insertions and deletions by their share of the reference base."""
    n = pairs.groupBy("ref", "base").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("ref")))


def align(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, local: bool = False) -> tuple[float, str, str]:
    """Needleman-Wunsch or, local, Smith-Waterman with a linear gap; on the way back diagonal comes before up before left."""
    rows, cols = len(a) + 1, len(b) + 1
    score = [[0] * cols for _ in range(rows)]
    if not local:
        for i in range(rows):
            score[i][0] = i * gap
        for j in range(cols):
            score[0][j] = j * gap
    best, at = 0, (0, 0)
    for i in range(1, rows):
        above, row, x = score[i - 1], score[i], a[i - 1]
        for j in range(1, cols):
            value = max(above[j - 1] + (match if x == b[j - 1] else mismatch), above[j] + gap, row[j - 1] + gap)
            row[j] = value = max(value, 0) if local else value
            if local and value > best:
                best, at = value, (i, j)
    i, j = at if local else (rows - 1, cols - 1)
    total, one, two = score[i][j], [], []
    while (i or j) and not (local and score[i][j] == 0):
        if i and j and score[i][j] == score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            one.append(a[i])
            two.append(b[j])
        elif i and score[i][j] == score[i - 1][j] + gap:
            i -= 1
            one.append(a[i])
            two.append("-")
        else:
            j -= 1
            one.append("-")
            two.append(b[j])
    return float(total), "".join(reversed(one)), "".join(reversed(two))


def _square(sequences: list[str], blank: int) -> np.ndarray:
    out = np.full((len(sequences), max(map(len, sequences))), blank, dtype=np.int64)
    for row, s in zip(out, sequences):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def _aligned(one: list[str], two: list[str], match: int, mismatch: int, gap: int, local: bool) -> list[tuple[float, str, str]]:
    """`align` of many pairs at once: rows of all their tables are filled together, a row's gaps by running maxima."""
    if not all(isinstance(x, int) for x in (match, mismatch, gap)):
        return [align(x, y, match, mismatch, gap, local) for x, y in zip(one, two)]
    a, b = _square(one, -1), _square(two, -2)
    slope = gap * np.arange(b.shape[1] + 1)
    score = np.zeros((len(one), a.shape[1] + 1, b.shape[1] + 1), dtype=np.int32)
    if not local:
        score[:, 0], score[:, :, 0] = slope, gap * np.arange(a.shape[1] + 1)
    for i in range(1, a.shape[1] + 1):
        above, row = score[:, i - 1], score[:, i].astype(np.int64)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(a[:, i - 1, None] == b, match, mismatch), above[:, 1:] + gap)
        if local:
            np.maximum(row, 0, out=row)
        score[:, i] = np.maximum.accumulate(row - slope, axis=1) + slope
    out = []
    for table, x, y in zip(score, one, two):
        i, j = len(x), len(y)
        if local:
            part = table[: i + 1, : j + 1]
            i, j = divmod(int(part.argmax()), j + 1)  # the first of equals
        total, p, q, cells = int(table[i, j]), [], [], table.tolist() if len(x) < 1000 > len(y) else table
        while (i or j) and not (local and cells[i][j] == 0):
            here = cells[i][j]
            if i and j and here == cells[i - 1][j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
                i, j = i - 1, j - 1
                p.append(x[i])
                q.append(y[j])
            elif i and here == cells[i - 1][j] + gap:
                i -= 1
                p.append(x[i])
                q.append("-")
            else:
                j -= 1
                p.append("-")
                q.append(y[j])
        out.append((float(total), "".join(reversed(p)), "".join(reversed(q))))
    return out


def align_pairs(df: DataFrame, a: str, b: str, local: bool = False, match: int = 2, mismatch: int = -1, gap: int = -2) -> DataFrame:
    """Adds score, aligned_a, aligned_b and identity to a table of sequence pairs."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(df.schema.jsonValue()).add("score", "double").add("aligned_a", "string").add("aligned_b", "string").add("identity", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one, two, found = [x or "" for x in batch[a]], [y or "" for y in batch[b]], []
            for i, j in _slices([(len(x) + 1) * (len(y) + 1) for x, y in zip(one, two)], CELLS):
                found += _aligned(one[i:j], two[i:j], match, mismatch, gap, local)
            same = [sum(p == q for p, q in zip(x, y)) / len(x) if x else 0.0 for _, x, y in found]
            yield batch.assign(score=[f[0] for f in found], aligned_a=[f[1] for f in found], aligned_b=[f[2] for f in found], identity=same)

    return df.mapInPandas(run, schema)


def clean_product(description) -> Column:
    """A hit's description without organism and accession, first letter upper."""
    text = F.trim(F.regexp_replace(F.regexp_replace(sq._col(description), r"\s*\[[^\]]*\]\s*$", ""), r"^\S+\|\S*\s+", ""))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))


def extract_pattern(pattern: str, text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in re.finditer(pattern, text)]
