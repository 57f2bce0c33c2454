"""Reads on contigs: all places within a number of mismatches, pairs of mates, spliced reads, and chains of shared minimizers.

A read that fits with `most` mismatches matches in one of any `most` + 1 parts of it. Of a read's disjoint seeds the rarest in the contigs
are taken, so common seeds are looked up only for reads that have no others. Windows of the contigs are hashed where they are read and only
those that some seed may equal (a filter of bits) are shuffled, with two bits of each of the bases beside them: what a seed offers is dropped in
its join when these differ too often, so a repeat's windows do not pass it, and every place that is left is verified on the bases.
Contigs are cut into overlapping chunks: no task holds a chromosome, and long joins are by seed, by chunk and by bins of places.
`placements` lists all places, whose number grows with the square of a repeat's copies; what needs only the best ones goes by distinct windows (see `sites`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixframe.functions import sequence as sq
from helixframe.operators import sites
from helixframe.operators.annotation import chunks
from helixframe.operators.graph import settled

#: Lengths of seeds; a read gets the longest of which it holds enough.
SEED_SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
CHUNK = 20_000
#: Characters before and behind a seed that its join compares; logarithm of the bits of the filter of seeds at most (16 MB).
BESIDE, FILTER = 32, 27


def _strands(reads: DataFrame, read: str, seq: str, both: bool) -> DataFrame:
    """(read, strand, seq, size) of reads with a base; with `both` also their reverse complements."""
    forward = reads.select(F.col(read).alias("read"), F.lit("+").alias("strand"), F.upper(seq).alias("seq"))
    rows = forward.unionAll(forward.select("read", F.lit("-"), sq.reverse_complement("seq"))) if both else forward
    return rows.withColumn("size", F.length("seq")).where("size > 0")


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of so many characters, put together from those of half as long ones."""
    if width == 1:
        return codes.astype(np.uint64) + np.uint64(1)
    left = width // 2
    a, b = _hashes(codes, left), _hashes(codes, width - left)
    n = max(0, codes.shape[-1] - width + 1)
    mixed = (a[..., :n] * np.uint64(0x9E3779B97F4A7C15) ^ (b[..., left : left + n] + np.uint64(width))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _packed(pairs: np.ndarray) -> np.ndarray:
    """For each place the pairs of bits of the BESIDE places from there, as one number."""
    found, n = pairs.astype(np.uint64), 1
    while n < BESIDE:
        found = found[..., :-n] << np.uint64(2 * n) | found[..., n:]
        n *= 2
    return found


def _beside(codes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each of the BESIDE characters before and behind the windows at these places; equal characters have equal bits, outside there are none."""
    packed = _packed(np.pad(codes >> 1 & 3, [(0, 0)] * (codes.ndim - 1) + [(BESIDE, BESIDE)])).view(np.int64)
    return packed[..., at], packed[..., at + BESIDE + width]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - size)


def _seeds(rows: DataFrame, size: int) -> DataFrame:
    """(read, strand, width, offset, seed, bit, left, right, left_mask, right_mask): the disjoint seeds of each read by their hashes, what is beside them, and which of it belongs to the read."""
    kind = rows.schema["read"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, widths = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            alike: dict[tuple[int, int], list[int]] = {}
            for row, shape in enumerate(zip(map(len, texts), widths)):
                alike.setdefault(shape, []).append(row)
            for (length, width), owners in alike.items():
                codes = _codes("".join(texts[row] for row in owners)).reshape(len(owners), length)
                at = np.arange(0, length - width + 1, width)
                seeds = np.ascontiguousarray(_hashes(codes, width)[:, at])
                masks = _beside(np.full((1, length), 2, dtype=np.uint32), at, width)  # code 2 has the bits 01
                columns = np.broadcast_to(at, seeds.shape), seeds.view(np.int64), _bits(seeds, size).astype(np.int64), *_beside(codes, at, width), *(np.broadcast_to(m, seeds.shape) for m in masks)
                owner = pa.array(np.repeat(owners, len(at)))
                yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in batch.columns[:3]), *(pa.array(np.ravel(c)) for c in columns)], names=names)

    names = ["read", "strand", "width", "offset", "seed", "bit", "left", "right", "left_mask", "right_mask"]
    return rows.select("read", "strand", "width", "seq").mapInArrow(cut, f"read {kind}, strand string, width int, " + ", ".join(f"{x} long" for x in names[3:]))


def _held(seeds: DataFrame, size: int) -> np.ndarray:
    """The filter of all seeds: 2 ** size bits (16 MB at most, see FILTER), those of a seed's hash set."""
    rows = seeds.groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()
    held = np.zeros(max(1, 2**size // 8), dtype=np.uint8)
    for row in rows:
        part = np.frombuffer(row.bits, dtype=np.uint8)[: len(held)]
        held[row.part * 4096 : row.part * 4096 + len(part)] = part
    return held


def _places(contigs: DataFrame, contig: str, seq: str, widths: list[int], held: np.ndarray, size: int) -> DataFrame:
    """(width, seed, contig, at, left, right): the windows of the contigs in each of the widths that pass the filter of the seeds, by their hashes, and what is beside them."""
    kind = contigs.schema[contig].dataType.simpleString()
    cut = chunks(contigs.select(F.col(contig).alias("contig"), F.upper(seq).alias("seq")), "seq", CHUNK, 2 * BESIDE + max(widths) - 1)
    chunk, shared = CHUNK, contigs.sparkSession.sparkContext.broadcast(held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for row, (offset, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                codes = _codes(text)
                for width in widths:
                    hashes = _hashes(codes, width)
                    first, last = BESIDE if offset else 0, min(chunk + BESIDE, len(hashes))
                    if first >= last:
                        continue
                    bits = _bits(hashes[first:last], size)
                    at = first + np.flatnonzero(held[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        columns = np.full(len(at), width, dtype=np.int32), hashes[at].view(np.int64), at + offset, *_beside(codes, at, width)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), row))), *map(pa.array, columns)], names=names)

    names = ["contig", "width", "seed", "at", "left", "right"]
    return cut.select("contig", "offset", "seq").mapInArrow(windows, f"contig {kind}, width int, seed long, at long, left long, right long")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the number of different bases for two columns of equally long strings at the end."""
    for batch in batches:
        a, b = (batch.column(k).cast(pa.binary()) for k in (batch.num_columns - 2, batch.num_columns - 1))
        counts = np.zeros(batch.num_rows, dtype=np.int64)
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8) for c in (a, b))
            starts = np.cumsum([0, *(len(v) for v in a.to_pylist())])[:-1]
            counts = np.add.reduceat((x != y).astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts)], names=[*batch.schema.names[:-2], "mismatches"])


def placements(reads: DataFrame, contigs: DataFrame, read: str = "read_id", contig: str = "contig", seq: str = "seq", most: int = 2, both: bool = True) -> DataFrame:
    """(read, contig, start, strand, size, mismatches): every place inside a contig, from 0, where a read or its reverse complement has at most `most` different bases.

    Upper and lower case are alike, other signs than ACGT count as themselves (N is a base like any). Reads of at most `most` bases would fit
    everywhere and are left out, as are null and empty ones. Equal reads have their own rows.
    """
    kinds = {contig: contigs.schema[contig].dataType, read: reads.schema[read].dataType}
    parts = most + 1
    width = reduce(lambda found, w: found.when(F.col("size") >= w * parts, w), sorted(SEED_SIZES, reverse=True), F)
    rows = settled(_strands(reads, read, seq, both).withColumn("width", width).where("width IS NOT NULL"))
    kept = rows.groupBy("width").agg(F.max("size").alias("longest"), F.sum(F.floor(F.col("size") / F.col("width"))).alias("n")).collect()  # at most as many as SEED_SIZES
    if not kept:
        empty = F.lit(None)
        return reads.where("false").select(F.col(read), empty.cast(kinds[contig]).alias(contig), empty.cast("long").alias("start"), empty.cast("string").alias("strand"), empty.cast("int").alias("size"), empty.cast("long").alias("mismatches"))
    bits = min(FILTER, max(15, (16 * sum(r.n for r in kept)).bit_length()))
    seeds = settled(_seeds(rows, bits))
    places = _places(contigs, contig, seq, sorted(r.width for r in kept), _held(seeds, bits), bits)
    if any(r.longest // r.width > parts for r in kept):  # some reads have a choice of seeds
        known = places.groupBy("width", "seed").agg(F.count("*").alias("n"))
        order = Window.partitionBy("read", "strand").orderBy("n", "offset")
        seeds = seeds.join(known, ["width", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order)).where(f"rank <= {parts} AND n > 0")
    offered = places.select("width", "seed", "contig", "at", F.col("left").alias("l"), F.col("right").alias("r")).join(seeds, ["width", "seed"])
    unlike = reduce(lambda a, b: a + b, (F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.col(m))) for x, m in ((F.col("left").bitwiseXOR(F.col("l")), "left_mask"), (F.col("right").bitwiseXOR(F.col("r")), "right_mask"))))
    offers = offered.where(unlike <= most).select("read", "strand", "contig", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    longest = max(r.longest for r in kept)
    size = max(CHUNK, longest)
    cut = chunks(contigs.select(F.col(contig).alias("contig"), F.upper(seq).alias("part")), "part", size, longest - 1)
    met = offers.join(rows.select("read", "strand", "size", "seq"), ["read", "strand"]).withColumn("offset", F.col("start") - F.col("start") % size).join(cut.withColumn("offset", F.col("offset").cast("long")), ["contig", "offset"])
    here = F.col("part").substr((F.col("start") - F.col("offset") + 1).cast("int"), F.col("size"))
    met = met.select(F.col("read").alias(read), F.col("contig").alias(contig), F.col("start").cast("long").alias("start"), "strand", "size", here.alias("here"), "seq").where(F.length("here") == F.col("size"))
    return met.mapInArrow(_differences, StructType([*met.schema.fields[:5], StructField("mismatches", LongType())])).where(F.col("mismatches") <= most)


def mapping_quality(mismatches) -> Column:
    return F.greatest(F.lit(0), 60 - 10 * F.col(mismatches)).cast("int")


def best_placements(found: DataFrame, read: str = "read_id", contig: str = "contig") -> DataFrame:
    """A row per placed read: its place with the fewest mismatches (ties: smaller contig, start, strand), quality, CIGAR, and how many places it has in all and as good as this one.

    A row of `found` stands for `_places` of them, if it says so, of which it has the first.
    """
    place = F.struct("mismatches", contig, "start", "strand", "size")
    fewest = found.groupBy(read, "mismatches").agg((F.sum("_places") if "_places" in found.columns else F.count("*")).alias("n"), F.min(place).alias("p")).groupBy(read).agg(F.sum("n").alias("n_places"), F.min(F.struct("mismatches", "n", "p")).alias("b"))
    return fewest.select(read, f"b.p.{contig}", "b.p.start", "b.p.strand", "b.mismatches", mapping_quality("b.mismatches").alias("quality"), F.concat(F.col("b.p.size").cast("string"), F.lit("M")).alias("cigar"), "n_places", F.col("b.n").alias("n_best"))


def best_places(reads: DataFrame, contigs: DataFrame, read: str = "read_id", contig: str = "contig", seq: str = "seq", most: int = 2, both: bool = True) -> DataFrame:
    """`best_placements` of all `placements`, without a list of them."""
    rows = settled(_strands(reads, read, seq, both))
    told = sites.told("seq", most + 1)
    first = sites.first_places(rows.where(told).select("seq").distinct(), contigs, contig, seq, most)
    names = F.col("read").alias(read), F.col("place.contig").alias(contig), "place.start", "strand", "size", "mismatches", F.col("n").alias("_places")
    found = [rows.join(first, "seq").select(*names)] if first is not None else []
    if (rest := rows.where(~told & (F.col("strand") == "+"))).take(1) or not found:
        found.append(placements(rest.select(F.col("read").alias(read), F.col("seq").alias(seq)), contigs, read, contig, seq, most, both).withColumn("_places", F.lit(1).cast("long")))
    return best_placements(reduce(DataFrame.unionAll, found), read, contig)


def concordant_pairs(first: DataFrame, second: DataFrame, pair: str = "read_id", contig: str = "contig", least: int = 100, most: int = 1000, opposite: bool = True) -> DataFrame:
    """(pair, contig, start1, strand1, start2, strand2, mismatches, template): of the places of two mates on one contig, `least` to `most` bases apart, those with the fewest mismatches.

    Apart is the distance of the starts and the second mate; with `opposite` the mates are on different strands. Ties go to the smaller
    contig and starts. Places meet by bins of `most` bases, so a repeat's places do not all meet each other.
    """
    a = first.select(F.col(pair), F.col(contig), F.col("start").alias("start1"), F.col("strand").alias("strand1"), F.col("mismatches").alias("m1"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("start") / most) + k)).alias("bin"))
    b = second.select(F.col(pair), F.col(contig), F.col("start").alias("start2"), F.col("strand").alias("strand2"), F.col("mismatches").alias("m2"), "size", F.floor(F.col("start") / most).alias("bin"))
    met = a.join(b, [pair, contig, "bin"]).where((F.abs(F.col("start2") - F.col("start1")) + F.col("size")).between(least, most))
    met = met.where("strand1 <> strand2") if opposite else met
    best = F.min(F.struct((F.col("m1") + F.col("m2")).alias("mismatches"), contig, "start1", "start2", "strand1", "strand2", (F.col("start2") - F.col("start1") + F.col("size")).alias("template")))
    return met.groupBy(pair).agg(best.alias("b")).select(pair, f"b.{contig}", "b.start1", "b.strand1", "b.start2", "b.strand2", "b.mismatches", "b.template")


def best_pairs(mates: DataFrame, contigs: DataFrame, pair: str = "read_id", one: str = "one", two: str = "two", contig: str = "contig", seq: str = "seq", most: int = 2, least: int = 100, apart: int = 1000, opposite: bool = True) -> DataFrame:
    """`concordant_pairs` of all `placements` of the mates (pair, one, two), without a list of them: windows that mates fit meet instead of their places."""
    rows = settled(mates.select(F.col(pair).alias("pair"), F.upper(one).alias("one"), F.upper(two).alias("two")).where("one IS NOT NULL AND two IS NOT NULL"))
    strange = rows.where(~(sites.told("one", most + 1) & sites.told("two", most + 1))).select("pair").distinct()
    odd = bool(strange.take(1))
    plain = rows.join(strange, "pair", "left_anti") if odd else rows
    a, b = (_strands(plain, "pair", x, True) for x in ("one", "two"))
    fits = sites.matches(a.select("seq").unionAll(b.select("seq")).distinct(), contigs, contig, seq, most)
    found = []
    if fits is not None:
        fits = settled(fits)
        x = a.join(fits, "seq").select(F.col("read").alias("pair"), F.col("strand").alias("strand1"), F.col("mismatches").alias("m1"), F.col("window").alias("one"))
        y = b.join(fits, "seq").select(F.col("read").alias("pair"), F.col("strand").alias("strand2"), F.col("mismatches").alias("m2"), F.col("window").alias("two"))
        met = settled(x.join(y, "pair").where(F.col("strand1") != F.col("strand2") if opposite else F.lit(True)).distinct())
        size = F.length("two")
        near, far = F.greatest(least - size, F.lit(0)), apart - size
        wanted = met.select("one", "two").distinct().select("one", "two", (-far).alias("low"), (-near).alias("high"), near.alias("low2"), far.alias("high2"))
        windows = met.select(F.explode(F.array("one", "two")).alias("window")).distinct()
        placed = sites.nearest(wanted.select("one", "two", *(F.col(c).cast("long") for c in ("low", "high", "low2", "high2"))), settled(sites.sites(windows, contigs, contig, seq, max(apart, CHUNK))))
        best = F.min(F.struct((F.col("m1") + F.col("m2")).alias("mismatches"), "at.contig", "at.start1", "at.start2", "strand1", "strand2", (F.col("at.start2") - F.col("at.start1") + size).alias("template")))
        found.append(met.join(placed, ["one", "two"]).groupBy("pair").agg(best.alias("b")).select(F.col("pair").alias(pair), F.col("b.contig").alias(contig), "b.start1", "b.strand1", "b.start2", "b.strand2", "b.mismatches", "b.template"))
    if odd or not found:
        kept = rows.join(strange, "pair", "left_semi")
        first, second = (placements(kept.select(F.col("pair").alias(pair), F.col(x).alias(seq)), contigs, pair, contig, seq, most) for x in ("one", "two"))
        found.append(concordant_pairs(first, second, pair, contig, least, apart, opposite))
    return reduce(DataFrame.unionAll, found)


def spliced(reads: DataFrame, contigs: DataFrame, read: str = "read_id", contig: str = "contig", seq: str = "seq", most: int = 2, intron: tuple[int, int] = (50, 500_000)) -> DataFrame:
    """(read, contig, start, intron_start, intron_end, cigar, mismatches) of reads that do not fit as a whole: both halves fit with at most `most` mismatches each, around an intron that starts with GT and ends with AG.

    Introns are longer than the smaller and shorter than the larger bound. Of several the one with the fewest mismatches, then the smaller
    contig, start and intron. Forward strand only. Windows that halves fit are sought with the signs beside them; they meet by bins of the larger bound.
    """
    rows = settled(reads.select(F.col(read).alias("read"), F.upper(seq).alias("seq")).where("seq IS NOT NULL"))
    told = sites.told("seq", most + 1)
    whole = sites.matches(rows.where(told).select("seq").distinct(), contigs, contig, seq, most)
    rest = rows.join(whole.select("seq").distinct(), "seq", "left_anti") if whole is not None else rows
    if (others := rows.where(~told)).take(1):
        fitting = placements(others.select("read", F.col("seq").alias(seq)), contigs, "read", contig, seq, most, both=False)
        rest = rest.join(fitting.select("read").distinct(), "read", "left_anti")
    half = F.floor(F.length("seq") / 2).cast("int")
    rest = settled(rest.select("read", F.col("seq").substr(F.lit(1), half).alias("one"), F.col("seq").substr(half + 1, F.length("seq")).alias("two")))
    both = sites.told("one", most + 1) & sites.told("two", most + 1)
    fits = sites.matches(rest.where(both).select(F.explode(F.array("one", "two")).alias("seq")).distinct(), contigs, contig, seq, most)
    found = []
    if fits is not None:
        fits = settled(fits)
        x = rest.where(both).select("read", F.col("one").alias("seq")).join(fits, "seq").select("read", F.concat("window", F.lit("GT")).alias("one"), F.length("seq").alias("n1"), F.col("mismatches").alias("m1"))
        y = rest.where(both).select("read", F.col("two").alias("seq")).join(fits, "seq").select("read", F.concat(F.lit("AG"), "window").alias("two"), F.length("seq").alias("n2"), F.col("mismatches").alias("m2"))
        met = settled(x.join(y, "read").distinct())
        ways = (F.col("n1") + intron[0] - 1).cast("long").alias("low"), (F.col("n1") + intron[1] - 3).cast("long").alias("high"), F.lit(1).cast("long").alias("low2"), F.lit(0).cast("long").alias("high2")  # from GT to AG, signs included; no second range
        windows = met.select(F.explode(F.array("one", "two")).alias("window")).distinct()
        placed = sites.nearest(met.select("one", "two", *ways).distinct(), settled(sites.sites(windows, contigs, contig, seq, intron[1] + 2 * sites.BESIDE)))
        opens, ends = F.col("at.start1") + F.col("n1"), F.col("at.start2") + 2
        cigar = F.concat(F.col("n1").cast("string"), F.lit("M"), (ends - opens).cast("string"), F.lit("N"), F.col("n2").cast("string"), F.lit("M"))
        best = F.min(F.struct((F.col("m1") + F.col("m2")).alias("mismatches"), "at.contig", F.col("at.start1").alias("start"), opens.alias("intron_start"), ends.alias("intron_end"), cigar.alias("cigar")))
        found.append(met.join(placed, ["one", "two"]).groupBy("read").agg(best.alias("b")).select(F.col("read").alias(read), F.col("b.contig").alias(contig), "b.start", "b.intron_start", "b.intron_end", "b.cigar", "b.mismatches"))
    if (strange := rest.where(~both & (F.length("two") > most))).take(1) or not found:
        found.append(_spliced_by_places(strange, contigs, read, contig, seq, most, intron))
    return reduce(DataFrame.unionAll, found)


def _spliced_by_places(halves: DataFrame, contigs: DataFrame, read: str, contig: str, seq: str, most: int, intron: tuple[int, int]) -> DataFrame:
    """`spliced` of the halves of reads (read, one, two) by all of their places."""
    left, right = (placements(halves.select(F.col("read").alias(read), F.col(x).alias(seq)), contigs, read, contig, seq, most, both=False) for x in ("one", "two"))
    wide = intron[1]
    a = left.select(read, contig, "start", (F.col("start") + F.col("size")).alias("intron_start"), F.col("size").alias("n1"), F.col("mismatches").alias("m1"))
    a = a.withColumn("bin", F.explode(F.array(F.floor(F.col("intron_start") / wide), F.floor(F.col("intron_start") / wide) + 1)))
    b = right.select(read, contig, F.col("start").alias("intron_end"), F.col("size").alias("n2"), F.col("mismatches").alias("m2"), F.floor(F.col("start") / wide).alias("bin"))
    length = F.col("intron_end") - F.col("intron_start")
    met = a.join(b, [read, contig, "bin"]).where((length > intron[0]) & (length < intron[1]))
    cut = chunks(contigs.select(contig, F.upper(seq).alias("part")), "part", CHUNK, 1)
    for at, signal in (("intron_start", "GT"), ("intron_end", "AG")):
        place = F.col(at) - (2 if at == "intron_end" else 0)
        met = met.withColumn("offset", place - place % CHUNK).join(cut.withColumn("offset", F.col("offset").cast("long")), [contig, "offset"]).where(F.col("part").substr((place - F.col("offset") + 1).cast("int"), F.lit(2)) == signal).drop("offset", "part")
    cigar = F.concat(F.col("n1").cast("string"), F.lit("M"), length.cast("string"), F.lit("N"), F.col("n2").cast("string"), F.lit("M"))
    best = F.min(F.struct((F.col("m1") + F.col("m2")).alias("mismatches"), contig, "start", "intron_start", "intron_end", cigar.alias("cigar")))
    return met.groupBy(read).agg(best.alias("b")).select(read, f"b.{contig}", "b.start", "b.intron_start", "b.intron_end", "b.cigar", "b.mismatches")


def guided_contigs(reads: DataFrame, contigs: DataFrame, read: str = "read_id", contig: str = "contig", seq: str = "seq", most: int = 2, depth: int = 2, least: int = 200) -> DataFrame:
    """(contig, start, end, coverage, seq): stretches of at least `least` bases of the reference that `depth` reads or more cover at each place, from 0, with the commonest base of the reads (the smallest of equals).

    A read stands at its best place (see `best_placements`), on the strand that fits. Bases are counted before they are shuffled on; a stretch is put together as one row.
    """
    placed = best_places(reads, contigs, read, contig, seq, most).select(F.col(read).alias("r"), F.col(contig).alias("contig"), "start", "strand")
    rows = placed.join(reads.select(F.col(read).alias("r"), F.upper(seq).alias("s")), "r").withColumn("s", F.when(F.col("strand") == "+", F.col("s")).otherwise(sq.reverse_complement("s")))
    bases = rows.select("contig", "start", F.posexplode(F.split("s", "")).alias("i", "base")).groupBy("contig", (F.col("start") + F.col("i")).alias("pos"), "base").agg(F.count("*").alias("n"))
    won = bases.groupBy("contig", "pos").agg(F.sum("n").alias("depth"), F.min(F.struct((-F.col("n")).alias("n"), "base")).alias("b")).where(F.col("depth") >= depth)
    island = F.col("pos") - F.row_number().over(Window.partitionBy("contig").orderBy("pos"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b.base"))), lambda x: x["base"]), "")
    made = won.withColumn("island", island).groupBy("contig", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg("depth").alias("coverage"), text.alias("seq"))
    return made.where(F.col("end") - F.col("start") >= least).select(F.col("contig").alias(contig), "start", "end", "coverage", "seq")
