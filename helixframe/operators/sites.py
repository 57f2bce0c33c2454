"""Reads on contigs by their distinct windows, so that a repeat costs a row for each different window of it and not one for each pair of a read and a place.

Bases are packed by two bits, 32 to a number: a seed and the blocks of 32 bases beside it tell all of a read's window exactly, nothing is looked up again. Equal windows of a
chunk of a contig are a row with their places, equal reads are looked up once, and an offer counts for the first of the read's seeds that fits there. Reads with other signs than
ACGT, and those that reach further than BESIDE bases from a seed, are left to `mapping.placements`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.annotation import chunks
from helixframe.operators.graph import settled

#: Lengths of seeds, bases beside a seed that a read may reach, characters of a contig a row, logarithm of the bits of the filter of seeds at most (16 MB).
SEED_SIZES, BESIDE, CHUNK, FILTER = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 128, 20_000, 27
#: Windows that are looked at together for equal ones.
TOGETHER = 1 << 19
_LOW = 0x5555555555555555
_LETTERS = np.frombuffer(b"ACTG", dtype=np.uint8)  # by the second and third bit of their codes


def width_of(size: str, parts: int) -> Column:
    """The longest seed of which a read of this size has so many."""
    return reduce(lambda found, w: found.when(F.col(size) >= w * parts, w), sorted(SEED_SIZES, reverse=True), F)


def told(seq: str, parts: int, more: int = 0) -> Column:
    """Whether reads are searched here; null for null ones."""
    return F.col(seq).rlike("^[ACGT]+$") & (F.length(seq) <= reduce(lambda found, w: found.when(F.length(seq) >= w * parts, w), sorted(SEED_SIZES, reverse=True), F) + BESIDE + more)


def _packed(values: np.ndarray) -> np.ndarray:
    """For each place the pairs of bits of the 32 places from there, as one number."""
    found, n = values.astype(np.uint64), 1
    while n < 32:
        found = found[..., :-n] << np.uint64(2 * n) | found[..., n:]
        n *= 2
    return found


def _around(packed: np.ndarray, at: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """The blocks before the windows at these places, the nearest first, then those behind them."""
    return np.stack([*(packed[..., at - 32 * (j + 1)] for j in range(blocks)), *(packed[..., at + width + 32 * j] for j in range(blocks))], axis=-1)


def _low(n: int) -> int:
    return (1 << 2 * min(32, max(0, n))) - 1


def _mask(before: int, behind: int, blocks: int) -> np.ndarray:
    """The bits of so many bases before and behind a window."""
    high = [min(32, max(0, behind - 32 * j)) for j in range(blocks)]
    return np.array([*(_low(before - 32 * j) for j in range(blocks)), *(_low(n) << 64 - 2 * n for n in high)], dtype=np.uint64)


def _probes(seeds: np.ndarray, width: int, size: int) -> list[np.ndarray]:
    """Three bits of the filter for each seed."""
    mixed = (seeds + np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return [(mixed * np.uint64(k)) >> np.uint64(64 - size) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _lists(rows: np.ndarray) -> pa.Array:
    """Numbers (n, k) as lists of k."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ravel(rows).view(np.int64)))


def _seeds(queries: DataFrame, blocks: int, size: int) -> DataFrame:
    """(seq, size, width, offset, seed, bits, own, mask, before) of queries (seq, size, width, chosen: offsets of seeds): the seed, its bits in the filter, what is beside it in the read and which bits of that count, and those of each chosen seed before it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, widths, offsets = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            alike: dict[tuple, list[int]] = {}
            for row, shape in enumerate(zip(map(len, texts), widths, map(tuple, offsets))):
                alike.setdefault(shape, []).append(row)
            for (length, width, chosen), owners in alike.items():
                codes = np.frombuffer("".join(texts[row] for row in owners).encode("ascii"), dtype=np.uint8).reshape(len(owners), length)
                pad = 32 * blocks
                packed, take = _packed(np.pad(codes >> 1 & 3, [(0, 0), (pad, pad + 32)])), pa.array(owners)
                for offset in chosen:
                    seeds = np.ascontiguousarray(packed[:, pad + offset]) >> np.uint64(64 - 2 * width)
                    mask = _mask(offset, length - offset - width, blocks)
                    own = _around(packed, np.array([pad + offset]), width, blocks)[:, 0] & mask
                    before = [(_mask(offset - x, 0, blocks) & ~_mask(offset - x - width, 0, blocks) & np.uint64(_LOW))[:blocks].view(np.int64).tolist() for x in chosen if x < offset]
                    many = len(owners)
                    columns = pa.array(np.full(many, offset, dtype=np.int32)), pa.array(seeds.view(np.int64)), _lists(np.stack(_probes(seeds, width, size), axis=-1)), _lists(own), _lists(np.tile(mask & np.uint64(_LOW), (many, 1))), pa.array([before] * many, pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:3]), *columns], names=names)

    names = ["seq", "size", "width", "offset", "seed", "bits", "own", "mask", "before"]
    return queries.select("seq", "size", "width", "chosen").mapInArrow(cut, "seq string, size int, width int, offset int, seed long, bits array<long>, own array<long>, mask array<long>, before array<array<long>>")


def _windows(contigs: DataFrame, contig: str, seq: str, needs: dict[int, int], blocks: int, held: np.ndarray, size: int) -> DataFrame:
    """(contig, width, seed, beside, room, ats): the windows of the contigs that pass the filter, equal ones of a chunk as one row with their places.

    `needs` has how far reads reach from the seeds of each width; `beside` has the blocks so far (see `_around`), and where other signs than ACGT are among them as many blocks
    that mark these; `room` is 1000 times the bases before the window in its contig, and those behind it, as far as needed.
    """
    kind = contigs.schema[contig].dataType.simpleString()
    pad, chunk = 32 * blocks, CHUNK
    cut = chunks(contigs.select(F.col(contig).alias("contig"), F.upper(seq).alias("seq")), "seq", CHUNK, 2 * pad + max(needs) - 1)
    shared, masks = contigs.sparkSession.sparkContext.broadcast(held), {w: _mask(n, n, blocks) for w, n in needs.items()}

    def grouped(column: pa.Array, width: int, found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Batches of the parts (row, offset, places in the part, keys) with keys of equal length."""
        if not found:
            return
        keys = np.concatenate([np.column_stack([np.full(len(at), row, dtype=np.uint64), key]) for row, _, at, key in found])
        at = np.concatenate([at + offset for _, offset, at, _ in found])
        order = np.lexsort([at, *keys.T])
        keys, at = keys[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        first = keys[starts]
        ats = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(at))
        columns = [column.take(pa.array(np.ascontiguousarray(first[:, 0]).view(np.int64))), pa.array(np.full(len(first), width, dtype=np.int32)), pa.array(np.ascontiguousarray(first[:, 1]).view(np.int64)), _lists(np.ascontiguousarray(first[:, 3:])), pa.array(first[:, 2].astype(np.int32)), ats]
        yield pa.RecordBatch.from_arrays(columns, names=["contig", "width", "seed", "beside", "room", "ats"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            column = batch.column(0)
            found: dict[tuple[int, int], list] = {}
            n = 0
            for row, (offset, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                odd = (codes != 65) & (codes != 67) & (codes != 71) & (codes != 84)
                marks = _packed(np.pad(odd, (pad, pad + 32))) if odd.any() else None
                packed = _packed(np.pad(np.where(odd, 0, codes >> 1 & 3).astype(np.uint8), (pad, pad + 32)))
                for width, need in needs.items():
                    first, last = pad if offset else 0, min(chunk + pad, len(codes) - width + 1)
                    if first >= last:
                        continue
                    seeds = packed[pad + first : pad + last] >> np.uint64(64 - 2 * width)
                    at = np.arange(len(seeds))
                    for bit in range(3):
                        probe = _probes(seeds[at], width, size)[bit]
                        at = at[(held[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    seeds, at = seeds[at], at + first
                    if marks is not None:
                        whole = marks[at + pad] >> np.uint64(64 - 2 * width) == 0
                        seeds, at = seeds[whole], at[whole]
                    if not len(at):
                        continue
                    room = (np.minimum(at, need) * 1000 + np.minimum(len(codes) - at - width, need)).astype(np.uint64)
                    key = np.column_stack([seeds, room, _around(packed, at + pad, width, blocks) & masks[width]])
                    strange = _around(marks, at + pad, width, blocks) & masks[width] if marks is not None else np.zeros((len(at), 1), dtype=np.uint64)
                    some = strange.any(axis=1)
                    if some.any():
                        found.setdefault((width, 2), []).append((row, offset, at[some], np.column_stack([key[some], strange[some]])))
                    found.setdefault((width, 1), []).append((row, offset, at[~some], key[~some]))
                    n += len(at)
                if n > TOGETHER:
                    for (width, _), parts in found.items():
                        yield from grouped(column, width, parts)
                    found, n = {}, 0
            for (width, _), parts in found.items():
                yield from grouped(column, width, parts)

    return cut.select("contig", "offset", "seq").mapInArrow(windows, f"contig {kind}, width int, seed long, beside array<long>, room int, ats array<long>")


def _offers(queries: DataFrame, contigs: DataFrame, contig: str, seq: str, most: int, counted: bool, parts: int, reach: int = BESIDE) -> DataFrame | None:
    """Joins distinct queries (seq) with the windows: (seq, size, width, offset, mask, contig, ats or n and the first place, beside, mismatches); None if there are no queries."""
    size = F.length("seq").alias("size")
    rows = settled(queries.select("seq", size).withColumn("width", width_of("size", parts)).where(f"size <= width + {reach}"))
    kept = rows.groupBy("width").agg(F.max("size").alias("longest"), F.sum(F.floor(F.col("size") / F.col("width"))).alias("n")).collect()  # at most as many as SEED_SIZES
    if not kept:
        return None
    needs = {r.width: r.longest - r.width for r in kept}
    blocks, bits = max(1, -(-max(needs.values()) // 32)), min(FILTER, max(15, (16 * sum(r.n for r in kept)).bit_length()))
    every = F.sequence(F.lit(0), F.col("size") - F.col("width"), F.col("width"))
    chosen = rows.withColumn("chosen", every if most else F.array(F.lit(0)))
    choice = bool(most) and any(r.longest // r.width > parts for r in kept)
    from helixframe.operators.mapping import _held

    seeds = settled(_seeds(chosen, blocks, bits))
    held = _held(seeds.select(F.explode("bits").alias("bit")), bits)
    places = _windows(contigs, contig, seq, needs, blocks, held, bits)
    if choice:  # some reads have more seeds than are needed: the rarest are taken
        known = places.groupBy("width", "seed").agg(F.sum(F.size("ats")).alias("n"))
        order = Window.partitionBy("seq").orderBy("n", "offset")
        best = seeds.select("seq", "size", "width", "offset", "seed").join(known, ["width", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order)).where(f"rank <= {parts} AND n > 0")
        seeds = settled(_seeds(best.groupBy("seq", "size", "width").agg(F.sort_array(F.collect_list("offset")).alias("chosen")), blocks, bits))
    if counted:
        own = places.select("width", "seed", "beside", "room", F.size("ats").alias("k"), F.struct("contig", F.get("ats", F.lit(0)).alias("at")).alias("place"))
        places = own.repartition("width", "seed").groupBy("width", "seed", "beside", "room").agg(F.sum("k").alias("n"), F.min("place").alias("place"))
    met = places.join(seeds.drop("bits"), ["width", "seed"])
    unlike = []
    for j in range(2 * blocks):
        x = F.get("beside", F.lit(j)).bitwiseXOR(F.get("own", F.lit(j)))
        # what a read does not reach is not compared; a sign other than ACGT differs from all
        unlike.append(x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.coalesce(F.get("beside", F.lit(2 * blocks + j)), F.lit(0))))
    masked = [u.bitwiseAND(F.get("mask", F.lit(j))) for j, u in enumerate(unlike)]
    met = met.where((F.col("offset") <= F.floor(F.col("room") / 1000)) & (F.col("size") - F.col("offset") - F.col("width") <= F.col("room") % 1000))
    met = met.withColumn("mismatches", reduce(lambda a, b: a + b, map(F.bit_count, masked)).cast("long")).where(F.col("mismatches") <= most)
    met = met.withColumn("_u", F.array(*unlike[:blocks]))
    taken = F.exists("before", lambda m: reduce(lambda a, b: a & b, (F.get("_u", F.lit(j)).bitwiseAND(F.get(m, F.lit(j))) == 0 for j in range(blocks))))
    return met.where(~taken).drop("_u")


def first_places(queries: DataFrame, contigs: DataFrame, contig: str, seq: str, most: int) -> DataFrame | None:
    """(seq, mismatches, n, place: contig and start) of distinct queries (seq): how many places they have with so many different bases, and the first of them."""
    met = _offers(queries, contigs, contig, seq, most, True, most + 1)
    place = F.struct(F.col("place.contig").alias("contig"), (F.col("place.at") - F.col("offset")).alias("start"))
    return met and met.groupBy("seq", "mismatches").agg(F.sum("n").alias("n"), F.min(place).alias("place"))


def matches(queries: DataFrame, contigs: DataFrame, contig: str, seq: str, most: int) -> DataFrame | None:
    """(seq, mismatches, window): the distinct windows of the contigs that distinct queries (seq) fit, other signs than ACGT as N."""
    met = _offers(queries, contigs, contig, seq, most, False, most + 1)
    if met is None:
        return None
    full = F.transform("beside", lambda x, j: x.bitwiseAND(F.get("mask", F.pmod(j, F.size("mask"))).bitwiseOR(F.shiftleft(F.get("mask", F.pmod(j, F.size("mask"))), 1))))
    rows = met.select("seq", "width", "offset", "mismatches", full.alias("beside"), F.size("mask").alias("k")).distinct()

    def bases(found: np.ndarray) -> np.ndarray:
        """Pairs of bits of blocks (n, k) as (n, 32 k)."""
        return (found[:, :, None] >> (np.uint64(62) - np.uint64(2) * np.arange(32, dtype=np.uint64)) & np.uint64(3)).reshape(len(found), -1).astype(np.uint8)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, widths, offsets, blocks, ks = (batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5))
            alike: dict[tuple, list[int]] = {}
            for row, shape in enumerate(zip(map(len, texts), widths, offsets, map(len, blocks), ks)):
                alike.setdefault(shape, []).append(row)
            for (length, width, offset, n, k), owners in alike.items():
                found = np.array([blocks[row] for row in owners], dtype=np.int64).view(np.uint64)
                out = np.frombuffer("".join(texts[row] for row in owners).encode("ascii"), dtype=np.uint8).reshape(-1, length).copy()
                for start, letters in ((0, True), (k, False)):
                    if start >= n:
                        continue
                    half = k // 2
                    before, behind = bases(found[:, start : start + half][:, ::-1]), bases(found[:, start + half : start + k])
                    for part, there in ((out[:, :offset], before[:, before.shape[1] - offset :]), (out[:, offset + width :], behind[:, : length - offset - width])):
                        part[...] = _LETTERS[there] if letters else np.where(there > 0, ord("N"), part)
                text = out.tobytes().decode("ascii")
                windows = [text[i : i + length] for i in range(0, len(text), length)]
                take = pa.array(owners)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(3).take(take), pa.array(windows)], names=["seq", "mismatches", "window"])

    return rows.mapInArrow(spelt, "seq string, mismatches long, window string").distinct()


def sites(windows: DataFrame, contigs: DataFrame, contig: str, seq: str, wide: int) -> DataFrame:
    """(window, contig, bin, starts): the places of distinct windows (window) in the contigs, other signs than ACGT as N, by bins of `wide` bases, in order."""
    kind, word = contigs.schema[contig].dataType.simpleString(), F.col("window").contains("N")
    plain, named = windows.where(~word).select(F.col("window").alias("seq")), contigs.select(F.col(contig).alias("contig"), F.col(seq).alias("seq"))
    met = _offers(plain, named, "contig", "seq", 0, False, 1, BESIDE + 32)
    found = [met.select(F.col("seq").alias("window"), "contig", F.explode("ats").alias("start"))] if met is not None else []
    if (strange := windows.where(word)).take(1):
        from helixframe.operators.mapping import placements

        masked = named.select("contig", F.regexp_replace(F.upper("seq"), "[^ACGT]", "N").alias("seq"))
        rows = placements(strange.select("window", F.col("window").alias("seq")), masked, "window", "contig", "seq", 0, False)
        found.append(rows.select("window", "contig", "start"))
    if not found:
        found = [windows.sparkSession.createDataFrame([], f"window string, contig {kind}, start long")]
    rows = reduce(DataFrame.unionAll, found)
    return rows.groupBy("window", "contig", F.floor(F.col("start") / wide).alias("bin")).agg(F.sort_array(F.collect_list("start")).alias("starts"))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row the smallest first start, and then second, between which the way from first to second lies in one of two ranges."""
    for batch in batches:
        one, two = ((batch.column(k).values.to_numpy(), batch.column(k).offsets.to_numpy()) for k in (7, 8))
        ranges = np.column_stack([batch.column(k).to_numpy() for k in (3, 4, 5, 6)])
        rows, a, b = [], [], []
        for row, (low, high, low2, high2) in enumerate(ranges):
            x, y = one[0][one[1][row] : one[1][row + 1]], two[0][two[1][row] : two[1][row + 1]]
            at, other = np.searchsorted(y, x + low), np.searchsorted(y, x + low2)
            near, far = (np.where(i < len(y), y[np.minimum(i, len(y) - 1)], np.iinfo(np.int64).max) for i in (at, other))
            near_fits, far_fits = near <= x + high, far <= x + high2
            fits = near_fits | far_fits
            if fits.any():
                i = int(fits.argmax())
                rows.append(row)
                a.append(x[i])
                b.append(near[i] if near_fits[i] else far[i])
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["one", "two", "contig", "start1", "start2"])


def nearest(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """(one, two, at: contig, start1, start2): the first places on one contig of two windows (one, two, low, high, low2, high2), the way between which lies from low to high or from low2 to high2.

    `places` is `sites` with bins at least as wide as the longest way. The rarer window of the two is looked up first.
    """
    known = places.groupBy("window").agg(F.sum(F.size("starts")).alias("n"))
    sized = wanted.join(known.select(F.col("window").alias("one"), F.col("n").alias("n1")), "one").join(known.select(F.col("window").alias("two"), F.col("n").alias("n2")), "two")
    ranges, around = ["low", "high", "low2", "high2"], F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.col("bin") + k)).alias("bin")
    found = []
    for a, b, rare in (("one", "two", "n1 <= n2"), ("two", "one", "n1 > n2")):
        few = sized.where(rare).join(places.select(F.col("window").alias(a), "contig", "bin", F.col("starts").alias("s")), a).select("one", "two", *ranges, "contig", "s", around)
        met = few.join(places.select(F.col("window").alias(b), "contig", "bin", F.col("starts").alias("t")), [b, "contig", "bin"])
        found.append(met.select("one", "two", "contig", *ranges, F.col("s" if a == "one" else "t"), F.col("t" if a == "one" else "s")))
    kind = places.schema["contig"].dataType.simpleString()
    rows = reduce(DataFrame.unionAll, found).mapInArrow(_first, f"one string, two string, contig {kind}, start1 long, start2 long")
    return rows.groupBy("one", "two").agg(F.min(F.struct("contig", "start1", "start2")).alias("at"))
