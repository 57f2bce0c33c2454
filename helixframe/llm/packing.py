"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are encoded, ended with id 0 and cut only if they are longer than a sequence: into full pieces, before which one
shorter piece holds the rest. Full pieces are sequences of their own; the shorter pieces are packed. They are dealt into
blocks of about `BLOCK` items, so a task never holds more, however large the corpus. For each block `ISLANDS` populations
evolve in separate tasks, from best-fit groupings in the order of noisy sizes: crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold duplicates and places the displaced items best fit, largest first. After each epoch every
island's best packing migrates to the next island. In the end poorly filled bins of all blocks are dissolved and packed again together, until that saves nothing.
"""

from __future__ import annotations

import math
import random
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.bpe import Memo, encoder
from helixframe.llm.common import slices, stored

CAPACITY, END_ID = 2048, 0
BLOCK, ISLANDS, POPULATION, CHILDREN, EPOCHS = 8192, 3, 3, 3, 2
#: Generations of an epoch at most; items in the children of generations that save no bin, after which it ends; spread of the logarithm of the sizes that order the first groupings.
GENERATIONS, EFFORT, NOISE = 40, 60_000, 0.3
#: Bins filled less than this share are packed again with those of other blocks; at most so many rounds.
POOR, ROUNDS = 0.97, 4
_PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"


# --- pieces ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _bytes(path: str) -> Memo:
    enc = encoder(path)
    swap = sys.byteorder != "little"

    def make(key: str | tuple[str]) -> bytes:
        ids = array("I", enc.merged(key) if isinstance(key, str) else enc.ids_for(key))
        if swap:
            ids.byteswap()
        return ids.tobytes()

    return Memo(make)


def ids_of(text: str, path: str) -> bytes:
    """The document's ids with the closing one, as little-endian unsigned 32-bit numbers."""
    return b"".join(encoder(path).looked_up(text, _bytes(path))) + END_ID.to_bytes(4, "little")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: item (a number of its own), doc_id, piece, start, length, ids_crc32, sequence_id (of full pieces, else null) and, with `with_ids`, ids (binary)."""
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = ids_of(value or "", path)
                    for j, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((number, doc, j, start, length, zlib.crc32(own), -1 - number if length == capacity else None, *([own] if with_ids else [])))
                        number += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


# --- one block ------------------------------------------------------------------------------------------------------


class Bins:
    """Open bins by free space: finds the fullest bin that still takes an item. A packing is a list of bins, each a list of item numbers."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free, self.by_free, self.mask = capacity, [], [], [[] for _ in range(capacity + 1)], 0
        self.generations = 0

    def add(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        if free:
            self.by_free[free].append(len(self.bins) - 1)
            self.mask |= 1 << free

    def put(self, item: int, size: int) -> None:
        """Best fit; opens a bin if none takes the item."""
        fits = self.mask >> size
        if not fits:
            self.add([item], self.capacity - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        held = self.by_free[free]
        k = held.pop()
        if not held:
            self.mask ^= 1 << free
        self.bins[k].append(item)
        left = free - size
        self.free[k] = left
        if left:
            self.by_free[left].append(k)
            self.mask |= 1 << left


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(capacity)
    for i in order:
        bins.put(i, sizes[i])
    return bins


def fitness(packing: Bins) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones (sum of squared fill)."""
    c = packing.capacity
    return len(packing.bins), -sum((c - f) ** 2 for f in packing.free)


def crossover(one: Bins, other: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Injects well-filled bins of `one` into `other`; bins of `other` that hold any of their items go, and what they held else is placed best fit."""
    chosen = [k for k, f in enumerate(one.free) if f <= 0.01 * one.capacity and rng.random() < 0.3]
    child, used = Bins(one.capacity), bytearray(len(sizes))
    for k in chosen:
        child.add(list(one.bins[k]), one.free[k])
        for i in one.bins[k]:
            used[i] = 1
    displaced = []
    for items, free in zip(other.bins, other.free):
        taken = [used[i] for i in items]
        # mutation: bins that are not quite full are often dissolved, others now and then, so that their items can go elsewhere
        if any(taken) or rng.random() < (0.8 if free > 0.002 * other.capacity else 0.25):
            displaced += [i for i, t in zip(items, taken) if not t]
        else:
            child.add(list(items), free)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, one.capacity, child)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Items over half a sequence need one each; together with the rest at least their sum."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: list[int], seed: int, elites: list[Bins], capacity: int = CAPACITY) -> Bins:
    """One epoch of one island: its best packing, with the number of generations.

    It starts from the elites and from best-fit groupings, largest first by sizes with random noise, so that no two are alike. At
    least one generation runs; the lower bound ends the epoch, or generations with `EFFORT` items in their children that save no bin.
    """
    rng, least, n = random.Random(seed), lower_bound(sizes, capacity), len(sizes)
    population = [*elites]
    while len(population) < POPULATION + bool(elites):
        noisy = [-size * math.exp(rng.gauss(0, NOISE)) for size in sizes]
        population.append(best_fit(sizes, sorted(range(n), key=noisy.__getitem__), capacity))
    fewest, since = min(len(p.bins) for p in population), 0
    for generation in range(1, GENERATIONS + 1):
        for _ in range(CHILDREN):
            child = crossover(*rng.sample(population, 2), sizes, rng)
            worst = max(range(len(population)), key=lambda k: fitness(population[k]))
            if fitness(child) < fitness(population[worst]):
                population[worst] = child
        now = min(len(p.bins) for p in population)
        fewest, since = (now, 0) if now < fewest else (fewest, since + 1)
        if now <= least or since * CHILDREN * n >= EFFORT:
            break
    best = min(population, key=fitness)
    best.generations = generation
    return best


def _rebuilt(numbers: list[int], sizes: list[int], capacity: int) -> Bins:
    """A packing from the bin number of each item."""
    held: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        held.setdefault(b, []).append(i)
    packing = Bins(capacity)
    for b in sorted(held):
        packing.add(held[b], capacity - sum(sizes[i] for i in held[b]))
    return packing


def _numbers(packing: Bins, n: int) -> list[int]:
    numbers = [0] * n
    for b, items in enumerate(packing.bins):
        for i in items:
            numbers[i] = b
    return numbers


# --- all blocks -----------------------------------------------------------------------------------------------------

_STATE = "block long, island int, items array<long>, sizes array<int>, bins array<int>, n_bins int, fit double, generations int"


def _islands(items: DataFrame, capacity: int, round_: int) -> DataFrame:
    """The best packing of each island of each block of (item, length) rows, after all epochs (see `_STATE`)."""
    n = items.count()
    blocks = max(1, -(-n // BLOCK))
    # a block's share is bounded: items go to blocks by a hash of their own number, and so about BLOCK come together
    dealt = items.select(F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(blocks)).alias("block"), F.struct("item", "length").alias("x"))
    held = dealt.groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x")).select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.col("x.item").alias("items"), F.col("x.length").cast("array<int>").alias("sizes"))
    state = held.withColumns({"bins": F.lit(None).cast("array<int>"), "n_bins": F.lit(0), "fit": F.lit(0.0), "generations": F.lit(0), "guests": F.lit(None).cast("array<array<int>>")})

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    sizes = [int(s) for s in r.sizes]
                    elites = [_rebuilt(list(g), sizes, capacity) for g in (r.guests if r.guests is not None else [])]
                    best = evolve(sizes, hash((int(r.block), int(r.island), number, round_)), elites, capacity)
                    yield pd.DataFrame({"block": [r.block], "island": [r.island], "items": [r.items], "sizes": [sizes], "bins": [_numbers(best, len(sizes))], "n_bins": [len(best.bins)], "fit": [fitness(best)[1]], "generations": [int(r.generations) + best.generations]})

        return run

    tasks = min(4 * ISLANDS * blocks, max(blocks, items.sparkSession.sparkContext.defaultParallelism) * ISLANDS)
    for number in range(EPOCHS):
        state = state.repartition(tasks, "block", "island").mapInPandas(epoch(number), _STATE)
        if number + 1 < EPOCHS:
            state = stored(state, "islands")
            # the elite of island k goes to island k + 1 of its block; the island's own best stays
            guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("bins").alias("guest"))
            state = state.join(guests, ["block", "island"]).withColumn("guests", F.array("bins", "guest")).drop("guest")
    return state


def _packed(items: DataFrame, capacity: int, round_: int) -> DataFrame:
    """Packs (item, length) rows in blocks: item, length, block, bin, fill, place."""
    state = _islands(items, capacity, round_)
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "sizes", "bins"), F.struct("n_bins", "fit", "island")).alias("b"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                bins, sizes = np.asarray(r.bins, dtype=np.int64), np.asarray(r.sizes, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                starts = np.searchsorted(bins[order], bins[order], side="left")
                place = np.empty(len(bins), dtype=np.int64)
                place[order] = ends - sizes[order] - (ends - sizes[order])[starts]
                yield pd.DataFrame({"item": np.asarray(r.items), "length": sizes, "block": r.block, "bin": bins, "fill": np.bincount(bins, weights=sizes)[bins].astype(np.int64), "place": place})

    return best.select("block", "b.items", "b.sizes", "b.bins").mapInPandas(places, "item long, length long, block long, bin long, fill long, place long")


def evolution(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(block, island, n_items, least, plain, random, n_bins, generations) of the first round: the lower bound, bins of best fit with the
    largest first and in random order, the island's bins, and the generations that it took. To look at, not used for packing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sizes = [int(s) for s in r.sizes]
                plain = best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity)
                shuffled = best_fit(sizes, random.Random(1).sample(range(len(sizes)), len(sizes)), capacity)
                yield pd.DataFrame([(r.block, r.island, len(sizes), lower_bound(sizes, capacity), len(plain.bins), len(shuffled.bins), r.n_bins, r.generations)], columns=["block", "island", "n_items", "least", "plain", "random", "n_bins", "generations"])

    state = _islands(cut_pieces.where("sequence_id IS NULL").select("item", "length"), capacity, 0)
    return state.mapInPandas(run, "block long, island int, n_items int, least int, plain int, random int, n_bins int, generations int")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places every piece of `pieces` (stored): adds sequence_id and offset. Pieces of the same sequence lie one after the other from 0.

    Equal documents are packed each for itself. An empty table gives no rows.
    """
    spark = cut_pieces.sparkSession
    rest, done = cut_pieces.where("sequence_id IS NULL").select("item", "length"), []
    for round_ in range(ROUNDS):
        packed = stored(_packed(rest, capacity, round_), "packed")
        poor = packed.where(F.col("fill") < int(POOR * capacity))
        count = packed.agg(F.countDistinct("block").alias("blocks"), F.sum((F.col("fill") < int(POOR * capacity)).cast("int")).alias("poor")).first()
        last = round_ == ROUNDS - 1 or (count["blocks"] or 0) <= 1 or not count["poor"]
        done.append((round_, packed if last else packed.where(F.col("fill") >= int(POOR * capacity))))
        if last:
            break
        rest = poor.select("item", "length")
    placed = None
    for round_, packed in done:
        part = packed.select("item", (F.lit(round_ << 56) + F.col("block") * F.lit(1 << 16) + F.col("bin")).cast("long").alias("at"), F.col("place").alias("offset"))
        placed = part if placed is None else placed.unionAll(part)
    joined = cut_pieces.join(placed, "item", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "at").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Encodes, cuts and packs every row of `docs`; see `pieces` and `pack`.

    A null or empty text is the closing id alone. Repeated rows are packed each; a null doc_id stays null. Other columns are ignored.
    """
    return pack(stored(pieces(docs, path, text, key, capacity), "pieces"), capacity)
