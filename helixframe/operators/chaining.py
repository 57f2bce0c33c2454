"""Long reads on contigs: shared minimizers and the chains that run along both.

Anchors of a read, contig and strand are cut where no chain can cross (a step of more than `STEP` bases on the contig), and each stretch
is streamed in order of its places: a task holds the last `LOOK_BACK` anchors with the score, start and length of the best chain that
ends in each, so a read of any length takes the memory of these. Chains need no way back: what is asked for is carried along.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Anchors before an anchor that may come before it in a chain; bases of a step at most; by how many bases the steps on read and contig may differ; anchors of a chain at least.
LOOK_BACK, STEP, SLIP, LEAST = 50, 5000, 1000, 3
#: A new base is worth so much, a base of difference between the steps costs one.
GAIN = 4


_COMPLEMENT = str.maketrans("ACGTUN", "TGCAAN")


def sequence_minimizers(seq: str, k: int, w: int) -> list[tuple[int, str, bool]]:
    """(pos, kmer, as_is): of every w consecutive k-mers without N the smallest on either strand (first of equals), once; as it stands or as its reverse complement."""
    back = re.sub("[^ACGTN]", "N", seq.translate(_COMPLEMENT))[::-1]
    size, n, unknown, last, picked, held = len(seq), 0, seq.find("N"), -1, [], deque()
    for i in range(size - k + 1):
        if 0 <= unknown < i:
            unknown = seq.find("N", i)
        if 0 <= unknown < i + k:
            continue
        forward, other = seq[i : i + k], back[size - k - i : size - i]
        as_is = forward <= other
        kmer = forward if as_is else other
        while held and held[-1][1][1] > kmer:
            held.pop()
        held.append((n, (i, kmer, as_is)))
        if held[0][0] <= n - w:
            held.popleft()
        n += 1
        if n >= w and held[0][0] != last:
            last = held[0][0]
            picked.append(held[0][1])
    return picked


def _picked(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, seq in enumerate(batch.column(1).to_pylist()):
            found = sequence_minimizers(seq, k, w)
            if found:
                pos, kmers, as_is = zip(*found)
                columns = pa.array(pos, pa.int64()), pa.array(kmers), pa.array(as_is), pa.array(np.full(len(found), len(seq), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), row))), *columns], names=["key", "pos", "kmer", "as_is", "size"])


def anchors(reads: DataFrame, contigs: DataFrame, read: str = "read_id", contig: str = "contig", seq: str = "seq", k: int = 15, w: int = 10) -> DataFrame:
    """(read, contig, strand, q, r): shared minimizers (the least k-mer on either strand of w places), from 0; q counts from the read's end if it matches the other strand, so that chains rise in both."""

    def of(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col(key), F.upper(seq).alias("seq")).where(F.length("seq") >= k)
        kind = df.schema[key].dataType.simpleString()
        return rows.mapInArrow(partial(_picked, k=k, w=w), f"key {kind}, pos long, kmer string, as_is boolean, size int").withColumnRenamed("key", key)

    a, b = of(reads, read), of(contigs, contig).select(contig, F.col("pos").alias("r"), "kmer", F.col("as_is").alias("there"))
    met = a.join(b, "kmer")
    return met.select(read, contig, F.when(F.col("as_is") == F.col("there"), "+").otherwise("-").alias("strand"), F.when(F.col("as_is") == F.col("there"), F.col("pos")).otherwise(F.col("size") - k - F.col("pos")).cast("long").alias("q"), F.col("r").cast("long").alias("r"))


def _best_before(held: deque, q: int, r: int, k: int) -> tuple[int, int, int, int]:
    """(score, anchors, q and r of the start) of the best chain that ends in (q, r); of equal scores the one whose last anchor comes first."""
    best = (GAIN * k, 1, q, r)
    if held:
        qs, rs, scores = (np.array([h[i] for h in held], dtype=np.int64) for i in (0, 1, 2))
        dq, dr = q - qs, r - rs
        slip = np.abs(dq - dr)
        fine = (dq > 0) & (dr > 0) & (dq <= STEP) & (dr <= STEP) & (slip < SLIP)
        if fine.any():
            value = np.where(fine, scores + GAIN * np.minimum(np.minimum(dq, dr), k) - slip, np.iinfo(np.int64).min)
            at = int(value.argmax())
            if value[at] > best[0]:
                _, _, _, n, q0, r0 = held[at]
                best = (int(value[at]), n + 1, q0, r0)
    return best


def chains(found: DataFrame, k: int = 15, read: str = "read_id", contig: str = "contig", least: int = LEAST, look_back: int = LOOK_BACK) -> DataFrame:
    """(read, contig, strand, score, n, q_start, q_end, r_start, r_end): for each first anchor the best chain of at least `least` anchors that starts with it; ends are behind the last k-mer.

    A chain's score is GAIN for each base that its k-mers add, less the differences between steps on read and contig. Equal anchors count once.
    """
    key = [read, contig, "strand"]
    order = Window.partitionBy(*key).orderBy("r", "q")
    cut = (F.col("r") - F.lag("r").over(order) > STEP).cast("int")
    rows = found.distinct().withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")
    kinds = {c: found.schema[c].dataType.simpleString() for c in (read, contig)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque(maxlen=look_back)
        for batch in batches:
            out = []
            for a, b, strand, q, r, stretch in batch.itertuples(index=False):
                if (a, b, strand, stretch) != now:
                    now = (a, b, strand, stretch)
                    held.clear()
                score, n, q0, r0 = _best_before(held, q, r, k)
                held.append((q, r, score, n, q0, r0))
                if n >= least:
                    out.append((a, b, strand, score, n, q0, q + k, r0, r + k))
            yield pd.DataFrame(out, columns=[read, contig, "strand", "score", "n", "q_start", "q_end", "r_start", "r_end"])

    dealt = rows.repartition(*key, "stretch").sortWithinPartitions(*key, "stretch", "r", "q").select(*key, "q", "r", "stretch")
    ends = dealt.mapInPandas(run, f"`{read}` {kinds[read]}, `{contig}` {kinds[contig]}, strand string, score long, n long, q_start long, q_end long, r_start long, r_end long")
    best = F.max(F.struct("score", "n", (-F.col("r_end")).alias("r"), (-F.col("q_end")).alias("q")))
    return ends.groupBy(*key, "q_start", "r_start").agg(best.alias("b")).select(*key, "b.score", "b.n", "q_start", (-F.col("b.q")).alias("q_end"), "r_start", (-F.col("b.r")).alias("r_end"))


def best_chains(found: DataFrame, read: str = "read_id", contig: str = "contig") -> DataFrame:
    """The chain of the highest score of each read (ties: contig, strand, start), with quality: 5 for each anchor, 60 at most."""
    place = F.min(F.struct((-F.col("score")).alias("s"), contig, "strand", "r_start", "q_start", "q_end", "r_end", "n"))
    return found.groupBy(read).agg(place.alias("b")).select(read, f"b.{contig}", "b.strand", (-F.col("b.s")).alias("score"), "b.n", "b.q_start", "b.q_end", "b.r_start", "b.r_end", F.least(F.lit(60), 5 * F.col("b.n")).cast("int").alias("quality"))
