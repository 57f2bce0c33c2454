"""Genes on contigs in two passes: long reading frames of all contigs teach the model, then the starts of each stop compete.

The model is of fixed size: shares of ribosome binding motifs, the share of G and C, and base probabilities given up to `ORDER` bases before,
interpolated by counts. Its counts are sums over tasks. Contigs are rows: a task scans one at a time, by codon positions and running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.sequences import _REVERSE

# Start codons with their weights, stop codons, and motifs of ribosome binding sites.
START_WEIGHTS = {"ATG": 1.0, "GTG": 0.8, "TTG": 0.5}
STOPS = ("TAA", "TAG", "TGA")
BINDING = ("AGGAGG", "AGGAG", "GGAGG", "AGGA", "GAGG")
#: Bases before a start that are looked at, bases of a training frame and of a gene at least, overlap that two genes may have.
UPSTREAM, LONG, LEAST, OVERLAP = 20, 300, 90, 60
#: Bases before a base that tell of it, and how many counts a shorter context weighs.
ORDER, WEIGHT = 8, 10.0

_CODE = np.full(256, -1, dtype=np.int64)
_CODE[[65, 67, 71, 84]] = range(4)


def codes(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]


def words(c: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words of `size` bases at each place, -1 where they hold another sign."""
    n = len(c) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, fine = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(size):
        part = c[k : k + n]
        out, fine = out * 4 + part, fine & (part >= 0)
    return np.where(fine, out, -1)


@cache
def _number(word: str) -> int:
    return int(words(codes(word), len(word))[0])


@cache
def _marked(names: tuple[str, ...]) -> np.ndarray:
    """Of each codon's number whether it is among the names; the last place stands for other signs."""
    out = np.zeros(65, dtype=bool)
    out[[_number(x) for x in names]] = True
    return out


class Strand:
    """One strand of a contig: its bases' numbers, words of any size, and of each start codon the next stop codon of its frame."""

    def __init__(self, text: str) -> None:
        self.codes = codes(text).astype(np.int32)
        self._words, self._clean = {1: self.codes}, bool((self.codes >= 0).all())

    def words(self, size: int) -> np.ndarray:
        """Numbers of the words of `size` bases at each place, each from the word that is shorter by a base; -1 where they hold another sign."""
        if size not in self._words:
            shorter, last = self.words(size - 1)[:-1], self.codes[size - 1 :]
            word = shorter * 4 + last
            self._words[size] = word if self._clean else np.where((shorter >= 0) & (last >= 0), word, -1)
        return self._words[size]

    def frames(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of each start codon that leaves `least` bases before the stop codon, by stop."""
        w = self.words(3)
        start, stop = (np.flatnonzero(_marked(tuple(names))[w]) for names in (START_WEIGHTS, STOPS))
        at, end = [], []
        for f in range(3):
            own, ends = start[start % 3 == f], stop[stop % 3 == f]
            next_ = np.searchsorted(ends, own)
            own, next_ = own[next_ < len(ends)], next_[next_ < len(ends)]
            far = own <= ends[next_] - least
            at.append(own[far])
            end.append(ends[next_[far]])
        at, end = np.concatenate(at), np.concatenate(end)
        order = np.lexsort((at, end))
        return at[order], end[order]

    def upstream(self, motif: str, at: np.ndarray) -> np.ndarray:
        """Whether the motif is among the bases before each place that are looked at."""
        places = np.flatnonzero(self.words(len(motif)) == _number(motif))
        return np.searchsorted(places, at - len(motif), "right") > np.searchsorted(places, at - UPSTREAM)

    def weights(self, at: np.ndarray, of: dict[str, float]) -> np.ndarray:
        """The weight of the codon at each place."""
        table = np.zeros(64)
        table[[_number(x) for x in of]] = list(of.values())
        return table[self.words(3)[at]]


class Model:
    """What the first pass learns: `binding` (share of each motif among those found), `gc`, and log odds of a base by its context for each order."""

    def __init__(self, binding: dict[str, int], gc: float, counts: list[np.ndarray]):
        total = sum(binding.values()) or 1
        self.binding, self.gc = {m: binding.get(m, 0) / total for m in BINDING}, gc
        background = np.log(np.array([(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2]).clip(1e-10))
        self.odds, before = [], np.full((1, 4), 0.25)
        for order, flat in enumerate(counts):
            table = flat.reshape(-1, 4)
            shorter = np.tile(before, (len(table) // len(before), 1)) if order else before
            before = (table + WEIGHT * shorter) / (table.sum(axis=1, keepdims=True) + WEIGHT)
            self.odds.append((np.log(before) - background).ravel())

    def coding(self, strand: Strand, at: int, end: int) -> float:
        """Mean log odds of the bases from `at` to `end`, each by as many of them before it as the model knows."""
        total, word = 0.0, 0
        for k, c in enumerate(strand.codes[at : min(end, at + ORDER)].tolist()):
            if c < 0:
                break
            word = word * 4 + c
            total += self.odds[k][word]
        w = strand.words(ORDER + 1)[at : max(at, end - ORDER)]
        return float(total + self.odds[ORDER][w[w >= 0]].sum()) / max(1, end - at)


def learn(contigs: DataFrame, seq: str = "seq", long: int = LONG) -> Model:
    """Counts over every reading frame of at least `long` bases on both strands; frames with several starts count for each, contexts for the longest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        motifs, gc, total = dict.fromkeys(BINDING, 0), 0, 0
        counts = [np.zeros(4 ** (k + 1), dtype=np.int64) for k in range(ORDER + 1)]
        held: list[list[np.ndarray]] = [[] for _ in counts]
        waiting = 0

        def add() -> None:
            for n, own in zip(counts, held):
                if own:
                    n += np.bincount(np.concatenate(own), minlength=len(n))
                    own.clear()

        for batch in batches:
            for s in batch["seq"]:
                s = (s or "").upper()
                gc, total = gc + s.count("G") + s.count("C"), total + len(s)
                for strand in (Strand(s), Strand(s.translate(_REVERSE)[::-1])):
                    at, stop = strand.frames(long - 3)
                    for m in BINDING:
                        motifs[m] += int(strand.upstream(m, at).sum())
                    stop, first = np.unique(stop, return_index=True)
                    for a, b in zip(at[first].tolist(), (stop + 3).tolist()):  # the longest of each stop
                        for k in range(ORDER + 1):
                            w = strand.words(k + 1)[a : max(a, b - k)]
                            held[k].append(w[w >= 0])
                        waiting += b - a
                        if waiting > 1_000_000:
                            add()
                            waiting = 0
        add()
        rows = [(-1, k, motifs[m]) for k, m in enumerate(BINDING)] + [(-2, 0, gc), (-2, 1, total)]
        rows += [(k, int(i), int(counts[k][i])) for k in range(ORDER + 1) for i in np.flatnonzero(counts[k])]
        yield pd.DataFrame(rows, columns=["kind", "place", "n"])

    summed = contigs.select(F.col(seq).alias("seq")).mapInPandas(run, "kind int, place long, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toPandas()  # at most 4 ** ORDER + 1 rows and a third more
    counts = [np.zeros(4 ** (k + 1)) for k in range(ORDER + 1)]
    for kind, own in summed.groupby("kind"):
        if kind >= 0:
            counts[kind][own["place"].to_numpy()] = own["n"].to_numpy()
    held = {(k, p): n for k, p, n in summed[summed["kind"] < 0].itertuples(index=False)}
    return Model({m: int(held.get((-1, k), 0)) for k, m in enumerate(BINDING)}, held.get((-2, 0), 0) / max(1, held.get((-2, 1), 0)), counts)


def _running_gc(c: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((c == 1) | (c == 2))])


def start_scores(model: Model, strand: Strand, at: np.ndarray, stop: np.ndarray, gc: np.ndarray) -> np.ndarray:
    """Weight of the codon, length, binding motifs before it, and distance from the contigs' share of G and C."""
    length = stop - at + 3
    share = (gc[stop + 3] - gc[at]) / length
    given = list(model.binding.values())
    sums = np.array([float(sum(w * 20 for k, w in enumerate(given) if i >> k & 1)) for i in range(1 << len(given))])
    seen = sum((strand.upstream(m, at).astype(np.int64) << k for k, m in enumerate(model.binding)), np.zeros(len(at), dtype=np.int64))
    return strand.weights(at, START_WEIGHTS) * 10 + np.minimum(length / 1000, 1.0) * 5 + sums[seen] - np.abs(share - model.gc) * 5


def _metagenome_scores(gc_all: float, strand: Strand, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of a fragment by the range of its own share of G and C."""
    middle = next((m for low, high, m in ((0.2, 0.35, 0.275), (0.35, 0.5, 0.425), (0.5, 0.65, 0.575), (0.65, 0.8, 0.725)) if low <= gc_all < high), 0.425)
    weight = strand.weights(at, {"ATG": 1.0, "GTG": 0.9 - middle * 0.2, "TTG": 0.7 - middle * 0.3})
    return weight * np.where(strand.upstream("AGGAGG" if middle < 0.5 else "GGAGG", at), 2, 1) * (1 + (stop - at + 3) / 1000)


def without_overlaps(genes: list[tuple], most: int = OVERLAP) -> list[tuple]:
    """Of genes (start, end, strand, score, ...) by start and falling score: one that overlaps the last kept by more than `most` bases replaces it if it scores more, else goes."""
    kept: list[tuple] = []
    for g in sorted(genes, key=lambda g: (g[0], -g[3], g[1], g[2])):
        if kept and max(0, min(kept[-1][1], g[1]) - max(kept[-1][0], g[0])) > most:
            if g[3] > kept[-1][3]:
                kept[-1] = g
        else:
            kept.append(g)
    return kept


def scan(seq: str, model: Model | None, least: int = LEAST) -> list[tuple]:
    """(start from 1, end, strand, score, coding) of the best start of each stop on both strands, without overlaps; without a model by the rules for fragments."""
    found, strands = [], {"+": Strand(seq), "-": Strand(seq.translate(_REVERSE)[::-1])}
    for name, strand in strands.items():
        gc = _running_gc(strand.codes)
        at, stop = strand.frames(least)
        score = start_scores(model, strand, at, stop, gc) if model else _metagenome_scores(gc[-1] / max(1, len(seq)), strand, at, stop)
        order = np.lexsort((at, -score, stop))  # the best of each stop, the first of equals
        best = order[np.unique(stop[order], return_index=True)[1]]
        best = best[score[best] > 0]
        for a, b, own in zip(at[best].tolist(), (stop[best] + 3).tolist(), score[best].tolist()):
            found.append((a + 1, b, name, own) if name == "+" else (len(seq) - b + 1, len(seq) - a, name, own))
    if not model:
        return [(*g, None) for g in sorted(found, key=lambda g: (g[0], g[1], g[2]))]
    kept = without_overlaps(found)
    return [(*g, model.coding(strands[g[2]], *((g[0] - 1, g[1]) if g[2] == "+" else (len(seq) - g[1], len(seq) - g[0] + 1)))) for g in kept]


def predict(contigs: DataFrame, key: str, seq: str = "seq", least: int = LEAST, model: Model | None = None, fragments: bool = False) -> DataFrame:
    """(key, start, end, strand, score, coding): genes of every contig, from 1, by a model learnt from all of them unless one is given.

    Of each stop the start that scores most above 0 (the first of equals); then genes that overlap the one before by more than `OVERLAP` bases
    leave it to the higher score. coding is the mean log odds of the gene's bases. With `fragments` (metagenomes) each contig is judged by its own
    share of G and C and all genes stay, without coding. Null and empty contigs have none; lower case is upper case; equal contigs have their own rows.
    """
    known = None if fragments else model or learn(contigs, seq)
    kind = contigs.schema[key].dataType.simpleString()

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names, a, b, strand, score, coding = zip(*rows)
        return pd.DataFrame({key: names, "start": a, "end": b, "strand": strand, "score": score, "coding": pd.Series(coding, dtype="float64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for name, s in zip(batch["key"], batch["seq"]):
                rows += [(name, *g) for g in scan((s or "").upper(), known, least)]
                if len(rows) >= 20_000:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return contigs.select(F.col(key).alias("key"), F.col(seq).alias("seq")).mapInPandas(run, f"`{key}` {kind}, start long, end long, strand string, score double, coding double")


def coding_genes(genes: DataFrame, share: float = 0.5) -> DataFrame:
    """The genes whose coding score is at least the `share` quantile of all of them (interpolated)."""
    at = genes.agg(F.percentile("coding", share)).first()[0]
    return genes.where(F.col("coding") >= at) if at is not None else genes.where("false")
