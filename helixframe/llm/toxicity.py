"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max inverted index, votes weighted by distance.

Vocabulary. Most words of a text say nothing about toxicity, and a cosine over all of them would find texts of one topic. Terms
are therefore chosen on the learning rows: those that stand in several toxic documents, in several contexts (different words
behind them, so that copies of one text count once), mostly in toxic documents, and too often for chance (a Chernoff bound
on the share of toxic documents, times the number of candidates). Texts are then vectors over the chosen terms.

Search. Examples are the learning rows with a chosen term. Postings of each term are cut at fixed blocks of examples and
carry the largest weight of each block; a query takes blocks by their bound, scores them exactly, and stops at the first
whose bound cannot reach its k-th neighbour. Nothing is approximate: the neighbours are those of brute force.

Votes weighted by distance are calibrated on the learning rows, each without its own example, by pooling adjacent violators.
Learning rows are bounded by `EXAMPLES`, terms by `TERMS`, so model and index have a bounded size whatever the corpus; document
frequencies, vectors and scores cover all documents and whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import as_bytes, slices, stored
from helixframe.llm.quality import pooled

#: Learning rows (those of the smallest hashes of ids) and terms at most; neighbours that vote; examples in a block of the index.
EXAMPLES, TERMS, NEIGHBOURS, BLOCK = 20_000, 4096, 16, 64
#: A term's toxic documents and contexts at least, its share of toxic documents (one clean one added), and expected chance finds.
SUPPORT, SHARE, CHANCE = 3, 0.5, 0.5
#: A neighbour's weight is one over its distance (1 - cosine) and `NEAR`; what a vote has against it from the start; steps of the calibration.
NEAR, DOUBT, STEPS = 0.02, 0.5, 100
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of everything above ASCII, A-Z lowered."""
    return text.translate(_WORDS).split()


def held_out(key) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, toxic of about `most` labelled ids that are not held out; of several labels the majority counts (a tie: toxic), null ones and null ids do not."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return known


def _learning_counts(texts: DataFrame) -> DataFrame:
    """term, behind, toxic, clean: documents of each kind with the term (behind null), and a row without documents for each term and word behind it in toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        behind: set[tuple[bytes, bytes]] = set()

        def flush() -> pa.RecordBatch:
            names = list(counts[1].keys() | counts[0].keys())
            pairs = list(behind)
            term, follows = [*names, *(a for a, _ in pairs)], [*[None] * len(names), *(b for _, b in pairs)]
            columns = [pa.array(term, pa.binary()).cast(pa.string()), pa.array(follows, pa.binary()).cast(pa.string()), *(pa.array([*(counts[k][x] for x in names), *[0] * len(pairs)], pa.int64()) for k in (1, 0))]
            for x in (*counts, behind):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "behind", "toxic", "clean"])

        for batch in batches:
            for part in slices(batch, 0):
                for text, toxic in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    found = words(text)
                    counts[toxic].update(set(found))
                    if toxic:
                        behind.update(zip(found, [*found[1:], b""]))
                if len(behind) + len(counts[0]) > 400_000:
                    yield flush()
        yield flush()

    return texts.select("text", "toxic").mapInArrow(run, "term string, behind string, toxic long, clean long")


def choose_terms(texts: DataFrame, most: int = TERMS) -> list[bytes]:
    """The terms of the vocabulary, the surest first, from learning texts (text, toxic): at most `most`."""
    one = _learning_counts(texts).groupBy("term", "behind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    per_term = one.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("behind").alias("contexts")).where((F.col("toxic") >= SUPPORT) & (F.col("contexts") >= SUPPORT))
    per_term = stored(per_term.select("term", F.least("toxic", "contexts").alias("toxic"), "clean"), "toxicity-terms")
    candidates, (n, bad) = per_term.count(), texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not candidates or bad == n:
        return []
    base = F.lit(bad / n)
    both = F.col("toxic") + F.col("clean")
    rate = F.col("toxic") / both
    # the bound on a chance at least this large, log: -n (r log(r / base) + (1 - r) log((1 - r) / (1 - base)))
    surprise = both * (rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    sure = per_term.withColumn("surprise", surprise).where((F.col("toxic") / (both + 1) >= SHARE) & (rate > base) & (F.col("surprise") >= math.log(candidates / CHANCE)))
    return [bytes(r.term) for r in sure.select(F.col("term").cast("binary").alias("term")).orderBy(F.desc("surprise"), "term").limit(most).collect()]


def vectors(docs: DataFrame, vocabulary: list[bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, terms (places in the vocabulary, rising), counts; a row per row of `docs`, without terms where it has none."""
    place = {t: k for k, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [sorted(Counter(place[w] for w in words(t) if w in place).items()) for t in as_bytes(part.column(1))]
                columns = [part.column(0), *(pa.array([[x[k] for x in row] for row in found], pa.list_(pa.int32())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "terms", "counts"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


class Index:
    """A block-max inverted index over unit TF-IDF vectors of labelled examples."""

    def __init__(self, examples: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], idf: np.ndarray, block: int = BLOCK):
        """examples: id, terms, counts, toxic. Blocks are of examples in the order of their terms, so that alike ones share them."""
        self.idf, self.block = idf, block
        own = [(i, t, self.weights(t, c), y) for i, t, c, y in sorted(examples, key=lambda e: (e[1], e[0]))]
        self.ids, self.toxic = np.array([e[0] for e in own], dtype=np.int64), np.array([e[3] for e in own], dtype=np.float64)
        term = np.array([t for e in own for t in e[1]], dtype=np.int64)
        at = np.array([k for k, e in enumerate(own) for _ in e[1]], dtype=np.int64)
        weight = np.array([w for e in own for w in e[2]], dtype=np.float64)
        order = np.lexsort((at, term))
        self.at, self.weight = at[order], weight[order]
        self.blocks = -(-len(own) // block)
        cell, start = np.unique(term[order] * max(1, self.blocks) + self.at // block, return_index=True)
        #: For each (term, block) that has postings: where they start and end and their largest weight.
        self.cells = {int(c): (int(a), int(b)) for c, a, b in zip(cell, start, [*start[1:], len(order)])}
        self.bounds = np.zeros((len(idf), self.blocks))
        if len(cell):
            self.bounds[cell // self.blocks, cell % self.blocks] = np.maximum.reduceat(self.weight, start)

    def weights(self, terms: tuple[int, ...], counts: tuple[int, ...]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, dtype=np.float64))) * self.idf[list(terms)]
        return w / math.sqrt(float(w @ w)) if len(w) else w

    def nearest(self, terms: tuple[int, ...], counts: tuple[int, ...], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """The k examples of the largest cosines above 0: (cosine, place), largest first, ties to smaller ids. `without`: an id that takes no part."""
        if not terms or not self.blocks:
            return []
        own = self.weights(terms, counts)
        bounds = own @ self.bounds[list(terms)]
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == k and bounds[b] < -best[-1][0] - 1e-9:
                break
            low = b * self.block
            scores = np.zeros(min(self.block, len(self.ids) - low))
            for t, w in zip(terms, own):
                if cell := self.cells.get(t * self.blocks + b):
                    scores[self.at[cell[0] : cell[1]] - low] += w * self.weight[cell[0] : cell[1]]
            found = np.flatnonzero(scores > 0)
            # rounded, so that equal vectors tie whatever the order of their sums
            best = sorted(best + [(-round(float(scores[i]), 12), int(self.ids[low + i]), low + int(i)) for i in found if self.ids[low + i] != without])[:k]
        return [(-s, at) for s, _, at in best]

    def vote(self, neighbours: list[tuple[float, int]]) -> float:
        """The toxic share of the neighbours' weights, with `DOUBT` on the other side; 0 without neighbours."""
        weights = [1 / (1 - s + NEAR) for s, _ in neighbours]
        return float(sum(w * self.toxic[at] for w, (_, at) in zip(weights, neighbours))) / (sum(weights) + DOUBT)


class Model:
    """Index and calibration; of bounded size."""

    def __init__(self, index: Index, steps: tuple[np.ndarray, np.ndarray], neighbours: int):
        self.index, self.steps, self.neighbours = index, steps, neighbours
        self.known: dict[tuple, tuple[float, list[tuple[int, float, int]]]] = {}

    def score(self, terms: tuple[int, ...], counts: tuple[int, ...]) -> tuple[float, list[tuple[int, float, int]]]:
        """Score and evidence: (id, similarity, toxic) of the neighbours. Equal vectors are looked up once while there is room."""
        if (terms, counts) not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            found = self.index.nearest(terms, counts, self.neighbours)
            score = float(np.clip(np.interp(self.index.vote(found), *self.steps), 0, 1))
            self.known[terms, counts] = score, [(int(self.index.ids[at]), s, int(self.index.toxic[at])) for s, at in found]
        return self.known[terms, counts]


def fit(examples: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], without_terms: tuple[int, int], idf: np.ndarray, k: int = NEIGHBOURS) -> Model:
    """examples: learning rows with a term; without_terms: how many learning rows have none, and how many of them are toxic.

    Rows without a term have vote 0. Without learning rows every score is 0.5.
    """
    index = Index(examples, idf)
    votes = [index.vote(index.nearest(t, c, k, without=i)) for i, t, c, _ in examples]
    n, bad = without_terms
    if not n + len(votes):
        return Model(index, (np.array([0.0, 1.0]), np.array([0.5, 0.5])), k)
    place = np.array([round(v * STEPS) for v in votes] + [0], dtype=np.int64)
    weight = np.bincount(place, [1.0] * len(votes) + [float(n)], STEPS + 1)
    toxic = np.bincount(place, [float(e[3]) for e in examples] + [float(bad)], STEPS + 1)
    used = np.flatnonzero(weight)
    return Model(index, (used / STEPS, pooled(toxic[used] / weight[used], weight[used])), k)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", most: int = EXAMPLES) -> DataFrame:
    """Scores every row of `docs`: doc_id, held_out, score (0 to 1), predicted, evidence (the nearest examples: doc_id, similarity, toxic).

    Learns from about `most` labelled rows that are not held out. Null and empty texts have no terms and the score of learning
    rows without one; repeated rows get equal scores; a null id is scored, not learnt from; an id with several texts is one
    example, the least vector. Without labels every row scores 0.5. Other columns are ignored.
    """
    known = F.broadcast(learning_labels(labels, label, most))  # of `most` rows or so
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    vocabulary = choose_terms(own.join(known, "doc_id").select("text", "toxic"))
    found = stored(vectors(own, vocabulary), "toxicity-vectors")
    n = found.count()
    df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term
    idf = np.array([math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in range(len(vocabulary))])
    learning = found.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("terms", "counts")).alias("v"), F.max("toxic").alias("toxic"))
    empty = F.size("v.terms") == 0
    bare = learning.where(empty).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = fit([(r.doc_id, tuple(r.v.terms), tuple(r.v.counts), r.toxic) for r in learning.where(~empty).collect()], tuple(bare), idf)  # of `most` rows or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            for part in slices(batch, rows=2048):
                rows = [model.score(tuple(t), tuple(c)) for t, c in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                score = np.array([s for s, _ in rows], dtype=np.float64)
                seen = pa.array([[dict(zip(("doc_id", "similarity", "toxic"), x)) for x in e] for _, e in rows], evidence)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), seen], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "terms", "counts").mapInArrow(run, schema)
