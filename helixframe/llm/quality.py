"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are computed in one pass and stored. A Gaussian kernel over the standardised statistics is
approximated by `D` random cosines (fixed seed); each task sums its share of the normal equations, the shares are added up
row by row of the matrix by Spark, and the driver solves one (D+1)-sized system. Raw scores of the learning rows are then
counted in `BINS` bins and made monotone by pooling adjacent violators. Sizes on the driver depend on D and BINS alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import slices, stored
from helixframe.llm.line_rules import repeated_words, words_of

D, GAMMA, RIDGE, BINS, SEED = 256, 0.03, 1.0, 1000, 20240229
#: Labelled rows that the filter learns from (`classify` learns from all, whose statistics it needs anyway).
LEARN_ROWS = 20_000

_UPPER, _DIGIT, _PUNCT, _SYMBOL = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[0-9]"), re.compile("[.,;:'\"()-]"), re.compile(r"[#*$%&|<>{}\[\]\\^~=_+@/]")
_SHOUT, _ENDS = re.compile("[!?]"), re.compile("[.!?…]")
NAMES = (
    "log_words", "word_length", "word_length_sd", "upper", "digits", "punctuation", "symbols", "shouts", "log_lines", "line_words", "lines_ended", "repeated_lines",
    "repeated_words", "distinct", "entropy", "top_word", "short_words", "long_words", "capital_words", "upper_words", "symbol_words", "sentence_words",
)


def statistics(text: str) -> list[float]:
    """The document statistics in the order of NAMES; all finite, zeros for a text without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars, counts = max(1, len(text)), Counter(words)
    lengths = np.array([len(w) for w in words], dtype=np.float64)
    lines = [x for x in text.split("\n") if x.strip()]
    share = np.array(list(counts.values()), dtype=np.float64) / n
    symbols = len(_SYMBOL.findall(text))
    return [
        math.log1p(n), min(30.0, lengths.mean()), min(30.0, lengths.std()), len(_UPPER.findall(text)) / chars, len(_DIGIT.findall(text)) / chars, len(_PUNCT.findall(text)) / chars, symbols / chars, len(_SHOUT.findall(text)) / chars,
        math.log1p(len(lines)), min(8.0, math.log1p(n / max(1, len(lines)))), sum(x.rstrip()[-1] in ".!?…" for x in lines) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        repeated_words(words) / n, len(counts) / n, float(-(share * np.log(share)).sum()) / max(1.0, math.log(n)), share.max(), (lengths <= 3).mean(), (lengths >= 12).mean(),
        sum(c for w, c in counts.items() if w[0].isupper()) / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, symbols / n, min(100.0, n / max(1, len(_ENDS.findall(text)))) / 100,
    ]


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and its statistics (array of float), a row per row of `docs`; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [statistics(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<float>")


def held_out(key) -> F.Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; such rows are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Standardisation, random cosines, ridge weights and the calibration's steps; small and of fixed size."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-6, sd, 1.0)
        self.omega = rng.normal(0.0, math.sqrt(2 * GAMMA), (len(mean), D))
        self.phase = rng.uniform(0, 2 * math.pi, D)
        self.weights = np.zeros(D + 1)
        self.low, self.high = 0.0, 1.0
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        return np.hstack([math.sqrt(2 / D) * np.cos(z @ self.omega + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def bin(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw - self.low) / (self.high - self.low) * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0.0, 1.0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), len(NAMES))


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest rising sequence in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def learn(rows: DataFrame) -> Model:
    """Fits on all rows of (stats, quality in 0..1). Without rows every score is 0.5."""
    width = len(NAMES)
    sums = rows.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()  # one row a statistic
    if not sums:
        model = Model(np.zeros(width), np.ones(width))
        model.steps = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))
        return model
    mean, sd = (np.array([x[k] for x in sorted(sums)], dtype=np.float64) for k in (1, 2))
    model = Model(mean, sd)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((D + 1, D + 2))
        for batch in batches:
            if len(batch):
                z = model.cosines(_matrix(batch["stats"]))
                total += z.T @ np.hstack([z, batch["quality"].to_numpy(np.float64)[:, None]])
        if total.any():
            yield pd.DataFrame({"i": np.arange(D + 1), "values": [r.tobytes() for r in total]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "values": [sum(np.frombuffer(v) for v in group["values"]).tobytes()]})

    # a task's share is D+1 rows; they are first added up in 16 groups a row, then these
    parts = rows.mapInPandas(shares, "i int, values binary").withColumn("part", F.spark_partition_id() % 16)
    parts = parts.groupBy("i", "part").applyInPandas(added, "i int, values binary")
    summed = {r["i"]: np.frombuffer(r["values"]) for r in parts.groupBy("i").applyInPandas(added, "i int, values binary").collect()}
    equations = np.array([summed[i] for i in range(D + 1)])
    penalty = RIDGE * np.eye(D + 1)
    penalty[D, D] = 1e-6
    model.weights = np.linalg.solve(equations[:, : D + 1] + penalty, equations[:, D + 1])

    model.low, model.high = -0.5, 1.5

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = model.raw(_matrix(batch["stats"]))
                yield pd.DataFrame({"bin": model.bin(raw), "raw": raw, "quality": batch["quality"].astype("float64")})

    counts = rows.mapInPandas(binned, "bin long, raw double, quality double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("quality").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()  # at most BINS rows
    x, y, n = (counts[c].to_numpy(np.float64) for c in ("x", "y", "n"))
    model.steps = (x, pooled(y, n))
    return model


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `document_statistics`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = model.score(_matrix(batch["stats"]))
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"].astype(bool), "score": score, "predicted": (score >= 0.5).astype("int32")})

    return stats.withColumn("held_out", held_out(F.col("doc_id"))).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def known_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, quality) of the ids that are not held out; several labels of a document count as their mean, null ones not at all."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("quality")).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality IS NOT NULL")


def learning_rows(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics and label of labelled documents that are not held out."""
    return stats.join(known_labels(labels, label), "doc_id").select("stats", "quality")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores every row of `docs`: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows whose id is not held out. Null and empty texts have zero statistics and the score these get;
    repeated rows get equal scores; a null id is scored, not learnt from. Other columns are ignored.
    """
    stats = stored(document_statistics(docs, text, key), "statistics")
    return scores(stats, learn(learning_rows(stats, labels)))


def keep_predicted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", learn_rows: int = LEARN_ROWS) -> DataFrame:
    """The rows of `docs` that are predicted 1, all columns unchanged: the model goes to the texts, no join of texts.

    Learns from about `learn_rows` labelled rows at most (those of the smallest hashes of ids), so that statistics are computed
    once a text and not twice. Null and empty texts are judged by zero statistics, repeated rows alike, null ids like any; without
    labels every row scores 0.5 and stays; an empty table stays empty. Names of other columns do not matter.
    """
    known = known_labels(labels)
    n = known.count()
    if n > learn_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * learn_rows / n))
    known = F.broadcast(known)  # of learn_rows rows or so
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(known, "doc_id", "left_semi")
    model = learn(stored(document_statistics(texts).join(known, "doc_id").select("stats", "quality"), "statistics"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in slices(batch, place):
                texts = part.column(place).to_pylist()
                stats = np.array([statistics(t or "") for t in texts], dtype=np.float32).astype(np.float64).reshape(len(texts), len(NAMES))
                yield part.filter(pa.array(model.score(stats) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
