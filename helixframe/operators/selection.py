"""Selection of features by refits: stability over bootstrap replicates and recursive elimination, from sums alone.

A replicate gives each sample a Poisson weight from a hash of both, so any task knows it without a draw. One pass sums the weighted products
of features and target for all replicates; what is fitted then are matrices of features by features, replicates side by side. Products
are added up task by task and then by parts of tasks, a row of sums at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds; parts in which the tasks' sums are added up first; ridge of a linear fit on standardised features.
HELD, PARTS, RIDGE = 1 << 26, 32, 1e-3
#: Where the penalties of a lasso path lie, as shares of the least one that leaves nothing.
PATH = (0.8, 0.6, 0.4, 0.3, 0.2, 0.1)
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def poisson_weight(sample: Column, replicate: Column) -> Column:
    """How often a sample is drawn in a replicate: a Poisson number of mean 1 from the hash of both."""
    u = F.pmod(F.xxhash64(sample, replicate), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F
    for k, limit in enumerate(_POISSON):
        weight = weight.when(u < limit, k)
    return weight.otherwise(len(_POISSON))


def with_weights(rows: DataFrame, replicates: int) -> DataFrame:
    """Adds weights, one a replicate."""
    return rows.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: poisson_weight(F.col("sample"), b).cast("double")))


def _added(sums: DataFrame, *keys: str) -> DataFrame:
    """Adds the vectors of equal keys, which are streamed in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for batch in batches:
            done = []
            for *key, values in batch.itertuples(index=False):
                v = np.frombuffer(values)
                if key != now:
                    if total is not None:
                        done.append((*now, total.tobytes()))
                    now, total = key, v.copy()
                else:
                    total += v
            yield pd.DataFrame(done, columns=[*keys, "values"])
        if total is not None:
            yield pd.DataFrame([(*now, total.tobytes())], columns=[*keys, "values"])

    return sums.select(*keys, "values").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, ", ".join(f"{k} int" for k in keys) + ", values binary")


def weighted_products(rows: DataFrame, width: int, replicates: int) -> DataFrame:
    """(replicate, values): the sums of weight times z z' with z = (1, features, target), as doubles row by row, from rows (features, target, weights).

    `width` is the number of features; rows with null, missing or not finite values take no part.
    """
    size = width + 2
    groups = max(1, -(-replicates * size * size * 8 // HELD))
    share = -(-replicates // groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, own in batch.groupby("group"):
                fine = [f is not None and len(f) == width and w is not None for f, w in zip(own["features"], own["weights"])]
                own = own[fine]
                if not len(own):
                    continue
                z = np.hstack([np.ones((len(own), 1)), np.array(own["features"].tolist(), dtype=np.float64), own["target"].to_numpy(np.float64)[:, None]])
                w = np.array(own["weights"].tolist(), dtype=np.float64)[:, group * share : (group + 1) * share]
                known = np.isfinite(z).all(axis=1)
                z, w = z[known], w[known]
                sums = held.setdefault(group, np.zeros((w.shape[1], size, size)))
                for b in range(w.shape[1]):
                    sums[b] += z.T @ (z * w[:, b : b + 1])
        for group, sums in held.items():
            yield pd.DataFrame({"replicate": np.arange(len(sums)) + group * share, "values": [s.tobytes() for s in sums]})

    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "features", F.col("target").cast("double").alias("target"), "weights")
    parts = dealt.mapInPandas(run, "replicate int, values binary").withColumn("part", (F.spark_partition_id() % PARTS).cast("int"))
    return _added(_added(parts, "replicate", "part"), "replicate")


def standardised(values: bytes, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Correlations of the features, their covariances with the target in units of their deviations, and the sum of weights. Features that do not vary have zeros."""
    m = np.frombuffer(values).reshape(width + 2, width + 2)
    n = m[0, 0]
    if n <= 0:
        return np.zeros((width, width)), np.zeros(width), 0.0
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    scale = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean[1:-1])), 1 / np.where(sd > 0, sd, 1), 0.0)
    return cov[1:-1, 1:-1] * np.outer(scale, scale), cov[1:-1, -1] * scale, float(n)


def lasso(c: np.ndarray, r: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 2000) -> np.ndarray:
    """Coefficients of least b'Cb/2 - b'r + penalty |b|, by coordinates in turn."""
    b = np.zeros(len(r)) if start is None else start.copy()
    rest = r - c @ b
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(np.diag(c) > 0):
            old = b[j]
            x = rest[j] + c[j, j] * old
            b[j] = math.copysign(max(0.0, abs(x) - penalty), x) / c[j, j]
            if b[j] != old:
                rest -= c[:, j] * (b[j] - old)
                most = max(most, abs(b[j] - old))
        if most < 1e-9:
            break
    return b


def _chosen(values: bytes, width: int, how: str) -> np.ndarray:
    """Which features a replicate takes, a row for each penalty of the path (one row for `top`)."""
    c, r, n = standardised(values, width)
    if how == "lasso":
        most, out, b = float(np.abs(r).max(initial=0.0)), [], None
        for share in PATH:
            b = lasso(c, r, share * most, b)
            out.append((np.abs(b) > 1e-6) & (most > 0))
        return np.array(out)
    b = np.abs(np.linalg.solve(c + RIDGE * np.eye(width), r))
    top = np.argsort(-b, kind="stable")[: max(1, width // 4)]
    return (np.isin(np.arange(width), top) & (n > 0))[None, :]


def stability(rows: DataFrame, width: int, replicates: int = 100, threshold: float = 0.6, how: str = "lasso") -> DataFrame:
    """(feature, frequency, penalty, selected) from rows (sample, features, target): in which share of the replicates a feature is taken, at the penalty (share of the largest) where that is most.

    `how`: lasso (along the path), or top (the quarter of the features with the largest standardised ridge coefficients). Equal shares
    keep the larger penalty. Without samples every frequency is 0.
    """
    sums = weighted_products(with_weights(rows, replicates), width, replicates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in batch["values"]:
                step, feature = np.nonzero(_chosen(values, width, how))
                yield pd.DataFrame({"step": step, "feature": feature})

    taken = sums.mapInPandas(run, "step int, feature long").groupBy("feature", "step").agg(F.count("*").alias("n"))
    best = taken.groupBy("feature").agg(F.max(F.struct("n", (-F.col("step")).alias("s"))).alias("b")).select(F.col("feature").alias("f"), F.col("b.n").alias("n"), (-F.col("b.s")).alias("step"))
    every = rows.sparkSession.range(width).select(F.col("id").alias("feature")).join(best, F.col("feature") == F.col("f"), "left")
    frequency = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(replicates))
    penalty = F.element_at(F.array(*map(F.lit, PATH)), F.col("step") + 1) if how == "lasso" else F.lit(None).cast("double")
    return every.select("feature", frequency.alias("frequency"), penalty.alias("penalty"), (frequency >= threshold).alias("selected"))


def eliminated(c: np.ndarray, r: np.ndarray, keep: int, step: float = 0.1) -> list[int]:
    """Rank of each feature: 1 for those that stay to the end, the later one goes the smaller; each round refits and drops `step` of all features with the smallest coefficients, at least one."""
    width = len(r)
    rank, left, drop = [1] * width, list(range(width)), max(1, int(step * width))
    dropped: list[list[int]] = []
    while len(left) > keep:
        b = np.abs(np.linalg.solve(c[np.ix_(left, left)] + RIDGE * np.eye(len(left)), r[left]))
        out = [left[k] for k in np.argsort(b, kind="stable")[: min(drop, len(left) - keep)]]
        dropped.append(out)
        left = [f for f in left if f not in out]
    for k, out in enumerate(reversed(dropped)):
        for f in out:
            rank[f] = k + 2
    return rank


def recursive_elimination(rows: DataFrame, width: int, keep: int | None = None, step: float = 0.1) -> DataFrame:
    """(feature, rank, score, selected) of rows (sample, features, target): see `eliminated`; half of the features stay unless `keep` says else. One pass over the samples, fits on a matrix of the features alone."""
    one = rows.withColumn("weights", F.array(F.lit(1.0)))
    got = weighted_products(one, width, 1).collect()  # one row of the features' products
    c, r, _ = standardised(got[0]["values"], width) if got else (np.zeros((width, width)), np.zeros(width), 0.0)
    ranks = eliminated(c, r, max(1, width // 2) if keep is None else keep, step)
    return rows.sparkSession.createDataFrame([(k, rank, 1.0 / rank, rank == 1) for k, rank in enumerate(ranks)], "feature long, rank int, score double, selected boolean")
