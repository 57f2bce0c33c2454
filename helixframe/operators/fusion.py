"""Similarity network fusion of large cohorts, on blocks of matrices.

The matrices of a cohort (distances, networks, kernels) are tables of square blocks (cohort, layer, r, c, data), and fusion is products and sums of
blocks that Spark joins and adds up. A task holds a few blocks, whatever the cohort; no link is left out. The result is that of
`integration.snf` on whole matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import settled

#: Samples of a block, and rows of blocks that a task takes at a time.
BLOCK, BATCH = 512, 8
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_KEY = "cohort string, layer string, r int, c int"


def _written(df: DataFrame) -> DataFrame:
    """`settled`, with few blocks in a batch."""
    spark = df.sparkSession
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(BATCH))
    try:
        return settled(df)
    finally:
        spark.conf.set(_ROWS, before)


def _mapped(df: DataFrame, function: Callable[[tuple], dict], schema: str) -> DataFrame:
    """A row for each row, by a function of named values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [function(x) for x in batch.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows)

    return df.mapInPandas(run, schema)


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, columns)


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    """Adds the data of equal keys, streamed in order."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for batch in batches:
            done = []
            for *key, data in batch.itertuples(index=False):
                if key != now:
                    if now is not None:
                        done.append((*now, total.tobytes()))
                    now, total = key, np.frombuffer(data).copy()
                else:
                    total += np.frombuffer(data)
            yield pd.DataFrame(done, columns=[*keys, "data"])
        if now is not None:
            yield pd.DataFrame([(*now, total.tobytes())], columns=[*keys, "data"])

    return df.select(*keys, "data").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", data binary")


def _normalised(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks over the sums of their rows."""
    sums = _mapped(blocks.join(sizes, ["cohort", "c"]), lambda x: {"cohort": x.cohort, "layer": x.layer, "r": x.r, "data": _matrix(x.data, x.size).sum(axis=1).tobytes()}, "cohort string, layer string, r int, data binary")
    whole = _summed(sums, "cohort", "layer", "r").withColumnRenamed("data", "total")
    return _written(_mapped(blocks.join(whole, ["cohort", "layer", "r"]), lambda x: {"cohort": x.cohort, "layer": x.layer, "r": x.r, "c": x.c, "data": (np.frombuffer(x.data).reshape(len(x.total) // 8, -1) / np.maximum(np.frombuffer(x.total), 1e-300)[:, None]).tobytes()}, _KEY + ", data binary"))


def _distances(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Blocks of euclidean distances from (cohort, layer, sample, feature, value) and (cohort, sample, r, at); missing values are 0."""
    places = Window.partitionBy("cohort", "layer").orderBy("feature")
    features = rows.select("cohort", "layer", "feature").distinct().withColumn("f", F.row_number().over(places) - 1)
    width = features.groupBy("cohort", "layer").agg(F.count("*").cast("int").alias("width"))
    cells = rows.join(features, ["cohort", "layer", "feature"]).join(order, ["cohort", "sample"]).groupBy("cohort", "layer", "r", "at").agg(F.collect_list(F.struct("f", F.col("value").cast("double").alias("v"))).alias("cells"))
    held = order.groupBy("cohort", "r").agg(F.count("*").cast("int").alias("size"))
    chunk = held.join(width, "cohort").join(cells.groupBy("cohort", "layer", "r").agg(F.collect_list(F.struct("at", "cells")).alias("x")), ["cohort", "layer", "r"], "left")

    def dense(x) -> dict:
        out = np.zeros((x.size, x.width))
        for row in x.x if x.x is not None else ():
            for cell in row["cells"]:
                out[row["at"], cell["f"]] = cell["v"] or 0.0
        return {"cohort": x.cohort, "layer": x.layer, "r": x.r, "width": x.width, "data": out.tobytes()}

    dense_rows = _written(_mapped(chunk, dense, "cohort string, layer string, r int, width int, data binary"))

    def far(x) -> dict:
        a, b = _matrix(x.data, x.width), _matrix(x.other, x.width)
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
        if x.r == x.c:
            np.fill_diagonal(d, 0)
        return {"cohort": x.cohort, "layer": x.layer, "r": x.r, "c": x.c, "total": float(d.sum()), "data": d.tobytes()}

    pairs = dense_rows.join(dense_rows.select("cohort", "layer", F.col("r").alias("c"), F.col("data").alias("other")), ["cohort", "layer"])
    return _written(_mapped(pairs, far, _KEY + ", total double, data binary"))


def _kernels(networks: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(cohort, layer, r, c, data): blocks of each sample's k strongest partners, over their sum; only blocks that hold any."""

    def near(x) -> dict:
        w = _matrix(x.data, x.size)
        if x.r == x.c:
            w = w.copy()
            np.fill_diagonal(w, -1.0)
        at = np.argsort(-w, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(w, at, axis=1)
        return {"cohort": x.cohort, "layer": x.layer, "r": x.r, "c": x.c, "width": at.shape[1], "at": at.astype(np.float64).tobytes(), "data": value.tobytes()}

    best = _mapped(networks.join(sizes, ["cohort", "c"]), near, _KEY + ", width int, at binary, data binary")

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c")
        value = np.hstack([_matrix(d, n) for d, n in zip(frame["data"], frame["width"])])
        at = np.hstack([_matrix(d, n).astype(np.int64) for d, n in zip(frame["at"], frame["width"])])
        block = np.concatenate([np.full(n, c) for c, n in zip(frame["c"], frame["width"])])
        chosen = np.argsort(-value, axis=1, kind="stable")[:, :k]  # columns stand by block and place, so ties go to the smaller
        strong = np.maximum(np.take_along_axis(value, chosen, axis=1), 0.0)
        strong = strong / np.maximum(strong.sum(axis=1, keepdims=True), 1e-300)
        where, column = block[chosen], np.take_along_axis(at, chosen, axis=1)
        out = []
        for c in np.unique(where):
            rows, cols = np.nonzero(where == c)
            s = np.zeros((len(value), int(frame["size"].iloc[list(frame["c"]).index(c)])))
            s[rows, column[rows, cols]] = strong[rows, cols]
            out.append((frame["cohort"].iloc[0], frame["layer"].iloc[0], int(frame["r"].iloc[0]), int(c), s.tobytes()))
        return pd.DataFrame(out, columns=["cohort", "layer", "r", "c", "data"])

    return _written(best.join(sizes, ["cohort", "c"]).groupBy("cohort", "layer", "r").applyInPandas(merged, _KEY + ", data binary"))


def _product(a: DataFrame, b: DataFrame, sizes: DataFrame, flip: bool) -> DataFrame:
    """a b, or a b' with `flip`: blocks meet by the middle index and are added up."""
    inner = sizes.select("cohort", F.col("c").alias("m"), F.col("size").alias("inner"))
    left = a.select("cohort", "layer", "r", F.col("c").alias("m"), "data")
    right = b.select("cohort", "layer", F.col("c" if flip else "r").alias("m"), F.col("r" if flip else "c").alias("c"), F.col("data").alias("other"))

    def times(x) -> dict:
        one, two = _matrix(x.data, x.inner), np.frombuffer(x.other)
        two = two.reshape(-1, x.inner).T if flip else two.reshape(x.inner, -1)
        return {"cohort": x.cohort, "layer": x.layer, "r": x.r, "c": x.c, "data": (one @ two).tobytes()}

    return _summed(_mapped(left.join(right, ["cohort", "layer", "m"]).join(inner, ["cohort", "m"]), times, _KEY + ", data binary"), "cohort", "layer", "r", "c")


def fused_network(rows: DataFrame, k: int = 20, rounds: int = 20) -> DataFrame:
    """(cohort, src, dst, weight), src < dst, of (cohort, block, sample, feature, value): every link of weight above 0 between the samples of a cohort."""
    kind = rows.schema["sample"].dataType.simpleString()
    rows = rows.select("cohort", F.col("block").cast("string").alias("layer"), "sample", "feature", "value")
    place = F.row_number().over(Window.partitionBy("cohort").orderBy("sample")) - 1
    order = settled(rows.select("cohort", "sample").distinct().withColumn("i", place).select("cohort", "sample", F.floor(F.col("i") / BLOCK).cast("int").alias("r"), (F.col("i") % BLOCK).cast("int").alias("at")))
    sizes = settled(order.groupBy("cohort", F.col("r").alias("c")).agg(F.count("*").cast("int").alias("size")))
    n = order.groupBy("cohort").agg(F.count("*").alias("n"))
    far = _distances(rows, order)
    width = far.groupBy("cohort", "layer").agg(F.sum("total").alias("total")).join(n, "cohort").select("cohort", "layer", (F.col("total") / (F.col("n") * (F.col("n") - 1))).alias("sigma"))

    def close(x) -> dict:
        w = np.exp(-(np.frombuffer(x.data).reshape(-1, x.size) ** 2) / (2 * (x.sigma or 0.0) ** 2 or 1.0))
        if x.r == x.c:
            np.fill_diagonal(w, 0)
        return {"cohort": x.cohort, "layer": x.layer, "r": x.r, "c": x.c, "data": w.tobytes()}

    networks = _written(_mapped(far.join(width, ["cohort", "layer"]).join(sizes, ["cohort", "c"]), close, _KEY + ", data binary"))
    kernels, full = _kernels(networks, sizes, k), _normalised(networks, sizes)
    layers = rows.select("cohort", "layer").distinct().groupBy("cohort").agg(F.count("*").alias("layers"))
    for _ in range(rounds):
        total = _summed(full, "cohort", "r", "c").withColumnRenamed("data", "total")

        def others(x) -> dict:
            return {"cohort": x.cohort, "layer": x.layer, "r": x.r, "c": x.c, "data": ((np.frombuffer(x.total) - np.frombuffer(x.data)) / max(1, x.layers - 1)).tobytes()}

        mean = _mapped(full.join(total, ["cohort", "r", "c"]).join(layers, "cohort"), others, _KEY + ", data binary")
        spread = _written(_product(kernels, mean, sizes, flip=False))
        full = _normalised(_written(_product(spread, kernels, sizes, flip=True)), sizes)
    mean = _summed(full, "cohort", "r", "c")
    names = order.groupBy("cohort", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sample"))), lambda x: x["sample"]).alias("names"))
    both = mean.join(mean.select("cohort", F.col("r").alias("c"), F.col("c").alias("r"), F.col("data").alias("other")), ["cohort", "r", "c"]).where("r <= c").join(layers, "cohort")
    both = both.join(names, ["cohort", "r"]).join(names.select("cohort", F.col("r").alias("c"), F.col("names").alias("others")), ["cohort", "c"])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                w = (_matrix(x.data, len(x.others)) + _matrix(x.other, len(x.names)).T) / (2 * x.layers)
                i, j = np.nonzero((np.triu(w, 1) if x.r == x.c else w) > 0)
                yield pd.DataFrame({"cohort": x.cohort, "src": np.asarray(x.names)[i], "dst": np.asarray(x.others)[j], "weight": w[i, j]})

    return _written(both.mapInPandas(links, f"cohort string, src {kind}, dst {kind}, weight double"))
