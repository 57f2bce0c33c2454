"""Networks as edge tables (src, dst): degrees, components, paths, PageRank, clustering, communities, neighbour graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Spark's setting that frees the shuffle files of a query once it is over, and those that bound the rows that are read and passed to Python at a time.
_FREED, _ROWS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


def settled(df: DataFrame, batch: int | None = None, **options: str) -> DataFrame:
    """Cuts the lineage of a loop's table: a table in the shared folder that the session names, so that lost executors do no harm; its shuffle files are freed.

    `batch`: rows that are read and passed to Python at a time, for large ones; options are the writer's.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("helixframe.graph.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-graph-")
        spark.conf.set("helixframe.graph.dir", base)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    settings = {_FREED: "true"} | (dict.fromkeys(_ROWS, str(batch)) if batch else {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table that `settled` wrote and nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once, without loops."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) of a directed graph; parallel edges count once."""
    one = edges.select("src", "dst").distinct()
    rows = one.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(one.select("dst", F.lit(0), F.lit(1)))
    return rows.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes (column node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def neighbours(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst").distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient) of the undirected graph. Every triangle is found once, from its node of the smallest degree, so hubs do not square."""
    links = both_ways(edges)
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    ranked = links.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = ranked.where((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("src") < F.col("dst")))).select("src", "dst")
    wedge = up.alias("a").join(up.alias("b"), F.col("a.src") == F.col("b.src")).where("a.dst < b.dst").select(F.col("a.src").alias("u"), F.col("a.dst").alias("v"), F.col("b.dst").alias("w"))
    closed = wedge.join(links.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"], "left_semi")
    triangles = closed.select(F.explode(F.array("u", "v", "w")).alias("src")).groupBy("src").agg(F.count("*").alias("t"))
    rows = degree.join(triangles, "src", "left").fillna(0, ["t"])
    return rows.select(F.col("src").alias("node"), F.col("d").alias("degree"), F.col("t").alias("triangles"), F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("coefficient"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node is weakly connected to; labels spread and jump until none changes."""
    links = settled(both_ways(edges))
    labels = settled(links.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        near = links.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = settled(labels.join(near.withColumnRenamed("src", "node"), "node").join(jump, "label", "left").select("node", F.least("label", "near", F.coalesce("beyond", "label")).alias("to"), "label"))
        done = not new.where("to <> label").limit(1).count()
        labels = new.select("node", F.col("to").alias("label"))
        if done:
            return labels.withColumnRenamed("label", "component")


def distances(edges: DataFrame, source, most: int | None = None) -> DataFrame:
    """(node, distance) of the nodes that `source` reaches along the edges, by breadth; with `most` only those within so many steps."""
    links = edges.select("src", "dst").distinct()
    seen = links.sparkSession.range(1).select(F.lit(source).cast(links.schema["src"].dataType).alias("node"), F.lit(0).alias("distance"))
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = settled(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = settled(seen.unionAll(front)) if depth % 10 == 0 else seen.unionAll(front)
    return seen


def simple_paths(edges: DataFrame, source, target, most: int = 10) -> DataFrame:
    """(path) of all simple paths of at most `most` nodes."""
    links = edges.select("src", "dst").distinct()
    kind = links.schema["src"].dataType
    open_ = links.sparkSession.range(1).select(F.array(F.lit(source).cast(kind)).alias("path"))
    found = open_.where(F.lit(source == target))
    for _ in range(most - 1):
        longer = open_.join(links, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        longer = settled(longer)
        found = found.unionAll(longer.where(F.element_at("path", -1) == F.lit(target).cast(kind)))
        open_ = longer.where(F.element_at("path", -1) != F.lit(target).cast(kind))
        if not open_.limit(1).count():
            break
    return found


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): starts at 1/n, the mass of nodes without out-edges is lost, ends when the ranks' total change is below the tolerance."""
    links = edges.select("src", "dst").distinct()
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    n = nodes.count()
    links = settled(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src"))
    ranks = settled(nodes.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        gifts = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("g")).withColumnRenamed("dst", "node")
        new = settled(ranks.join(gifts, "node", "left").select("node", ((1 - damping) / max(n, 1) + damping * F.coalesce("g", F.lit(0.0))).alias("new"), "rank"))
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] or 0.0
        ranks = new.select("node", F.col("new").alias("rank"))
        if change < tolerance:
            break
    return ranks


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness) over shortest directed paths, scaled by 2 / ((n - 1)(n - 2)). For graphs whose pairs fit a table: (source, node) rows."""
    links = settled(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    n = nodes.count()
    front = nodes.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    levels, seen, depth = [front], front.select("s", "node"), 0
    while True:
        depth += 1
        step = front.join(links, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = settled(step.join(seen, ["s", "node"], "left_anti").select("s", "node", F.lit(depth).alias("d"), "paths"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionAll(front.select("s", "node"))
    # dependencies flow back level by level
    total, below = None, None
    for level in reversed(levels[1:]):
        if below is None:
            scored = level.withColumn("delta", F.lit(0.0))
        else:
            part = level.join(links, F.col("node") == F.col("src")).join(below.select("s", F.col("node").alias("dst"), F.col("paths").alias("p"), F.col("delta").alias("q")), ["s", "dst"]).groupBy("s", "node").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("q"))).alias("delta"))
            scored = level.join(part, ["s", "node"], "left").fillna(0.0, ["delta"])
        below = settled(scored)
        total = below if total is None else total.unionAll(below)
    scale = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = total.groupBy("node").agg((F.sum("delta") * scale).alias("betweenness")) if total is not None else nodes.withColumn("betweenness", F.lit(0.0))
    return nodes.join(sums, "node", "left").fillna(0.0, ["betweenness"])


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the commonest label around it (ties: the smallest), its own counting once."""
    links = settled(both_ways(edges))
    labels = settled(links.select("src").distinct().select(F.col("src").alias("node"), F.col("src").alias("label")))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label").unionAll(labels).groupBy("node", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
        labels = settled(best.select("node", F.col("b.label").alias("label")))
    return labels.withColumnRenamed("label", "community")


def large_communities(communities: DataFrame, least: int = 3) -> DataFrame:
    return communities.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def regulators(edges: DataFrame, gene) -> DataFrame:
    """(src, effect) of signed edges (src, dst, weight) into a gene."""
    return edges.where(F.col("dst") == gene).select("src", F.when(F.col("weight") > 0, "activation").when(F.col("weight") < 0, "repression").otherwise("unknown").alias("effect"))


def stoichiometry(reactions: DataFrame) -> DataFrame:
    """(metabolite, reaction, coefficient): products less substrates of (reaction, metabolite, role, amount)."""
    return reactions.groupBy("metabolite", "reaction").agg(F.sum(F.when(F.col("role") == "product", F.col("amount")).otherwise(-F.col("amount"))).alias("coefficient"))


def _nearer(x: np.ndarray, y: np.ndarray, names: np.ndarray, far: np.ndarray, near: np.ndarray, rows: int = 256, most: int = 1 << 16) -> None:
    """Takes into `far` and `near` (distances and names of each x's nearest, the distances infinite at first) what is nearer among y; ties go to the smaller name.

    A product tells, but for a bound of its error, which y may be near enough; their distances are taken from the differences.
    """
    k, xx, yy = far.shape[1], (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 4 * (x.shape[1] + 8) * 2.0**-53 * (xx + yy.max())
    for a in range(0, len(x), rows):
        b = min(a + rows, len(x))
        rough = x[a:b] @ y.T
        rough -= yy / 2  # the larger, the nearer: the squared distance is xx - 2 rough
        bound = far[a:b, -1] ** 2
        least = (xx[a:b] - bound * (1 + 1e-12)) / 2
        if len(y) >= k and not np.isfinite(bound).all():
            least = np.maximum(least, np.partition(rough, len(y) - k, axis=1)[:, len(y) - k] - slack[a:b])
        found = np.flatnonzero(rough >= (least - slack[a:b])[:, None])
        for c in range(0, len(found), most):
            i, j = np.divmod(found[c : c + most], len(y))
            i += a
            who = np.unique(i)
            to, d, name = np.concatenate([np.repeat(who, k), i]), np.concatenate([far[who].ravel(), np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))]), np.concatenate([near[who].ravel(), names[j]])
            order = np.lexsort((name, d, to))
            first = order[(np.flatnonzero(np.diff(to[order], prepend=-1))[:, None] + np.arange(k)).ravel()]
            far[who], near[who] = d[first].reshape(-1, k), name[first].reshape(-1, k)


def sample_network(long: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """Symmetric k-nearest-neighbour graph (src, dst, distance) of samples in euclidean distance, ties to the smaller sample.

    Every sample is compared with all others. Equal vectors are compared once, by the smallest of their samples. Vectors are packed into blocks, and all blocks are
    streamed past each (a join that replicates partitions: nothing is shuffled), which keeps the k + 1 nearest so far: a task holds the blocks that it asks for.
    """
    vectors = settled(long.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"]).alias("v")))
    kind = vectors.schema["sample"].dataType.simpleString()
    classes = settled(vectors.groupBy("v").agg(F.min("sample").alias("name")))
    members = settled(vectors.join(classes, "v").select("sample", "name"))

    def named(values: list) -> np.ndarray:
        return np.array(values, dtype=None if kind in ("bigint", "int", "smallint", "tinyint") else object)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"names": [batch["name"].tolist()], "data": [np.array(batch["v"].tolist(), dtype=float).tobytes()]})

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                names, asked = named(list(row.names)), row.asked[0]
                y = np.frombuffer(row.data).reshape(len(names), -1)
                if asked not in held:
                    own = named(list(row.asked))
                    held[asked] = own, np.frombuffer(row.vectors).reshape(len(own), -1), np.full((len(own), k + 1), np.inf), np.full((len(own), k + 1), names[0])
                _nearer(held[asked][1], y, names, *held[asked][2:])
        for own, _, far, near in held.values():
            i, j = np.nonzero(np.isfinite(far))
            yield pd.DataFrame({"asking": own[i], "name": near[i, j], "distance": far[i, j]})

    blocks = settled(classes.repartition(max(1, -(-classes.count() // block))).mapInPandas(packed, f"names array<{kind}>, data binary"), batch=block)
    asked = blocks.select(F.col("names").alias("asked"), F.col("data").alias("vectors"))
    near = settled(blocks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(asked).mapInPandas(nearest, f"asking {kind}, name {kind}, distance double"), batch=8)
    dropped(blocks)
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("sample"))).where(F.col("r") <= k + 1).select("name", F.col("sample").alias("dst"))

    def least(rows: DataFrame, key: str, most: int) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("distance", "dst"))).where(F.col("r") <= most).drop("r")

    of_classes = least(near.join(first, "name").select("asking", "dst", "distance"), "asking", k + 1)
    pairs = of_classes.join(members.select(F.col("name").alias("asking"), F.col("sample").alias("src")), "asking").where("src <> dst").select("src", "dst", "distance")
    near_ = settled(least(pairs, "src", k))
    return near_.unionAll(near_.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()
