"""Near-duplicate detection by BagMinHash on multisets of five-word shingles.

Signature. Every shingle has a Poisson process for each dyadic interval of weights, [0,1), [1,2), [2,4) and so on, seeded by
the shingle and the interval; a text takes the points at weights below the shingle's count. Each point falls on one of the
`M` components, which keep their smallest point. Two texts agree in a component with a probability that is exactly their
weighted Jaccard similarity. Points are made in the order of their time and only up to a bound within which all components
are surely hit (it is raised for the texts where it was not).

Search. Texts with equal multisets are one node. Bands of `ROWS` components give the buckets. Pairs are not enumerated: in
each round every node meets the leader of its buckets, candidates are verified on whole texts, and links join their
components; buckets whose nodes are in one component are done. Nodes of the buckets that star rounds leave open are compared
exhaustively, in blocks: common shingles come from products of incidence matrices and only links that join components leave
a task, so no link between components is lost and no pairs are enumerated. Blocks carry shingle hashes, not texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from helixframe.llm import common
from helixframe.llm.common import as_bytes, drop_stored, slices
from helixframe.llm.shingles import batches, cells, mix, weighted_jaccard

M, ROWS, THRESHOLD = 160, 5, 0.8
BANDS = M // ROWS
#: Bits in which two signatures may differ (one bit a component): at similarity 0.8 a tenth of them does, and this is six deviations more.
MAX_BITS = math.ceil(M * 0.1 + 6 * math.sqrt(M * 0.09))
STAR_ROUNDS = 2
#: Nodes and different shingles of a block of the exhaustive comparison, and elements of the incidence matrix taken at a time.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 800, 1 << 19, 1024


def stored(df: DataFrame, label: str) -> DataFrame:
    """A stored table whose joins all merge: every side here grows with the corpus, and so plans are alike at every size."""
    return common.stored(df, label, merge=True)


def _step(k: int) -> np.uint64:
    """The k-th multiple of the golden ratio, modulo 2^64."""
    return np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def signatures(owner: np.ndarray, hashes: np.ndarray, count: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """The times of the smallest points, (texts, m); infinite for texts without shingles."""
    seeds, lows, highs, of = [], [], [], []
    level, low = 0, 0
    while True:  # one process for each interval of weights that a count reaches into
        reach = np.flatnonzero(count > low)
        if not len(reach):
            break
        seeds.append(mix(hashes[reach] + _step(level + 1)))
        lows.append(np.full(len(reach), low))
        highs.append(count[reach])
        of.append(owner[reach])
        level, low = level + 1, max(1, 2 * low)
    out = np.full(texts * m, np.inf)
    if not seeds:
        return out.reshape(texts, m)
    seed, low, high, of = (np.concatenate(x) for x in (seeds, lows, highs, of))
    rate = np.maximum(1, low).astype(np.float64)  # the interval [low, 2 low) is as long as low, the first one 1
    total = np.bincount(owner, weights=count, minlength=texts)
    bound = m * (math.log(m) + 5) / np.maximum(total, 1)
    todo = np.ones(texts, dtype=bool)
    while todo.any():
        live = np.flatnonzero(todo[of])
        s, r, t, time = seed[live], rate[live], of[live], np.zeros(len(live))
        k = 0
        while len(s):
            k += 1
            bits = mix(s + _step(2 * k))
            time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / r
            stay = np.flatnonzero(time <= bound[t])
            s, r, t, time, live = s[stay], r[stay], t[stay], time[stay], live[stay]
            bits = mix(s + _step(2 * k + 1))
            place = low[live] + ((bits & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 * r).astype(np.int64)
            hit = np.flatnonzero(place < high[live])
            register = ((bits[hit] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(out, t[hit] * m + register.astype(np.int64), time[hit])
        missing = np.isinf(out.reshape(texts, m)).any(axis=1) & (total > 0)
        bound[missing] *= 3
        todo = missing
    return out.reshape(texts, m)


_SIGNED = [StructField("uid", LongType()), StructField("digest", BinaryType()), *(StructField(f"s{k}", LongType()) for k in range(3)), StructField("bands", ArrayType(LongType()))]


def signed(docs: DataFrame, text: str) -> DataFrame:
    """(row, uid, digest, s0, s1, s2, bands): each row whole as `row`, its number, the multiset's 128-bit digest (null: no words), one-bit signature (3 longs), band hashes."""
    place = docs.columns.index(text)
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([*docs.schema.fields, *_SIGNED])

    def signature_columns(values: list[bytes]) -> list[pa.Array]:
        n = len(values)
        owner, hashes, count = cells(values)
        folded = mix(signatures(owner, hashes, count, n).view(np.uint64))
        some = np.flatnonzero(np.bincount(owner, minlength=n))
        first = np.searchsorted(owner, some)
        digest = np.zeros((n, 2), dtype=np.uint64)
        for k in range(2):
            if len(some):
                digest[some, k] = np.add.reduceat(mix(mix(hashes + _step(k + 7)) + count.astype(np.uint64)), first)
        bits = np.zeros((n, 192), dtype=np.uint8)
        bits[:, :M] = (folded & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
        band = np.zeros((n, BANDS), dtype=np.uint64)
        for k in range(ROWS):
            band = mix(band + folded[:, k::ROWS] + _step(k + 1))
        band = mix(band + np.array([_step(k) for k in range(BANDS)])).view(np.int64)
        has = np.isin(np.arange(n), some)
        digests = [digest[i].tobytes() if has[i] else None for i in range(n)]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))
        return [pa.array(digests, type=pa.binary()), *(pa.array(packed[:, k]) for k in range(3)), bands]

    def run(arrow_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in arrow_batches:
            # the text alone, beside the struct that carries it through, tells where to cut
            for part in slices(pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(place)], names=["row", "text"]), 1):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(uid, uid + n)), *signature_columns(as_bytes(part.column(1)))], names=schema.names)
                uid += n
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(value, node): the buckets that more than one node falls into. A node has one value a band, and values differ by band, so rows count nodes."""
    rows = nodes.select(F.explode("bands").alias("value"), "node")
    many = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return stored(rows.join(many.hint("merge"), "value"), "buckets")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts reach the threshold, with similarity. `texts`: node, text."""

    def run(arrow_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches:
            for part in slices(batch, 2, 3):
                one, other = as_bytes(part.column(2)), as_bytes(part.column(3))
                value = weighted_jaccard(len(one), *cells([x for pair in zip(one, other) for x in pair]))
                good = np.flatnonzero(value >= threshold)
                yield pa.RecordBatch.from_arrays([*part.select(["a", "b"]).take(pa.array(good)).columns, pa.array(value[good])], names=["a", "b", "similarity"])
        pa.default_memory_pool().release_unused()

    # texts grow with the corpus: never broadcast
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")).hint("merge"), "b")
    return joined.select("a", "b", "one", "other").mapInArrow(run, "a long, b long, similarity double")


def _elements(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A shingle counted c times is c elements, so that the common elements of two texts are the smaller counts."""
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(hashes, count) + level.astype(np.uint64) * _step(3))


def _hashed(texts: DataFrame) -> DataFrame:
    """(node, label, head, elements): the elements of each text's multiset, eight bytes each, sorted."""

    def run(arrow_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches:
            for part in slices(batch, 3):
                owner, hashes, count = cells(as_bytes(part.column(3)))
                edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
                own = [np.sort(_elements(hashes[a:b], count[a:b])).astype("<u8").tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, type=pa.binary())], names=["head", "node", "label", "elements"])

    return texts.select("head", "node", "label", "text").mapInArrow(run, "head long, node long, label long, elements binary")


def _block_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links that join different labels among the texts of one block or of two, as a forest. Common elements are counted by products of incidence matrices."""
    n = len(rows)
    total = np.fromiter((len(e) // 8 for e in rows["elements"]), dtype=np.float32, count=n)
    owner = np.repeat(np.arange(n, dtype=np.int32), total.astype(np.int64))
    _, element, often = np.unique(np.frombuffer(b"".join(rows["elements"]), "<u8"), return_inverse=True, return_counts=True)
    everywhere = int((often == n).sum())  # what all texts hold needs no product
    shared = (often[element] > 1) & (often[element] < n)
    owner, element = owner[shared], np.unique(element[shared], return_inverse=True)[1]
    both = np.full((n, n), everywhere, dtype=np.float32)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    edges = np.searchsorted(element, np.arange(0, (element[-1] + 1 if len(element) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = np.zeros((n, COLUMNS), dtype=np.float32)
            part[owner[a:b], element[a:b] - element[a] // COLUMNS * COLUMNS] = 1
            both += part @ part.T
    # both >= threshold * (total + total - both), with room for rounding; what passes is divided exactly below
    i, j = np.nonzero(np.triu(both * (1 + threshold) >= threshold * (total[:, None] + total[None, :]) - 0.01, 1))
    common = both[i, j].astype(np.float64)
    value = common / (total[i].astype(np.float64) + total[j] - common)
    good = value >= threshold
    i, j, value = i[good], j[good], value[good]
    label = rows["label"].tolist()
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    node, out = rows["node"].tolist(), []
    for x, y, v in zip(i.tolist(), j.tolist(), value.tolist()):
        p, q = top(label[x]), top(label[y])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(node[x], node[y]), max(node[x], node[y]), v))
    return pd.DataFrame(out, columns=["a", "b", "similarity"])


def exhaustive(members: DataFrame, heads: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between different components among all nodes that share an open bucket: (a, b, similarity), enough of them to join the components.

    Nodes gather by the smallest label of their buckets, once each however many buckets they share. A gathering is cut into
    blocks of at most about BLOCK_NODES nodes and BLOCK_SHINGLES elements, and every two blocks meet in one task: a node's
    elements are copied once for each block of its gathering.
    """
    met = members.join(heads.select("value", F.col("label").alias("head")), "value").select("head", "node", "label").distinct()
    met = stored(_hashed(met.join(texts, "node")), "open")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum(F.length("elements")) / (8 * BLOCK_SHINGLES))).cast("int")
    sizes = stored(met.groupBy("head").agg(blocks.alias("k")), "gatherings")
    placed = met.join(sizes, "head").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    copies = copies.select("head", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "label", "elements")
    return copies.groupBy("head", "low", "high").applyInPandas(lambda rows: _block_links(rows, threshold), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of the edges (a, b). Labels spread to neighbours and along labels until none changes."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b"), F.col("a"))).where("x <> y").distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").join(jump, "label", "left")
        new = stored(step.select("node", F.least("label", "near", F.coalesce("beyond", "label")).alias("to"), "label"), "labels")
        changed = new.where("to <> label").limit(1).count()
        drop_stored(labels)
        labels = new.select("node", F.col("to").alias("label"))
        if not changed:
            drop_stored(both)
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of near duplicates: (rows, classed, links).

    rows: row (a struct of all columns of `docs`) and uid (its number). classed: uid, node (the smallest uid of its text's multiset
    of shingles) and class (the component's smallest node); both null without words. links: the verified pairs (a, b, similarity)
    of nodes that joined the components; equal texts need none. Texts without words are each their own class. Repeated rows share
    their class. An empty table gives empty results.
    """
    table = stored(signed(docs, text), "signed")
    same = stored(table.where("digest IS NOT NULL").groupBy("digest").agg(F.min("uid").alias("node")), "digests")
    nodes = stored(table.select(F.col("uid").alias("node"), "s0", "s1", "s2", "bands").join(same.select("node"), "node", "left_semi"), "nodes")
    buckets = _buckets(nodes)
    met = buckets.select("node").distinct()
    signs = stored(nodes.select("node", "s0", "s1", "s2").join(met, "node", "left_semi"), "signs")
    texts = stored(table.select(F.col("uid").alias("node"), F.col(f"row.`{text}`").alias("text")).join(met, "node", "left_semi"), "texts")
    labels = stored(signs.select("node", F.col("node").alias("label")), "labels")
    drop_stored(nodes)
    links = None
    for round_ in range(STAR_ROUNDS + 1):
        members = buckets.join(labels, "node")
        # the bucket's leader is the node of the smallest label
        heads = members.groupBy("value").agg(F.min("label").alias("label"), F.min_by("node", "label").alias("head"), F.max("label").alias("last")).where("label <> last").select("value", "label", "head")
        if round_ < STAR_ROUNDS:
            pairs = members.alias("m").join(heads.alias("h"), (F.col("m.value") == F.col("h.value")) & (F.col("h.label") < F.col("m.label"))).select(F.col("h.head").alias("a"), F.col("m.node").alias("b")).distinct()
            sides = pairs.join(signs.select(F.col("node").alias("a"), *(F.col(f"s{k}").alias(f"a{k}") for k in range(3))), "a").join(signs.withColumnRenamed("node", "b"), "b")
            pairs = sides.where(sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"s{k}"))) for k in range(3)), F.lit(0)) <= MAX_BITS).select("a", "b")
            # in the first round each node meets one leader only: most groups are joined by that
            found = stored(verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if round_ == 0 else pairs, texts, threshold), "links")
        else:
            found = stored(exhaustive(members, heads, texts, threshold), "links")
        links = found if links is None else links.unionAll(found)
        if found.limit(1).count():
            between = found.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            merged = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
            before, labels = labels, stored(labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            drop_stored(before)
    for done in (buckets, texts, signs):
        drop_stored(done)
    class_of = stored(same.join(labels, "node", "left").select("digest", "node", F.coalesce("label", "node").alias("class")), "classes")
    return table.select("row", "uid"), table.select("uid", "digest").join(class_of, "digest", "left").select("uid", "node", "class"), links


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size, n_texts (different multisets of shingles), n_links; a row per row of `docs`.

    n_links: the verified links of the class, at least as many as join its different texts. Null, empty and wordless texts are
    classes of their own (n_texts 0); repeated rows and equal texts share a class; a class of null ids has a null class_id. An
    empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    rows, classed, links = near_duplicates(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), "text", threshold)
    found = stored(classed.join(rows.select("uid", "row.doc_id"), "uid").select("doc_id", "node", "class"), "classed")
    linked = links.join(found.select(F.col("node").alias("a"), "class").distinct(), "a").groupBy("class").agg(F.count("*").alias("n_links"))
    sizes = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.countDistinct("node").alias("n_texts"))
    # stored, so that the join's two sides are plain exchanges, of which Spark can split a large class
    sizes = stored(sizes.join(linked, "class", "left"), "classes")
    own = F.col("class").isNull()
    counts = (F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (("class_size", 1), ("n_texts", 0), ("n_links", 0)))
    return found.join(sizes.hint("merge"), "class", "left").select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), *counts)


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of `docs` for each class, that with the smallest id (nulls first, then row number). Columns unchanged, whatever their names.

    Null, empty and wordless texts all stay; of repeated rows one stays; an empty table stays empty.
    """
    rows, classed, _ = near_duplicates(docs, text, threshold)
    keyed = classed.where("class IS NOT NULL").join(rows.select("uid", F.col(f"row.`{key}`").alias("key")), "uid")
    first = keyed.groupBy("class").agg(F.min(F.struct("key", "uid")).alias("first")).select(F.col("first.uid").alias("uid"))
    kept = stored(classed.where("class IS NULL").select("uid").unionAll(first), "kept")
    return rows.join(kept.hint("merge"), "uid", "left_semi").select("row.*")
