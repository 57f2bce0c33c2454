"""Approximate nearest neighbours by inner product: NN-descent builds the graph, greedy search over it answers queries.

Equal vectors are one node; of its rows the smallest ids are kept, as many as an answer can need. The graph's lists start
from windows of vectors sorted by random projections. Then, again and again, each node brings together its neighbours and
some of those that list it (a join of edges with nodes), every pair of which is compared where at least one is new, and
better partners go to the nodes' lists; nodes that bring nothing new together are left out. Of the nodes that list a hub,
each task keeps a few before anything is shuffled. All scores, of lists and beams, are those of the original vectors in double
precision, so near copies keep their order; a vector goes to each block that compares it once, not once an edge. A query starts
at its own node and expands the best nodes of its beam, many queries in one join a round, until the beam holds no node that
is not expanded.

Blocks have a fixed number of nodes or queries, so tasks do not grow with the corpus. `exact` compares queries with all
vectors, in blocks, to measure recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from helixframe.llm.common import drop_stored, stored

#: Lists of the graph, sampled reverse neighbours, rounds at most, share of changed entries that ends them.
LIST, REVERSE, ROUNDS, SETTLED = 32, 12, 8, 0.02
#: Projections of the start, their windows; beam, nodes expanded a round.
PROJECTIONS, WINDOW, BEAM, EXPAND = 3, 128, 192, 48
#: Nodes that are brought together in one task's group, nodes of a task of the start and of the search, queries of a group.
NODES_PER_BLOCK, NODES_PER_TASK, QUERIES_PER_BLOCK = 300, 5000, 100
#: Offers that a task holds before it drops all but the best of each node.
HELD = 200_000
_LISTS = "id long, ids array<long>, scores array<double>, fresh array<boolean>"


def _join(column: pd.Series, dtype: type) -> np.ndarray:
    """The arrays of a column, one behind the other."""
    return np.concatenate([np.asarray(x, dtype=dtype) for x in column]) if len(column) else np.empty(0, dtype)


def _sizes(column: pd.Series) -> np.ndarray:
    return np.fromiter(map(len, column), dtype=np.int64, count=len(column))


def _column(arrays: list[np.ndarray]) -> pd.Series:
    """A column of arrays, also if there are none."""
    return pd.Series(arrays, dtype=object)


def _parts(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The different keys (which are sorted) and each column cut at them."""
    own, starts = np.unique(keys, return_index=True)
    return own, [np.split(c, starts[1:]) if len(own) else [] for c in columns]


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): null ids, null or zero vectors, those with null or non-finite components or of another length than most take no part; one row an id."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    fine = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    usual = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("vec") == (usual[0]["n"] if usual else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def nodes_of(rows: DataFrame, members: int) -> DataFrame:
    """(id, vec, members): a node per different vector; id is its smallest, members its smallest ids. Only so many of each task's rows of a vector are shuffled."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= members)
    return ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.element_at("members", 1).alias("id"), "vec", "members")


def _codes(nodes: DataFrame, exact: str) -> DataFrame:
    """(id, code): the components as bytes of the numpy type `exact`, which holds them without loss."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "code": [np.asarray(v, dtype=exact).tobytes() for v in batch["vec"]]})

    return nodes.select("id", "vec").mapInPandas(run, "id long, code binary")


def _decoded(codes: pd.Series, dimension: int) -> np.ndarray:
    """A row a vector, in the type that it is kept in."""
    width = len(codes.iloc[0]) // dimension if len(codes) else 8
    return np.frombuffer(b"".join(codes), dtype=f"<f{width}").reshape(len(codes), dimension)


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray, keep: int) -> np.ndarray:
    """Positions of each owner's `keep` best different ids, by owner and falling score. Of equal ids the first in `fresh` order stays (old before new)."""
    order = np.lexsort((fresh, ids, owner))
    first = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (ids[order][1:] != ids[order][:-1])] if len(order) else np.empty(0, bool)
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], owner[order]))]
    sorted_owner = owner[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner)
    return order[rank < keep]


def _lists(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray, keep: int) -> pd.DataFrame:
    best = _best(owner, ids, scores, fresh, keep)
    own, (ids, scores, fresh) = _parts(owner[best], ids[best], scores[best], fresh[best])
    return pd.DataFrame({"id": own, "ids": _column(ids), "scores": _column(scores), "fresh": _column(fresh)})


def _started(codes: DataFrame, dimension: int, tasks: int) -> DataFrame:
    """Lists from windows of vectors sorted by random projections."""
    rng = np.random.default_rng(11)
    made = None
    for _ in range(PROJECTIONS):
        direction = rng.normal(size=dimension)

        def project(batches: Iterator[pd.DataFrame], direction: np.ndarray = direction) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(p=_decoded(batch["code"], dimension) @ direction)

        def window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = []
            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= 16 * WINDOW:
                    yield from near(pd.concat(held))
                    held = []
            if held and sum(map(len, held)):
                yield from near(pd.concat(held))

        def near(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for a in range(0, len(rows), WINDOW):
                part = rows.iloc[a : a + WINDOW]
                x, own = _decoded(part["code"], dimension).astype(np.float64), part["id"].to_numpy()
                scores = x @ x.T
                i, j = np.nonzero(~np.eye(len(part), dtype=bool))
                yield _lists(own[i], own[j], scores[i, j], np.ones(len(i), bool), LIST // 2)

        sorted_rows = codes.mapInPandas(project, "id long, code binary, p double").repartitionByRange(tasks, "p").sortWithinPartitions("p")
        part = sorted_rows.mapInPandas(window, _LISTS)
        made = part if made is None else made.unionAll(part)
    return made


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The starting lists of a block of nodes, from those of all windows."""
    owner = np.repeat(rows["id"].to_numpy(), _sizes(rows["ids"]))
    return _lists(owner, _join(rows["ids"], np.int64), _join(rows["scores"], np.float64), np.ones(len(owner), bool), LIST)


def _block(column: str, blocks: int) -> F.Column:
    """The block of a node: its id with higher bits folded in, modulo the number of blocks. The same as `_blocks_of`."""
    c = F.col(column)
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 11)).bitwiseXOR(F.shiftright(c, 23)), F.lit(blocks)).cast("int")


def _blocks_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (ids ^ (ids >> 11) ^ (ids >> 23)) % blocks


def _merge_offers(lists: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
    """A block's lists and the offers to its nodes to new lists. Entries that stay are old now."""
    n = _sizes(lists["ids"])
    owner = np.r_[np.repeat(lists["id"].to_numpy(), n), _join(offers["owners"], np.int64)]
    ids = np.r_[_join(lists["ids"], np.int64), _join(offers["ids"], np.int64)]
    scores = np.r_[_join(lists["scores"], np.float64), _join(offers["scores"], np.float64)]
    new = np.zeros(len(ids), bool)
    new[n.sum() :] = True
    return _lists(owner, ids, scores, new, LIST)


_OFFERS = "to int, owners array<long>, ids array<long>, scores array<double>"


def _meetings(graph: DataFrame, blocks: int, round_: int) -> DataFrame:
    """(block, centre, members, fresh): what each centre brings together, entries of its list and nodes that list it, where any is new."""
    edges = graph.select("id", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("id", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))
    # a draw by edge and round; the window's limit is applied in each task before the shuffle, so a hub's many edges do not meet
    lot = Window.partitionBy("other").orderBy(F.xxhash64("id", "other", F.lit(round_)), "id")
    back = edges.withColumn("r", F.row_number().over(lot)).where(F.col("r") <= REVERSE).select(F.col("other").alias("centre"), F.col("id").alias("member"), "fresh")
    both = edges.select(F.col("id").alias("centre"), F.col("other").alias("member"), "fresh").unionAll(back)
    # a node that is listed and lists counts once; of LIST + REVERSE at most, so the list is bounded
    once = both.groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    met = once.groupBy("centre").agg(F.collect_list(F.struct("member", "fresh")).alias("m")).where(F.exists("m", lambda x: x["fresh"]))
    return met.select(_block("centre", blocks).alias("block"), "centre", F.col("m.member").alias("members"), F.col("m.fresh").alias("fresh"))


def _compare(met: pd.DataFrame, nodes: pd.DataFrame, blocks: int, dimension: int) -> pd.DataFrame:
    """A block of centres and the nodes they bring together: offers of better partners to members, packed by the members' blocks."""
    if not len(met) or not len(nodes):
        return pd.DataFrame({"to": [], "owners": [], "ids": [], "scores": []}, dtype=object)
    by_id = np.argsort(nodes["member"].to_numpy())
    own, bound, x = nodes["member"].to_numpy()[by_id], nodes["bound"].to_numpy(np.float64)[by_id], _decoded(nodes["code"], dimension)[by_id]
    n = _sizes(met["members"])
    row, rank = np.repeat(np.arange(len(met)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # places in `own`; -1, which is the row put behind the others, where a centre has fewer
    at, new = np.full((len(met), n.max()), -1, dtype=np.int64), np.zeros((len(met), n.max()), dtype=bool)
    at[row, rank], new[row, rank] = np.searchsorted(own, _join(met["members"], np.int64)), _join(met["fresh"], bool)
    x, own, bound = np.vstack([x, np.zeros((1, dimension), x.dtype)]), np.r_[own, -1], np.r_[bound, np.inf]
    offers, held = [], 0

    def best_of(offers: list[tuple]) -> tuple:
        owner, ids, scores = (np.concatenate(o) for o in zip(*offers))
        best = _best(owner, ids, scores, np.ones(len(ids), bool), LIST)
        return owner[best], ids[best], scores[best]

    for a in range(0, len(at), 64):
        k, f = at[a : a + 64], new[a : a + 64]
        y = x[k].astype(np.float64)
        scores = y @ y.transpose(0, 2, 1)
        wanted = (scores > bound[k][:, :, None]) & (k >= 0)[:, None, :] & (k[:, :, None] != k[:, None, :]) & (f[:, :, None] | f[:, None, :])
        c, i, j = np.nonzero(wanted)
        offers.append((own[k[c, i]], own[k[c, j]], scores[c, i, j]))
        held += len(c)
        if held > HELD:
            offers, held = [best_of(offers)], 0
            # no later offer to a node counts that does not beat a full list of them
            owner, _, scores = offers[0]
            last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])
            full = last[np.diff(np.r_[-1, last]) == LIST]
            place = np.searchsorted(own[:-1], owner[full])
            bound[place] = np.maximum(bound[place], scores[full])
    owner, ids, scores = best_of(offers)
    to = _blocks_of(owner, blocks)
    order = np.argsort(to, kind="stable")
    found, (owners, ids, scores) = _parts(to[order], owner[order], ids[order], scores[order])
    return pd.DataFrame({"to": found, "owners": _column(owners), "ids": _column(ids), "scores": _column(scores)})


def build_graph(codes: DataFrame, dimension: int) -> DataFrame:
    """NN-descent over (id, code): each node's list of its best partners found."""
    n = codes.count()
    blocks, tasks = (max(1, -(-n // size)) for size in (NODES_PER_BLOCK, NODES_PER_TASK))
    block = _block("id", blocks).alias("block")
    graph = stored(_started(codes, dimension, tasks).groupBy(block).applyInPandas(_merge, _LISTS), "graph")
    for round_ in range(ROUNDS):
        met = stored(_meetings(graph, blocks, round_), "meetings")
        # an offer must beat the last entry of a full list
        bounds = graph.select("id", F.when(F.size("scores") == LIST, F.element_at("scores", -1)).otherwise(float("-inf")).alias("bound"))
        nodes = codes.join(bounds, "id", "left").select(F.col("id").alias("member"), "code", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        asked = met.select(F.col("block").alias("at"), F.explode("members").alias("member")).distinct().join(nodes, "member")
        offers = met.groupBy("block").cogroup(asked.groupBy("at")).applyInPandas(lambda e, x: _compare(e, x, blocks, dimension), _OFFERS)
        merged = stored(graph.groupBy(block).cogroup(offers.groupBy(F.col("to").alias("block"))).applyInPandas(_merge_offers, _LISTS), "graph")
        drop_stored(graph)
        drop_stored(met)
        graph = merged
        changed = graph.select(F.sum(F.size(F.filter("fresh", lambda f: f))).alias("new"), F.sum(F.size("fresh")).alias("all")).first()
        if (changed["new"] or 0) <= SETTLED * (changed["all"] or 1):
            break
    return graph


_BEAM = "qid long, code binary, ids array<long>, scores array<double>, done array<boolean>, seen array<long>"
_BEAM_COLUMNS = [x.split()[0] for x in _BEAM.split(", ")]


def _row_best(ids: np.ndarray, scores: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:BEAM]
    return ids[order], scores[order], done[order]


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, dimension: int) -> DataFrame:
    """(qid, ids, scores): the beam that each query node (column qid) ends with, itself included, by falling score, then id.

    It goes on until every node of every beam is expanded; each round expands some, so it ends.
    """
    n, count = codes.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // NODES_PER_TASK)), max(1, -(-count // QUERIES_PER_BLOCK))
    lists = graph.select("id", "ids", "scores")
    start = queries.join(codes.withColumnRenamed("id", "qid"), "qid").join(lists.withColumnRenamed("id", "qid"), "qid", "left")

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own = _decoded(pd.Series([r.code]), dimension)[0].astype(np.float64)
                ids = np.r_[np.int64(r.qid), np.asarray(r.ids if r.ids is not None else [], np.int64)]
                scores = np.r_[own @ own, np.asarray(r.scores if r.scores is not None else [], np.float64)]
                done = np.zeros(len(ids), bool)
                done[0] = True
                out.append((r.qid, r.code, *_row_best(ids, scores, done), ids))
            yield pd.DataFrame(out, columns=_BEAM_COLUMNS, dtype=object)

    beam = stored(start.mapInPandas(begin, _BEAM), "beam")

    def unseen(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The block's beams with expanded nodes marked (block -1), and for each block of nodes the ids to be scored."""
        out, empty = [], np.empty(0)
        lists_of = {q: g for q, g in found.groupby("asker")["ids"]} if len(found) else {}
        for r in rows.itertuples(index=False):
            done, seen = np.array(r.done, bool), np.asarray(r.seen, np.int64)
            done[np.flatnonzero(~done)[:EXPAND]] = True
            new = np.setdiff1d(_join(lists_of[r.qid], np.int64), seen) if r.qid in lists_of else np.empty(0, np.int64)
            out.append((-1, r.qid, r.code, r.ids, r.scores, done, np.r_[seen, new]))
            part = _blocks_of(new, blocks)
            for b in np.unique(part):
                out.append((int(b), r.qid, r.code, new[part == b], empty, empty, empty))
        return pd.DataFrame(out, columns=["block", *_BEAM_COLUMNS], dtype=object)

    def scored(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"qid": [], "ids": [], "scores": []}, dtype=object)
        order = np.argsort(nodes["id"].to_numpy())
        own, x = nodes["id"].to_numpy()[order], _decoded(nodes["code"], dimension)[order]
        q = _decoded(asked["code"], dimension).astype(np.float64)
        scores = [x[np.searchsorted(own, i)].astype(np.float64) @ q[k] for k, i in enumerate(asked["ids"])]
        return pd.DataFrame({"qid": asked["qid"].to_numpy(), "ids": asked["ids"].to_numpy(), "scores": scores})

    def joined(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        more = {q: g for q, g in found.groupby("qid")} if len(found) else {}
        out = []
        for r in rows.itertuples(index=False):
            ids, scores, done = np.asarray(r.ids, np.int64), np.asarray(r.scores, np.float64), np.asarray(r.done, bool)
            if r.qid in more:
                new = _join(more[r.qid]["ids"], np.int64)
                ids, scores, done = np.r_[ids, new], np.r_[scores, _join(more[r.qid]["scores"], np.float64)], np.r_[done, np.zeros(len(new), bool)]
            out.append((r.qid, r.code, *_row_best(ids, scores, done), r.seen))
        return pd.DataFrame(out, columns=_BEAM_COLUMNS, dtype=object)


    def query_block(column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(query_blocks)).alias("query_block")

    node_blocks = codes.groupBy(_block("id", blocks).alias("block"))
    while True:
        open_ids = F.slice(F.transform(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), lambda x: x["ids"]), 1, EXPAND)
        steps = beam.select(F.col("qid").alias("asker"), F.explode(open_ids).alias("id")).join(lists.select("id", "ids"), "id").select("asker", "ids")
        both = stored(beam.groupBy(query_block("qid")).cogroup(steps.groupBy(query_block("asker"))).applyInPandas(unseen, "block int, " + _BEAM), "steps")
        asked = both.where("block >= 0").select("block", "qid", "code", "ids")
        if not asked.limit(1).count():
            drop_stored(both)
            return beam.select("qid", "ids", "scores")
        found = asked.groupBy("block").cogroup(node_blocks).applyInPandas(scored, "qid long, ids array<long>, scores array<double>")
        new = stored(both.where("block < 0").drop("block").groupBy(query_block("qid")).cogroup(found.groupBy(query_block("qid"))).applyInPandas(joined, _BEAM), "beam")
        drop_stored(beam)
        drop_stored(both)
        beam = new


def _ranked(pairs: DataFrame, nodes: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """Of (qid, id, score) between nodes the k best rows of each query, its own row left out."""
    rows = pairs.join(nodes.select("id", "members"), "id").join(of, "qid").select("query_id", "score", F.explode("members").alias("vec_id")).where("query_id <> vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _prepared(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """Nodes, their codes, the queries' nodes (query_id, qid) and the dimension; None without vectors."""
    rows = stored(valid(vectors, key, vector), "vectors")
    head = rows.limit(1).collect()
    if not head:
        return None
    nodes = stored(nodes_of(rows, k + 1), "nodes")
    kept = vectors.schema[vector].dataType
    codes = stored(_codes(nodes, "<f4" if kept == ArrayType(FloatType(), kept.containsNull) else "<f8"), "codes")
    of = queries.select(F.col("query_id").cast("long").alias("id")).where("id IS NOT NULL").distinct().join(rows, "id").select(F.col("id").alias("query_id"), "vec").join(nodes.select("vec", F.col("id").alias("qid")), "vec").select("query_id", "qid")
    return nodes, codes, stored(of, "queries"), len(head[0]["vec"])


_NONE = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query id the `k` nearest other rows found, by falling inner product, then id.

    `queries` has ids (column query_id) of rows of `vectors`; ids that take no part (see `valid`) or are null give no rows, repeated
    ones count once. Repeated rows of `vectors` with one id count once. Fewer rows than k: all of them. Vectors of another length
    than most have no inner product with the others and take no part. An empty table gives no rows; other columns are ignored.
    """
    made = _prepared(vectors, queries, k, key, vector)
    if made is None:
        return vectors.sparkSession.createDataFrame([], _NONE)
    nodes, codes, of, dimension = made
    beam = search(build_graph(codes, dimension), codes, of.select("qid").distinct(), dimension)
    # the beam's scores are exact: the k best nodes besides the query's own hold the k best rows
    pairs = beam.select("qid", F.explode(F.slice(F.arrays_zip("ids", "scores"), 1, k + 1)).alias("x")).select("qid", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    return _ranked(pairs, nodes, of, k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """What `nearest` approximates, by comparing each block of queries with each block of vectors. For measuring recall."""
    made = _prepared(vectors, queries, k, key, vector)
    if made is None:
        return vectors.sparkSession.createDataFrame([], _NONE)
    nodes, codes, of, dimension = made
    blocks = max(1, -(-codes.count() // NODES_PER_TASK))
    asked = stored(of.select("qid").distinct().join(codes.withColumnRenamed("id", "qid"), "qid"), "asked").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(nodes):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        x, out, keep = _decoded(nodes["code"], dimension).astype(np.float64), [], min(k + 1, len(nodes))
        ids = nodes["id"].to_numpy()
        for a in range(0, len(asked), 256):
            part = asked.iloc[a : a + 256]
            scores = _decoded(part["code"], dimension).astype(np.float64) @ x.T
            # all that reach the score of the last one kept; ties are cut by rank later
            least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
            i, j = np.nonzero(scores >= least[:, None])
            out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[i], "id": ids[j], "score": scores[i, j]}))
        return pd.concat(out)

    pairs = asked.groupBy("block").cogroup(codes.groupBy(_block("id", blocks).alias("block"))).applyInPandas(run, "qid long, id long, score double")
    return _ranked(pairs, nodes, of, k)
