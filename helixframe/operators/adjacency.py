"""Graphs in blocks of links, for loops in which values of nodes travel along all links in each round.

Nodes are dealt into chunks. A row of `blocks` has the links into one chunk, by the chunk that they come from and as places within the chunks; values of nodes are a row a chunk.
In a round all chunks' values are streamed past the links (a join that replicates partitions), so that neither links nor values are shuffled: a round writes its values
only. A task holds the links and the values of some chunks, whatever the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import settled

#: Chunks of a graph, as long as they have at least and at most so many nodes and links on average.
CHUNKS, LEAST, MOST, MOST_LINKS = 24, 4096, 1 << 18, 1 << 24
#: Links whose values are gathered at a time.
PIECE = 1 << 15


class Packed(NamedTuple):
    """A graph in blocks: (node, chunk, at), (chunk, size, links) with the links from each chunk by `source`, its nodes and those of the largest chunk."""

    nodes: DataFrame
    blocks: DataFrame
    n: int
    widest: int


def _blocks(links: DataFrame, named: DataFrame, sizes: DataFrame, chunks: int) -> DataFrame:
    """(chunk, size, links) of links (src, dst) by the chunk of `dst`, those from a chunk in the order of the taking node."""
    giver, taker = named.select(F.col("node").alias("src"), F.col("chunk").alias("source"), F.col("at").alias("giver")), named.select(F.col("node").alias("dst"), "chunk", F.col("at").alias("taker"))
    places = links.select("src", "dst").join(giver, "src").join(taker, "dst").select("chunk", "source", "taker", "giver")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = np.flatnonzero(np.diff(batch[["chunk", "source"]].to_numpy(), axis=0, prepend=-1).any(axis=1))
            takers, givers = batch["taker"].to_numpy("int32"), batch["giver"].to_numpy("int32")
            rows = [(batch["chunk"].iat[a], batch["source"].iat[a], takers[a:b].tobytes(), givers[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(batch)])]
            yield pd.DataFrame(rows, columns=["chunk", "source", "takers", "givers"])

    rows = places.repartitionByRange(chunks, "chunk").sortWithinPartitions("chunk", "source", "taker", "giver").mapInPandas(pieces, "chunk int, source int, takers binary, givers binary")
    return settled(sizes.join(rows.groupBy("chunk").agg(F.collect_list(F.struct("source", "takers", "givers")).alias("links")), "chunk", "left").repartitionByRange(chunks, "chunk"))


def packed(links: DataFrame, nodes: DataFrame) -> tuple[Packed, Callable[[DataFrame], Packed]]:
    """Links (src, dst) between `nodes` (node) in blocks, and a function that puts other links between the same nodes in blocks of the same chunks."""
    n = nodes.count()
    chunks = max(1, -(-n // min(MOST, max(LEAST, -(-n // CHUNKS)))), -(-links.count() // MOST_LINKS))
    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.lit(chunks)).cast("int")
    named = settled(nodes.select("node", chunk.alias("chunk")).withColumn("at", F.row_number().over(Window.partitionBy("chunk").orderBy("node")) - 1))
    sizes = settled(named.groupBy("chunk").agg(F.count("*").cast("int").alias("size")))
    widest = sizes.agg(F.max("size")).first()[0] or 0

    def put(of: DataFrame) -> Packed:
        return Packed(named, _blocks(of, named, sizes, chunks), n, widest)

    return put(links), put


def travelled(values: DataFrame, graph: Packed, read: Callable, start: Callable[[int], Any], own: Callable, add: Callable, finish: Callable[[Any], tuple], schema: str) -> DataFrame:
    """A row of `schema` (chunk first) for each chunk, of the values' rows (chunk, ...) and the links into it.

    `start(size)` makes what is held for a chunk, `own(held, x)` takes up its own values, `add(held, x, takers, givers)` gives values at the places `givers`
    to the places `takers` (ascending), and `finish(held)` tells the columns after the first; x is what `read` makes of a chunk's row. To be written with few rows a batch (see `settled`).
    """
    columns, names = [c.split()[0] for c in schema.split(", ")], values.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        now, x = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk != now:
                    now, x = row.chunk, read(row)
                if row.into not in held:
                    held[row.into] = start(row.size)
                if row.into == row.chunk:
                    own(held[row.into], x)
                for piece in row.links if row.links is not None else ():
                    takers, givers = np.frombuffer(piece["takers"], np.int32), np.frombuffer(piece["givers"], np.int32)
                    for a in range(0, len(takers), PIECE):
                        add(held[row.into], x, takers[a : a + PIECE], givers[a : a + PIECE])
        for chunk in sorted(held):
            yield pd.DataFrame([(chunk, *finish(held[chunk]))], columns=columns)

    links = graph.blocks.select(F.col("chunk").alias("into"), "size", "links")
    # partitions are replicated, nothing is shuffled: the values, as one partition, are streamed past each partition of links
    met = values.coalesce(1).hint("shuffle_replicate_nl").crossJoin(links)
    return met.select(*names, "into", "size", F.filter("links", lambda x: x["source"] == F.col("chunk")).alias("links")).mapInPandas(run, schema)
