"""Centralities against breadth-first search and eigenvectors of whole matrices."""

import os
import random
from collections import deque

import numpy as np
import pytest

from helixframe import catalog
from helixframe.operators import adjacency
from helixframe.operators import centrality as ce
from helixframe.operators import graph as graph_module


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(130)} | {(100, 101), (101, 102), (7, 7)}
    return edges, spark.createDataFrame(sorted(edges) + [(3, 3)], "src long, dst long")


def breadth(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        far, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            for w in near[v] - far.keys():
                far[w] = far[v] + 1
                todo.append(w)
        r, total = len(far) - 1, sum(far.values())
        out[s] = (r, r * r / total / (len(near) - 1) if total else 0.0)
    return near, out


def test_closeness(graph):
    edges, df = graph
    _, want = breadth(edges)
    got = {r.node: (r.reached, r.closeness) for r in ce.closeness_exact(df).collect()}
    assert set(got) == set(want) and all(got[v] == pytest.approx(want[v]) for v in want)
    near = {r.node: (r.reached, r.closeness) for r in ce.closeness(df).collect()}
    assert set(near) == set(want) and all(near[v] == pytest.approx(want[v], rel=0.05) for v in want)
    assert ce.closeness(df.limit(0)).collect() == [] and ce.closeness_exact(df.limit(0)).collect() == []


def test_eigenvector_and_hubs(graph):
    edges, df = graph
    near, _ = breadth(edges)
    nodes = sorted(near)
    a = np.array([[float(w in near[v]) for w in nodes] for v in nodes])
    value, vectors = np.linalg.eigh(a)
    want = np.abs(vectors[:, -1])
    got = {r.node: r.centrality for r in ce.eigenvector(df, 1e-6).collect()}
    assert [got[v] for v in nodes] == pytest.approx(want.tolist(), abs=1e-3)
    d = np.array([[float((v, w) in edges and v != w) for w in nodes] for v in nodes])
    hub = np.ones(len(nodes))
    for _ in range(3000):
        hub = d @ (d.T @ hub)
        hub /= hub.sum()
    authority = d.T @ hub
    authority /= authority.sum()
    rows = {r.node: r for r in ce.hubs_and_authorities(df, 1e-5).collect()}
    assert [rows[v].hub for v in nodes] == pytest.approx(hub.tolist(), abs=1e-3) and [rows[v].authority for v in nodes] == pytest.approx(authority.tolist(), abs=1e-3)
    assert ce.eigenvector(df.limit(0)).collect() == [] and ce.hubs_and_authorities(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ce.eigenvector(df, 1e-12, rounds=1)


def test_the_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        rows.setdefault((r.l_orderkey, r.l_linenumber), set()).add(r.l_partkey)
    edges = {(p, q) for (o, n), own in rows.items() for p in own for q in rows.get((o, n + 1), ()) if p != q}
    near, want = breadth(edges)
    got = {r.node: r for r in catalog.queries()["graph_closeness"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[v].reached == pytest.approx(want[v][0], rel=0.08) and got[v].closeness == pytest.approx(want[v][1], rel=0.08) for v in want)


def test_closeness_by_slices_of_registers_leaves_no_sketches(spark, graph, monkeypatch):
    edges, df = graph
    _, want = breadth(edges)
    monkeypatch.setattr(ce, "LEAST_SLICE", 1024)
    monkeypatch.setattr(ce, "SLICE_BYTES", 1)
    tables, settled = [], graph_module.settled
    for module in (ce, adjacency):
        monkeypatch.setattr(module, "settled", lambda *a, **k: tables.append(settled(*a, **k)) or tables[-1])
    near = {r.node: (r.reached, r.closeness) for r in ce.closeness(df).collect()}
    assert set(near) == set(want) and all(near[v] == pytest.approx(want[v], rel=0.05) for v in want)
    sketches = [t for t in tables if "sketch" in t.columns]
    left = [t for t in sketches if os.path.exists(t.inputFiles()[0].removeprefix("file:"))]
    assert len(sketches) > 4 and not left


def test_values_travel_along_blocks_of_links(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "LEAST", 16)
    monkeypatch.setattr(adjacency, "PIECE", 5)
    rng = np.random.default_rng(4)
    a = np.triu(rng.random((50, 50)) < 0.2, 1) | (rng.random((50, 50)) < 0.05)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(a))]
    links, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.range(50).withColumnRenamed("id", "node")
    packed, _ = adjacency.packed(links, nodes)
    assert packed.blocks.count() == 4
    rows = packed.nodes.collect()
    chunks = {c: sorted((r.at, r.node) for r in rows if r.chunk == c) for c in {r.chunk for r in rows}}
    values = spark.createDataFrame([(c, np.array([float(v) for _, v in x]).tobytes()) for c, x in chunks.items()], "chunk int, data binary")

    def add(held, x, takers, givers):
        np.add.at(held, takers, x[givers])

    def own(held, x):
        held += 1000 * x

    got = adjacency.travelled(values, packed, lambda row: np.frombuffer(row.data), np.zeros, own, add, lambda held: (held.tobytes(),), "chunk int, data binary").collect()
    sums = {v: s for r in got for (_, v), s in zip(chunks[r.chunk], np.frombuffer(r.data))}
    want = a.T.astype(float) @ np.arange(50) + 1000 * np.arange(50)
    assert [sums[v] for v in range(50)] == pytest.approx(want.tolist())


def test_rounds_of_hubs_do_not_move_links(spark, graph, monkeypatch):
    _, df = graph
    tables, settled = [], graph_module.settled
    for module in (ce, adjacency):
        monkeypatch.setattr(module, "settled", lambda *a, **k: tables.append(settled(*a, **k)) or tables[-1])
    n = ce.hubs_and_authorities(df, 1e-5).count()
    assert n and len([t for t in tables if "links" in t.columns]) == 2
    left = [t for t in tables if "data" in t.columns and t.inputFiles() and os.path.exists(t.inputFiles()[0].removeprefix("file:"))]
    assert not left  # values of rounds are deleted
