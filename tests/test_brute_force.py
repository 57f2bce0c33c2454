"""Operators that SQL cannot express, against brute force on small fixtures, and one worked example for each table of fixed values."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import clinical as cl
from helixframe.operators import graph as g
from helixframe.operators import intervals as iv
from helixframe.operators import sequences as ops
from helixframe.operators import statistics as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def paths(reads, k):
    """Contigs of the de Bruijn graph by walking."""
    edges = {r[i : i + k] for r in reads for i in range(len(r) - k + 1)}
    out, into = defaultdict(list), defaultdict(list)
    for e in edges:
        out[e[:-1]].append(e)
        into[e[1:]].append(e)
    inner = lambda n: len(out[n]) == len(into[n]) == 1
    found, used = set(), set()
    for e in sorted(edges, key=lambda e: (inner(e[:-1]), e)):  # open paths first, then rings from their smallest edge
        if e in used or inner(e[:-1]) and into[e[:-1]][0] not in used and not ring(e, into, inner):
            continue
        text = e
        used.add(e)
        while inner(text[-k + 1 :]) and (nxt := out[text[-k + 1 :]][0]) not in used:
            used.add(nxt)
            text += nxt[-1]
        found.add(text)
    return found


def ring(e, into, inner):
    at = e
    while inner(at[:-1]):
        at = into[at[:-1]][0]
        if at == e:
            return True
    return False


def test_unitigs(spark):
    rng = random.Random(4)
    genome = "".join(rng.choices("ACGT", k=300))
    reads = [genome[i : i + 60] for i in range(0, 240, 15)] + [genome[40:80] + "".join(rng.choices("ACGT", k=20))] + ["ACGGTCATTGCAACGGTCATTGCAACGG"]
    df = spark.createDataFrame(list(enumerate(reads)), "id long, seq string")
    rows = ops.unitigs(df, "id", 9).collect()
    assert {r.seq for r in rows} == paths(reads, 9) and len(rows) == len({r.seq for r in rows})
    assert all(r.n_kmers == len(r.seq) - 8 and r.contig == r.seq[:9] for r in rows)
    assert ops.unitigs(df.limit(0), "id", 9).collect() == []


def test_suffixes_and_repeats(spark):
    texts = ["BANANA", "AAAA", "", "ACGTACGA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    for k, t in enumerate(texts):
        rows = ops.suffix_array(df.where(F.col("id") == k), "id").orderBy("rank").collect()
        s = t + "$"
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert [r.pos for r in rows] == want and "".join(r.bwt for r in rows) == "".join(s[i - 1] for i in want)
    assert {r.id: r.repeat for r in ops.longest_repeat(df, "id").collect()}[0] == "ANA"


def test_stem_loops_are_all_found():
    rng, pairs = random.Random(1), {"AU", "UA", "GC", "CG", "GU", "UG"}
    s = "".join(rng.choices("ACGU", k=40))
    want = []
    for i in range(len(s)):
        for stem in range(4, 15):
            for loop in range(3, 9):
                end = i + 2 * stem + loop
                n = sum(s[i + j] + s[end - 1 - j] in pairs for j in range(stem)) if end <= len(s) else 0
                if n >= 0.8 * stem:
                    want.append((i, end, stem, loop, n / stem))
    assert ops.stem_loops(s) == sorted(want)


def test_fixed_values(spark):
    protein = "M" + "A" * 20 + "LLLKKKKWC" + "AA" + "C" + "A" * 12 + "H" + "AAA" + "H"
    hits = {(h.motif, h.start, h.text) for h in one(spark, sq.protein_domains(F.lit(protein)))}
    assert hits == {(n, m.start(), m[0]) for n, p in sq.DOMAINS.items() for m in re.finditer(p, protein)} and {h[0] for h in hits} >= {"signal_peptide", "transmembrane", "nuclear_localization", "zinc_finger"}
    assert one(spark, sq.isoelectric_point(F.lit("D"))) == pytest.approx(3.1, abs=0.05)
    assert one(spark, sq.molecular_weight(F.lit("AC"), "dna")) == pytest.approx(313.21 + 289.18 - 61.97)
    assert one(spark, sq.melting_temperature(F.lit("ACGTACGTACGTACGT"))) == pytest.approx(64.9 + 41 * (0.5 - 0.41) - 500 / 16)
    assert one(spark, cl.risk_score(F.lit("Stage III"), F.array(F.lit("TP53"), F.lit("KRAS"), F.lit("MYC")), F.lit(71), F.lit(2), F.lit(True))) == pytest.approx(0.6 + 0.2 - 0.1 + 0.1 + 0.2)
    assert one(spark, cl.risk_score(F.lit("?"), F.array().cast("array<string>"), F.lit(50), F.lit(0))) == 0.5
    assert one(spark, sq.trim_adapter(F.lit("ACGTAGATCGGA"), "AGATCGGAAGAGC")) == "ACGT"
    assert [tuple(p) for p in one(spark, sq.aligned_pairs(F.lit(10), F.lit("1S2M1I1M2D1M")))] == [(1, 10), (2, 11), (4, 12), (5, 15)]


def test_components_and_ranks(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2)) if a != b})
    df = spark.createDataFrame(pairs, "src long, dst long")
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in g.components(df).collect()} == label
    nodes = sorted(label)
    rank, out = dict.fromkeys(nodes, 1 / len(nodes)), defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    for _ in range(100):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a in nodes:
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    assert {r.node: r.rank for r in g.pagerank(df).collect()} == pytest.approx(rank, abs=1e-5)


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    found = {(r.src, r.dst) for r in g.sample_network(spark.createDataFrame(rows, "sample long, feature int, value double"), 3, block=17).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:3]}
    assert found == want | {(b, a) for a, b in want}


def test_sweep_by_runs_is_the_plain_sweep(spark):
    rng = random.Random(2)
    rows = [(0, s, s + rng.randint(5, 40), rng.random()) for s in (rng.randint(0, 2000) for _ in range(150))]
    kept = []
    for r in sorted(rows, key=lambda r: r[1:]):
        if kept and kept[-1][2] - r[1] > 5:
            kept[-1] = r if r[3] > kept[-1][3] else kept[-1]
        else:
            kept.append(r)
    df = spark.createDataFrame(rows, "ref long, start long, end long, score double")
    assert sorted(tuple(r) for r in iv.best_non_overlapping(df, "ref", 5, together=4).collect()) == sorted(kept)


def test_significance_of_planted_sets(spark):
    ranking = spark.createDataFrame([(f"g{i}", float(200 - i)) for i in range(400)], "gene string, score double")
    sets = spark.createDataFrame([("top", f"g{i}") for i in range(0, 40, 2)] + [("spread", f"g{i}") for i in range(0, 400, 20)] + [("bottom", f"g{i}") for i in range(380, 400)], "pathway string, gene string")
    found = {r.pathway: r for r in st.prerank_significance(ranking, sets, permutations=200).collect()}
    assert found["top"].p_value < 0.02 and found["top"].nes > 1.5 and found["bottom"].p_value < 0.02 and found["bottom"].nes < -1.5 and found["spread"].p_value > 0.1
    assert found["top"].fdr >= found["top"].p_value


def test_choice_of_test(spark):
    rng = np.random.default_rng(3)

    def chosen(*groups):
        rows = [(k, float(v)) for k, values in enumerate(groups) for v in values]
        return st.select_test(spark.createDataFrame(rows, "grp int, value double"), "grp").first().test

    normal = lambda sd: rng.normal(0, sd, 400)
    assert chosen(normal(1), normal(1)) == "student" and chosen(normal(1), normal(1), normal(1)) == "anova"
    assert chosen(rng.exponential(1, 400), rng.exponential(1, 400)) == "mann_whitney" and chosen(*rng.exponential(1, (3, 300))) == "kruskal"


def test_neighbours_of_many_equal_vectors(spark, monkeypatch):
    """More copies than are kept, with equal distances: ties go to the smaller sample; what blocks keep does not grow with their number or with copies."""
    tables, settled = [], g.settled
    monkeypatch.setattr(g, "settled", lambda *a, **k: tables.append(settled(*a, **k)) or tables[-1])
    rng = np.random.default_rng(9)
    x = np.vstack([np.zeros((70, 3)), np.ones((4, 3)), rng.integers(-1, 2, (40, 3))]).astype(float)
    names = rng.permutation(len(x))
    rows = [(int(s), j, float(v)) for s, r in zip(names, x) for j, v in enumerate(r)]
    found = {(r.src, r.dst, r.distance) for r in g.sample_network(spark.createDataFrame(rows, "sample long, feature int, value double"), 3, block=7).collect()}
    want = set()
    for a, v in zip(names, x):
        for d, b in sorted((float(np.sqrt(((v - w) ** 2).sum())), int(b)) for b, w in zip(names, x) if b != a)[:3]:
            want |= {(int(a), b, d), (b, int(a), d)}
    assert found == want
    kept = [t.count() for t in tables if "asking" in t.columns]
    assert len(kept) == 1 and kept[0] <= 4 * len(np.unique(x, axis=0))
