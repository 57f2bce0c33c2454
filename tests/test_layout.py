"""Layouts of shuffled, partly reversed genomes; matching against the run by falling weight; overlap, layout and consensus."""

import random

import pytest

from helixframe import catalog
from helixframe.operators import layout as ly
from helixframe.plans.assembly import _passages
from tests.test_mapping import bases, changed, reverse


def pieces(rng, genome, cuts):
    """Contigs (name, seq) in random order, some reversed, and the true order (name, strand)."""
    parts = [(f"c{k}", genome[a:b]) for k, (a, b) in enumerate(cuts)]
    flipped = {name for name, _ in parts if rng.random() < 0.5}
    truth = [(name, "-" if name in flipped else "+") for name, _ in parts]
    contigs = [(name, reverse(s) if name in flipped else s) for name, s in parts]
    rng.shuffle(contigs)
    return contigs, truth


def order(rows):
    return [(r.contig, r.strand) for r in sorted(rows, key=lambda r: r.position)]


def either(truth):
    return (truth, [(c, "-" if s == "+" else "+") for c, s in reversed(truth)])


def test_matching_is_the_run_by_falling_weight(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(25)}", rng.choice("35"), f"n{rng.randrange(25)}", rng.choice("35"), rng.randrange(1, 9), k) for k in range(160)]
    best = {}
    for c1, e1, c2, e2, w, _ in links:
        if c1 != c2:
            key = tuple(sorted((f"{c1}|{e1}", f"{c2}|{e2}")))
            best[key] = max(w, best.get(key, 0))
    want, used = set(), set()
    for (a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if not {a, b} & used:
            want.add((a, b, w))
            used |= {a, b}
    df = spark.createDataFrame(links, "contig1 string, end1 string, contig2 string, end2 string, weight long, gap long")
    got = ly.matched(df)
    assert {(r.a, r.b, r.weight) for r in got.collect()} == want
    contigs = spark.createDataFrame([(f"n{k}",) for k in range(30)], "contig string")
    rows = ly.walks(contigs, got).collect()
    assert sorted(r.contig for r in rows) == sorted(f"n{k}" for k in range(30))  # each once, rings cut
    by = {}
    for r in rows:
        by.setdefault(r.scaffold, []).append(r)
    joined = set()
    for own in by.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and own[0].gap is None and own[0].scaffold == own[0].contig
        for x, y in zip(own, own[1:]):
            joined.add(tuple(sorted((f"{x.contig}|{'3' if x.strand == '+' else '5'}", f"{y.contig}|{'5' if y.strand == '+' else '3'}"))))
    missing = {(a, b) for a, b, _ in want} - joined
    assert joined <= {(a, b) for a, b, _ in want} and len(missing) <= len(by)
    assert ly.matched(df.limit(0)).collect() == [] and len(ly.walks(contigs, ly.matched(df.limit(0))).collect()) == 30


def test_a_ring_is_cut_at_its_lightest_link(spark):
    links = spark.createDataFrame([("a", "3", "b", "5", 9, 1), ("b", "3", "c", "3", 8, 2), ("c", "5", "a", "5", 2, 3)], "contig1 string, end1 string, contig2 string, end2 string, weight long, gap long")
    rows = ly.walks(spark.createDataFrame([("a",), ("b",), ("c",)], "contig string"), ly.matched(links)).collect()
    assert order(rows) == [("a", "+"), ("b", "+"), ("c", "-")] and [r.gap for r in sorted(rows, key=lambda r: r.position)] == [None, 1, 2]


@pytest.mark.parametrize("source", ["long reads", "contacts"])
def test_a_shuffled_and_partly_reversed_genome(spark, source):
    rng = random.Random(6)
    genome = bases(rng, 3200)
    cuts = [(k * 400 + 10, k * 400 + 390) for k in range(8)]
    contigs, truth = pieces(rng, genome, cuts)
    df = spark.createDataFrame(contigs, "contig string, seq string")
    if source == "long reads":
        reads = []
        for k in range(60):
            i = rng.randrange(0, 2200)
            s = genome[i : i + 1000]
            reads.append((k, reverse(s) if k % 2 else s))
        links = ly.long_read_links(spark.createDataFrame(reads, "read_id long, seq string"), df)
    else:
        at = {name: (a, b, strand) for (name, strand), (a, b) in zip(truth, cuts)}
        contacts = []
        for _ in range(6000):
            x = rng.randrange(3200)
            y = x + int(rng.expovariate(1 / 150))
            hit = [(n, (p - a if s == "+" else b - 1 - p)) for p in (x, y) for n, (a, b, s) in at.items() if a <= p < b]
            if len(hit) == 2:
                contacts.append((hit[0][0], hit[0][1], hit[1][0], hit[1][1]))
        links = ly.contact_links(spark.createDataFrame(contacts, "contig1 string, pos1 long, contig2 string, pos2 long"), spark.createDataFrame([(n, len(s)) for n, s in contigs], "contig string, length long"))
    rows = ly.scaffolds(df, links).collect()
    assert len({r.scaffold for r in rows}) == 1 and order(rows) in either(truth)
    if source == "long reads":
        assert {r.gap for r in rows} == {None, 20}
        (made,) = ly.scaffold_sequences(ly.scaffolds(df, links), df).collect()
        plain = ("N" * 20).join(genome[a:b] for a, b in cuts)
        assert made.seq in (plain, reverse(plain)) and made.n == 8


def test_overlap_layout_consensus(spark):
    rng = random.Random(7)
    genome = bases(rng, 1200)
    reads = []
    for k, i in enumerate(range(0, 1101, 25)):
        s = genome[i : i + 100]
        reads.append((k, reverse(s) if rng.random() < 0.5 else s))
    reads += [(500, genome[130:170]), (501, reverse(genome[600:700])), (502, genome[600:700]), (503, bases(rng, 80)), (504, ""), (505, None)]
    rng.shuffle(reads)
    df = spark.createDataFrame(reads, "read_id long, seq string")
    kept = {r.read_id for r in ly.without_contained(df).collect()}
    assert not kept & {500, 504, 505} and 503 in kept and len(kept) == 46
    placed = ly.overlap_layout(df, 30)
    rows = placed.collect()
    assert len({r.scaffold for r in rows}) == 2 and {r.gap for r in rows} == {None, -75}
    (c,) = ly.overlap_consensus(placed, df).collect()
    assert c.seq in (genome, reverse(genome)) and c.n_reads == 45 and c.coverage == pytest.approx(45 * 100 / 1200)


def test_the_queries_bring_passages_back(spark):
    sf = "/root/testdata/sf0.001"
    genomes = {r.item_id: r.g for r in _passages(spark, sf).collect()}
    whole = "|".join(genomes.values())
    made = [r.seq for r in catalog.queries()["overlap_contigs"](spark, sf).collect()]
    right = [s for s in made if s in whole or reverse(s) in whole]
    assert len(right) >= 0.95 * len(made) and sum(map(len, right)) >= 0.9 * sum(len(g) for g in genomes.values() if len(g) >= 120)
    by = {}
    for r in catalog.queries()["scaffold_walks"](spark, sf).collect():
        by.setdefault(r.scaffold, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.position)
        at = [tuple(map(int, r.contig.split(":"))) for r in rows]
        ways = {("-" if (i + 7 * k) % 3 == 0 else "+") == r.strand for (i, k), r in zip(at, rows)}
        assert len({i for i, _ in at}) == 1 and len(ways) == 1  # one passage, read one way
        ks = [k for _, k in at]
        assert ks == list(range(min(ks), max(ks) + 1)) or ks == list(range(max(ks), min(ks) - 1, -1))
