"""Correction and assembly: planted errors, repeats and rings, against a plain implementation."""

import random

import pytest

from helixframe import catalog
from helixframe.operators import assembly as am
from helixframe.plans.assembly import _passages, planted_reads
from tests.test_mapping import bases, reverse


def canonical(s):
    return min(s, reverse(s))


def sampled(rng, genome, size, step, wrong):
    """Reads of either strand at every step, some with a wrong base: (reads, their originals)."""
    reads, truth = [], []
    for n, i in enumerate(range(0, len(genome) - size + 1, step)):
        s = genome[i : i + size]
        r = s
        if n % wrong == wrong // 2:
            j = rng.randrange(size)
            r = s[:j] + rng.choice([c for c in "ACGT" if c != s[j]]) + s[j + 1 :]
        if rng.random() < 0.5:
            r, s = reverse(r), reverse(s)
        reads.append((n, r))
        truth.append(s)
    return reads, truth


def contigs(spark, reads, k, **options):
    df = spark.createDataFrame(reads, "read_id long, seq string")
    return {r.seq: r for r in am.assemble(df, "read_id", k, **options).collect()}


def test_planted_errors_vanish_and_the_genome_is_whole(spark):
    rng = random.Random(11)
    genome = bases(rng, 900)
    reads, _ = sampled(rng, genome, 60, 5, 4)
    got = contigs(spark, [*reads, (9000, None), (9001, ""), (9002, "ACG"), (9003, genome[100:130] + "N" + genome[131:160])], 21)
    assert list(got) == [canonical(genome)]
    (row,) = got.values()
    assert row.n_kmers == 880 and row.coverage > 6


def test_repeats_part_contigs_and_rings_close(spark):
    rng = random.Random(12)
    repeat = bases(rng, 50)
    parts = [bases(rng, 150) for _ in range(3)]
    genome = parts[0] + repeat + parts[1] + repeat + parts[2]
    reads = [(i, genome[i : i + 40]) for i in range(len(genome) - 39)]
    got = contigs(spark, reads, 15, tip=0, bubble=0)
    assert len(got) == 4 and all(s in genome or reverse(s) in genome for s in got) and sum(r.n_kmers for r in got.values()) == len({canonical(genome[i : i + 15]) for i in range(len(genome) - 14)})
    ring = bases(rng, 200)
    twice = ring + ring
    (s,) = contigs(spark, [(i, twice[i : i + 40]) for i in range(200)], 15)
    assert len(s) == 214 and s[:14] == s[200:] and (s[:200] in twice or reverse(s[:200]) in twice)
    assert contigs(spark, [], 15) == {}


def test_a_weaker_allele_goes_and_so_do_ends_of_wrong_reads(spark):
    rng = random.Random(13)
    genome = bases(rng, 300)
    other = genome[:150] + ("A" if genome[150] != "A" else "C") + genome[151:]
    reads = [(i, genome[i : i + 40]) for i in range(0, 261, 2)] + [(1000 + i, other[i : i + 40]) for i in range(100, 170, 4)] + [(2000, genome[40:79] + ("A" if genome[79] != "A" else "C"))]
    assert list(contigs(spark, reads, 17)) == [canonical(genome)]
    both = contigs(spark, reads, 17, tip=34, bubble=0)  # without popping both alleles stay
    assert len(both) == 4


def test_valley(spark):
    rows = [("x", 1)] * 50 + [("x", 2)] * 9 + [("x", 3)] * 2 + [("x", 4)] * 6 + [("x", 5)] * 20
    df = spark.createDataFrame(rows, "kmer string, n long")
    assert am.valley(df) == 3 and am.valley(df.where("n > 3")) == 2 and am.valley(df.limit(0)) == 2


def test_wrong_bases_are_put_right_and_no_other(spark):
    rng = random.Random(14)
    genome = bases(rng, 2500)
    reads, truth = sampled(rng, genome, 80, 4, 3)
    reads = [(i, r) if i % 30 != 1 else (i, r[:10] + ("A" if r[10] != "A" else "C") + r[11:45] + ("G" if r[45] != "G" else "T") + r[46:]) for i, r in reads]  # some with more than one
    odd = [(10_000, None), (10_001, ""), (10_002, "acgt"), (10_003, bases(rng, 80))]
    df = spark.createDataFrame(reads + odd, "read_id long, seq string").repartition(3)
    got = {r.read_id: r for r in am.correct_reads(df, "read_id", 15).collect()}
    assert len(got) == len(reads) + 4 and got[10_000].seq is None and got[10_001].seq == "" and got[10_002].seq == "ACGT" and got[10_003].changes == 0
    wrong = fixed = spoilt = 0
    for (i, r), s in zip(reads, truth):
        wrong += sum(a != b for a, b in zip(r, s))
        fixed += sum(a != b and c == b for a, b, c in zip(r, s, got[i].seq))
        spoilt += sum(a == b and c != b for a, b, c in zip(r, s, got[i].seq))
        assert got[i].changes >= sum(a != c for a, c in zip(r, got[i].seq))
    assert wrong > 150 and fixed >= 0.95 * wrong and spoilt == 0


@pytest.mark.parametrize("seed", range(2))
def test_contigs_hold_only_what_reads_hold(spark, seed):
    rng = random.Random(seed)
    reads = [(i, bases(rng, 30)) for i in range(40)]
    words = {canonical(r[i : i + 11]) for _, r in reads for i in range(20)}
    got = contigs(spark, reads, 11, tip=0, bubble=0)
    assert {canonical(s[i : i + 11]) for s in got for i in range(len(s) - 10)} == words


def test_the_queries_undo_planted_errors(spark):
    sf = "/root/testdata/sf0.001"
    reads = {r.read_id: r for r in planted_reads(spark, sf).collect()}
    got = {r.read_id: r.seq for r in catalog.queries()["correct_reads"](spark, sf).collect()}
    wrong = [i for i, r in reads.items() if r.seq != r.truth]
    assert set(got) == set(reads) and len(wrong) > 50
    assert sum(got[i] == reads[i].truth for i in wrong) >= 0.95 * len(wrong) and all(got[i] == r.truth for i, r in reads.items() if r.seq == r.truth)
    words = {w for r in reads.values() for w in (r.truth[i : i + 21] for i in range(40))}
    found = [s[i : i + 21] for s in (r.seq for r in catalog.queries()["assemble_contigs"](spark, sf).collect()) for i in range(len(s) - 20)]
    assert sum(w in words or reverse(w) in words for w in found) >= 0.99 * len(found) and len(found) >= 0.9 * len({canonical(w) for w in words})


def test_gaps_longer_than_reads_are_filled(spark):
    rng = random.Random(15)
    genome, other, repeat = bases(rng, 1500), bases(rng, 600), bases(rng, 40)
    genome = genome[:600] + repeat + genome[640:760] + repeat + genome[800:]  # a repeat that the graph cannot tell apart by itself
    reads, _ = sampled(rng, genome + other, 60, 3, 9)
    df = spark.createDataFrame(reads, "read_id long, seq string")
    parts = [
        ("s", 0, genome[:200], "+", 0), ("s", 1, reverse(genome[420:560]), "-", 220), ("s", 2, genome[820:1000], "+", 260), ("s", 3, genome[1010:1100], "+", 10),
        ("t", 0, other[:100], "+", 0), ("t", 1, other[300:400], "+", 900), ("u", 0, genome[1200:1300], "+", 0), ("u", 1, other[450:550], "+", 150), ("v", 0, "ACG", "+", 0), ("v", 1, genome[1300:1400], "+", 100),
    ]
    got = {(r.scaffold, r.i): r for r in am.fill_gaps_by_graph(spark.createDataFrame(parts, "scaffold string, i long, seq string, orientation string, gap long"), df, "read_id", 21).collect()}
    assert set(got) == {("s", 1), ("s", 2)}
    assert got["s", 1].fill == genome[200:420] and got["s", 2].fill == genome[560:820] and got["s", 2].edges > 1


def test_the_query_fills_gaps_of_passages(spark):
    sf = "/root/testdata/sf0.001"
    genomes = {r.item_id: r.g for r in _passages(spark, sf).collect() if len(r.g) >= 260}
    got = {r.scaffold: r.fill for r in catalog.queries()["fill_gaps_by_graph"](spark, sf).collect()}
    assert len(got) >= 0.9 * len(genomes) > 0 and sum(got[i] == genomes[i][80:180] for i in got) >= 0.95 * len(got)
