"""Reads on contigs against brute force."""

import random

import pytest

from helixframe.operators import mapping as mp

_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def reverse(s):
    return s.translate(_COMPLEMENT)[::-1]


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def changed(rng, s, n):
    out = list(s)
    for i in rng.sample(range(len(s)), n):
        out[i] = rng.choice([c for c in "ACGT" if c != out[i]])
    return "".join(out)


def brute(reads, contigs, most, both=True):
    found = set()
    for r, s in reads:
        s = (s or "").upper()
        for strand, x in (("+", s), ("-", reverse(s)))[: 1 + both]:
            if len(x) > most:
                for c, t in contigs:
                    t = (t or "").upper()
                    for i in range(len(t) - len(x) + 1):
                        d = 0
                        for a, b in zip(x, t[i : i + len(x)]):
                            d += a != b
                            if d > most:
                                break
                        else:
                            found.add((r, c, i, strand, d))
    return found


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(3)
    repeat = bases(rng, 60)
    contigs = [("c1", bases(rng, 900) + repeat + bases(rng, 700) + repeat), ("c2", "A" * 120 + bases(rng, 300) + reverse(repeat)), ("c3", ""), ("c4", None), ("c5", "ACG"), ("c6", "N" * 30 + bases(rng, 50).lower())]
    return rng, contigs, repeat


def frames(spark, reads, contigs):
    return spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(contigs, "contig string, seq string")


def test_all_places_are_found(spark, genome, monkeypatch):
    monkeypatch.setattr(mp, "CHUNK", 90)  # reads across the joints of chunks
    rng, contigs, repeat = genome
    reads = [(0, None), (1, ""), (2, "AC"), (3, "ACG"), (4, "A" * 30), (5, repeat[:40]), (6, reverse(repeat)[:37]), (7, "n" * 12), (8, "A" * 119 + "C")]
    for k in range(9, 400):
        c = contigs[rng.randrange(2)][1]
        n = rng.choice([4, 9, 20, 36, 50, 130])
        i = rng.randrange(len(c) - n)
        s = changed(rng, c[i : i + n], min(rng.randrange(5), n))
        reads.append((k, reverse(s) if rng.random() < 0.5 else s))
    r, c = frames(spark, reads, contigs)
    got = {(x.read_id, x.contig, x.start, x.strand, x.mismatches) for x in mp.placements(r, c).collect()}
    want = brute(reads, contigs, 2)
    assert got == want and len(got) > 500
    best = {x.read_id: x for x in mp.best_placements(mp.placements(r, c)).collect()}
    for k, row in best.items():
        own = sorted((d, c, i, s) for q, c, i, s, d in want if q == k)
        assert (row.mismatches, row.contig, row.start, row.strand) == own[0] and row.n_places == len(own) and row.n_best == sum(o[0] == own[0][0] for o in own) and row.quality == 60 - 10 * row.mismatches
    assert set(best) == {w[0] for w in want} and mp.placements(r.limit(0), c).collect() == []
    assert {(x.read_id, x.contig, x.start, x.mismatches) for x in mp.placements(r, c, most=0, both=False).collect()} == {(q, c, i, d) for q, c, i, s, d in brute(reads, contigs, 0, False)}


def test_pairs_and_introns(spark, genome):
    rng, contigs, repeat = genome
    long = contigs[0][1]
    one, two = [], []
    for k in range(120):
        i, gap = rng.randrange(len(long) - 400), rng.choice([20, 70, 150, 300])
        one.append((k, changed(rng, long[i : i + 30], rng.randrange(3))))
        two.append((k, reverse(changed(rng, long[i + gap : i + gap + 30], rng.randrange(3)))))
    one.append((200, repeat[:30])), two.append((200, reverse(repeat[30:])))
    a, c = frames(spark, one, contigs)
    b, _ = frames(spark, two, contigs)
    pa, pb = brute(one, contigs, 2), brute(two, contigs, 2)
    want = {}
    for q, c1, i, s, d in pa:
        for q2, c2, j, s2, d2 in pb:
            if q == q2 and c1 == c2 and s != s2 and 100 <= abs(j - i) + 30 <= 300:
                want[q] = min(want.get(q, (9,)), (d + d2, c1, i, j, s, s2, j - i + 30))
    got = {x.read_id: (x.mismatches, x.contig, x.start1, x.start2, x.strand1, x.strand2, x.template) for x in mp.concordant_pairs(mp.placements(a, c), mp.placements(b, c), most=300).collect()}
    assert got == want and len(got) > 30

    exons = [bases(rng, 80) for _ in range(3)]
    gene = exons[0] + "GT" + bases(rng, 400) + "AG" + exons[1] + "CC" + bases(rng, 100) + "AG" + exons[2]
    reads = [(1, exons[0][-20:] + exons[1][:20]), (2, exons[1][-20:] + exons[2][:20]), (3, exons[0][:40]), (4, changed(rng, exons[0][-25:], 2) + exons[1][:25]), (5, None)]
    r, c = frames(spark, reads, [("g", gene), ("h", None)])
    got = {x.read_id: (x.start, x.intron_start, x.intron_end, x.cigar, x.mismatches) for x in mp.spliced(r, c).collect()}
    assert got == {1: (60, 80, 484, "20M404N20M", 0), 4: (55, 80, 484, "25M404N25M", 2)}


def test_contigs_guided_by_a_reference(spark):
    rng = random.Random(16)
    reference = bases(rng, 1200)
    sample = list(reference)
    for i in range(50, 1200, 90):  # the sample differs here and there
        sample[i] = "A" if sample[i] != "A" else "C"
    sample = "".join(sample)
    reads = []
    for k, i in enumerate([*range(0, 500, 7), *range(560, 640, 40), *range(700, 1150, 9)]):
        s = sample[i : i + 50]
        reads.append((k, reverse(s) if k % 3 == 0 else s))
    reads += [(900, bases(rng, 50)), (901, None)]
    r, c = frames(spark, reads, [("ref", reference), ("none", "")])
    piles = {}
    places = {(q, i, s) for q, n, i, s, d in brute(reads, [("ref", reference)], 2)}
    for q, i, s in places:
        text = dict(reads)[q]
        for j, b in enumerate(reverse(text) if s == "-" else text):
            piles.setdefault(i + j, []).append(b)
    want, run = [], []
    for p in range(1202):
        if len(piles.get(p, [])) >= 2:
            run.append(p)
        else:
            if len(run) >= 200:
                want.append((run[0], run[-1] + 1, "".join(min(set(piles[x]), key=lambda b: (-piles[x].count(b), b)) for x in run)))
            run = []
    got = sorted((x.start, x.end, x.seq) for x in mp.guided_contigs(r, c).collect())
    assert len(places) == len({q for q, _, _ in places}) and got == want and len(got) == 2 and all(s == sample[a:b] for a, b, s in got)


def test_only_windows_that_seeds_may_equal_are_shuffled(spark):
    """Windows without a seed never leave their task, and a repeat's windows are dropped in the join unless what is beside them fits."""
    rng = random.Random(11)
    odd = "AC" * 8 + bases(rng, 32)
    reads, contigs = [(1, odd), (2, "AC" * 24)], [("c1", "AC" * 300 + odd + bases(rng, 3000)), ("c2", bases(rng, 5000))]
    r, c = frames(spark, reads, contigs)
    rows = mp._strands(r, "read_id", "seq", True).selectExpr("*", "16 AS width")
    seeds = mp._seeds(rows, 20)
    places = mp._places(c, "contig", "seq", [16], mp._held(seeds, 20), 20).cache()
    at = {(x.contig, x.at) for x in places.collect()}
    assert len(at) < 700 and {("c1", 0), ("c1", 600), ("c1", 616), ("c1", 632)} <= at
    assert {(x.read_id, x.contig, x.start, x.strand, x.mismatches) for x in mp.placements(r, c).collect()} == brute(reads, contigs, 2)


def test_characters_of_any_kind_count_as_themselves(spark):
    text = "ÄNA*ÄNN\U0001f9ecAC" * 3 + "ACGTNNÖÄ*A" * 3
    reads, contigs = [(1, text[5:41]), (2, text[20:56].replace("*", "A", 1))], [("c1", text), ("c2", "G" * 40 + text)]
    r, c = frames(spark, reads, contigs)
    got = {(x.read_id, x.contig, x.start, x.strand, x.mismatches) for x in mp.placements(r, c, both=False).collect()}
    assert got == brute(reads, contigs, 2, both=False) and got
