"""Reads on contigs by distinct windows, against lists of all places."""

import random

import pytest

from helixframe.operators import mapping as mp
from helixframe.operators import sites


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def changed(rng, s, n):
    s = list(s)
    for i in rng.sample(range(len(s)), n):
        s[i] = rng.choice([b for b in "ACGT" if b != s[i].upper()])
    return "".join(s)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = text(120)
    contigs = [text(700), text(40) + shared + text(90) + shared, shared + "AC" * 90 + text(30), "N" * 5 + text(60) + "NRN" + text(200) + "AC" * 60, ("ac" * 80).lower() + text(50), text(30), "A" * 100 + text(90), "", None, shared + text(100)]
    return contigs


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(mp, "CHUNK", 97)
    monkeypatch.setattr(sites, "CHUNK", 97)
    monkeypatch.setattr(sites, "TOGETHER", 50)


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def contig_frame(spark, genome):
    return frame(spark, list(enumerate(genome)), "contig long, seq string")


def test_best_places(spark, genome, small):
    rng = random.Random(5)
    reads = []
    for length in (48, 48, 48, 48, 30, 5, 100, 64):
        for c in genome:
            if c and len(c) >= length:
                i = rng.choice([0, len(c) - length, rng.randrange(len(c) - length + 1)])
                s = changed(rng, c[i : i + length].upper(), rng.randrange(4))
                reads.append(reverse(s) if rng.random() < 0.4 else s)
    reads += ["AC" * 24, "CA" * 24, "AC" * 20 + "AT" * 4, "", None, "AC", genome[3][:60], genome[3][50:98].upper().replace("R", "A"), "A" * 48, "T" * 30, genome[0][:260], genome[0][3:200]]
    r, c = frame(spark, list(enumerate(reads)), "read_id long, seq string"), contig_frame(spark, genome)
    for most, both in ((2, True), (0, False)):
        assert same(mp.best_places(r, c, most=most, both=both), mp.best_placements(mp.placements(r, c, most=most, both=both)))
    assert mp.best_places(r.limit(0), c).collect() == []


def test_best_pairs(spark, genome, small):
    rng = random.Random(6)
    pairs = []
    for k in range(60):
        c = rng.choice([c for c in genome if c and len(c) > 150]).upper()
        i = rng.randrange(len(c) - 150)
        j = i + rng.choice([10, 60, 80, 102])
        one, two = changed(rng, c[i : i + 48].replace("N", "A").replace("R", "A"), rng.randrange(3)), reverse(c[j : j + 48])
        pairs.append((k, reverse(one), two if k % 9 else reverse(two)) if k % 2 else (k, one, two))
    pairs += [(100, "AC" * 24, "GT" * 24), (101, "AC" * 24, None), (102, "AC" * 24, "GT" * 23 + "GN"), (103, "", "A")]
    p, c = frame(spark, pairs, "read_id long, one string, two string"), contig_frame(spark, genome)
    for least, apart, opposite in ((100, 1000, True), (20, 120, False), (60, 130, True)):
        places = [mp.placements(p.selectExpr("read_id", f"{x} AS seq"), c) for x in ("one", "two")]
        want = mp.concordant_pairs(*places, least=least, most=apart, opposite=opposite)
        assert same(mp.best_pairs(p, c, least=least, apart=apart, opposite=opposite), want)


def test_spliced(spark, small):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    gene = text(60) + "GT" + text(80) + "AG" + text(60)
    contigs = [text(50) + gene, gene[:40] + "N" + gene[41:] + gene, "ACGT" * 30 + "AG" * 40 + "GT" * 50 + "AG" * 40, text(100)]
    reads = [gene[12:60] + gene[144:192], changed(rng, gene[12:60], 1) + gene[144:192], gene[30:60] + gene[144:175], gene[:90], contigs[2][60:108] + contigs[2][240:288], "AG" * 48, gene[12:60] + gene[144:191] + "N", None, "A"]
    r, c = frame(spark, list(enumerate(reads)), "read_id long, seq string"), frame(spark, list(enumerate(contigs)), "contig long, seq string")
    for intron in ((50, 500_000), (10, 200)):
        whole = mp.placements(r, c, both=False).select("read_id").distinct()
        halves = r.join(whole, "read_id", "left_anti").selectExpr("read_id AS read", "substr(seq, 1, length(seq) div 2) AS one", "substr(seq, length(seq) div 2 + 1) AS two")
        want = mp._spliced_by_places(halves, c, "read_id", "contig", "seq", 2, intron)
        assert want.count() > 2 and same(mp.spliced(r, c, intron=intron), want)


def test_a_repeat_costs_no_row_for_each_read_and_place(spark, monkeypatch):
    unit = "ACGGTCT"
    contigs = frame(spark, [(i, unit * 60) for i in range(200)], "contig long, seq string")
    pairs = frame(spark, [(i, (unit * 20)[i % 7 :][:48], reverse((unit * 60)[i % 7 + 100 :][:48])) for i in range(100)], "read_id long, one string, two string")
    offers = sites._offers(pairs.selectExpr("one AS seq").distinct(), contigs, "contig", "seq", 2, True, 3)
    assert offers.count() <= 7 * 500  # 100 reads have 53 places or so in each of 200 contigs
    monkeypatch.setattr(mp, "placements", lambda *a, **b: pytest.fail("all places are listed"))
    reads = pairs.selectExpr("read_id", "one AS seq")
    assert {(x.n_places, x.contig, x.start) for x in mp.best_places(reads, contigs).collect()} == {(200 * sum((s - i) % 7 == 0 for s in range(420 - 47)), 0, i) for i in range(7)}
    assert {(x.contig, x.start1, x.mismatches) for x in mp.best_pairs(pairs, contigs).collect()} == {(0, i, 0) for i in range(7)}
