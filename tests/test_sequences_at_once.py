"""Searches and alignments of many sequences at once against each sequence alone."""

import random
import time

import pytest

from helixframe.operators import sequences as ops

RNG = random.Random(5)
TEXTS = ["", "A", "N" * 30, "GAATTC", "GGGGAAACCCC", "ÄGß€€ßGÄ", "acgu", "GCGC" * 12] + ["".join(RNG.choice("ACGTN"[: RNG.choice([2, 4, 5])]) for _ in range(RNG.randint(0, 70))) for _ in range(60)]


def palindromes(seq, shortest=4, longest=20, gap=10):
    found = []
    for i in range(len(seq)):
        for g in range(0, gap + 1, 2):
            for arm in range(min(longest, (len(seq) - i - g) // 2), shortest - 1, -1):
                if seq[i : i + arm].translate(ops._REVERSE)[::-1] == seq[i + arm + g : i + 2 * arm + g]:
                    found.append((i, i + 2 * arm + g, arm, g))
                    break
    return found


def stems(seq, stem):
    s, found = seq.replace("T", "U"), []
    for size in range(stem, 15):
        for loop in range(3, 9):
            for i in range(len(s) - 2 * size - loop + 1):
                n = sum((s[i + k], s[i + 2 * size + loop - 1 - k]) in ops._PAIRS for k in range(size))
                if n >= size * 0.8:
                    found.append((i, i + 2 * size + loop, size, loop, n / size))
    return sorted(found)


@pytest.mark.parametrize("together", [1, 100, 200_000])
def test_searches(spark, monkeypatch, together):
    monkeypatch.setattr(ops, "TOGETHER", together)
    df = spark.createDataFrame([*enumerate(TEXTS), (-1, None)], "id long, seq string")
    upper = [t.upper() for t in TEXTS]
    assert sorted(map(tuple, ops.find_palindromes(df, "id").collect())) == sorted((k, *r) for k, s in enumerate(upper) for r in palindromes(s))
    assert sorted(map(tuple, ops.find_stem_loops(df, "id", stem=3).collect())) == sorted((k, *r) for k, s in enumerate(upper) for r in stems(s, 3))


@pytest.mark.parametrize("weights", [(2, -1, -2), (1, 0, -1), (1, -3, 0), (2.5, -1, -2)])
def test_alignments(weights):
    pairs = [(RNG.choice(TEXTS), RNG.choice(TEXTS)) for _ in range(120)]
    for local in (False, True):
        assert ops._aligned(*map(list, zip(*pairs)), *weights, local) == [ops.align(a, b, *weights, local) for a, b in pairs]


def test_many_short_sequences_take_little_time(spark):
    df = spark.range(0, 20_000, 1, 1).selectExpr("id", "translate(md5(CAST(id AS STRING)) || md5(CAST(-id AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq")
    began = time.perf_counter()
    assert ops.find_stem_loops(df, "id", stem=6).count() > 20_000
    assert time.perf_counter() - began < 20


SIGNED = [t for t in TEXTS if t] + ["A$B", "$", "$$!$$", "ABAB" * 40, "x" * 90]


@pytest.mark.parametrize("together", [1, 100, 200_000])
def test_suffixes(spark, monkeypatch, together):
    monkeypatch.setattr(ops, "TOGETHER", together)
    df = spark.createDataFrame([*enumerate([*SIGNED, ""]), (-1, None)], "id long, seq string")

    def ranked(s):  # places by their characters and the end sign, a rest before what goes on from it
        return sorted(range(len(s) + 1), key=lambda i: [ord(c) for c in s[i:] + "$"])

    got = sorted((r.id, r.rank, r.pos, r.bwt) for r in ops.suffix_array(df, "id").collect())
    assert got == [(k, rank, i, (s + "$")[i - 1]) for k, s in enumerate([*SIGNED, ""]) for rank, i in enumerate(ranked(s))]
    want = {}
    for k, s in enumerate(SIGNED):
        n = max(n for n in range(len(s)) if n == 0 or any(s.find(s[i : i + n], i + 1) >= 0 for i in range(len(s) - n)))
        want[k] = (n, min(s[i : i + n] for i in range(len(s) - n + 1) if n == 0 or s.find(s[i : i + n], i + 1) >= 0))
    assert {r.id: (r.length, r.repeat) for r in ops.longest_repeat(df, "id").collect()} == want


def test_suffixes_are_not_shuffled(spark):
    df = spark.createDataFrame(list(enumerate(SIGNED)), "id long, seq string")
    assert "Exchange" not in ops.longest_repeat(df, "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least, seed", [(2, 4), (3, 3), (4, 2), (6, 16)])
def test_overlaps(spark, least, seed):
    core = "".join(RNG.choice("ACGT") for _ in range(80))
    reads = {k: s for k, s in enumerate([*TEXTS, *(core[i : i + RNG.randint(5, 40)] for i in range(0, 60, 3)), core, core])}
    df = spark.createDataFrame([*reads.items(), (-1, None)], "id long, seq string")
    want = {}
    for a, s in reads.items():
        for b, t in reads.items():
            n = [n for n in range(least, min(len(s), len(t))) if a != b and s.endswith(t[:n])]
            want |= {(a, b): max(n)} if n else {}
    assert {(r.a, r.b): r.overlap for r in ops.overlap_edges(df, "id", least, seed=seed).collect()} == want


def test_overlaps_meet_by_whole_suffixes(spark):
    df = spark.createDataFrame([(k, "C" + "A" * 12 + f"{k:06}".translate(str.maketrans("0123456789", "GTGTGTGTGT"))) for k in range(50)] + [(99, "AAAAAAT")], "id long, seq string")
    plan = ops.overlap_edges(df, "id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "k#" in plan[plan.index("Join Inner") :].split("\n")[0] and "bases#" in plan[plan.index("Join Inner") :].split("\n")[0]


def test_equal_cigars_are_counted_first(spark):
    from helixframe import catalog

    plan = catalog.queries()["aligned_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]
