"""What runs along a sequence, cut into short stretches, against brute force in one go."""

import random
from itertools import groupby

import pytest

from helixframe.operators import intervals as iv


@pytest.fixture(params=[9, 64])
def rows(request, monkeypatch):
    monkeypatch.setattr(iv, "SPAN", request.param)
    rng = random.Random(request.param)
    return [(rng.choice("ab"), s, s + rng.choice([1, 3, 9, 40, 200]), rng.randrange(30)) for s in (rng.choice([rng.randrange(300), 500 + rng.randrange(900)]) for _ in range(150))]


def of_key(rows):
    return [(k, list(x)) for k, x in groupby(sorted(rows), key=lambda r: r[0])]


def test_merged_across_stretches(spark, rows):
    for gap in (0, 5):
        want = []
        for k, x in of_key(rows):
            for _, s, e, _ in x:
                if want and want[-1][0] == k and s <= want[-1][2] + gap:
                    want[-1][2:] = [max(e, want[-1][2]), want[-1][3] + 1]
                else:
                    want.append([k, s, e, 1])
        got = iv.merged(spark.createDataFrame(rows, "ref string, start long, end long, score long"), "ref", gap=gap).collect()
        assert sorted(map(list, got)) == want


def test_depth_across_stretches(spark, rows):
    want = []
    for k, x in of_key(rows):
        at = sorted({p for r in x for p in r[1:3]})
        want += [(k, a, b, sum(r[1] <= a < r[2] for r in x)) for a, b in zip(at, at[1:])]
    assert sorted(map(tuple, iv.depth_steps(spark.createDataFrame(rows, "ref string, start long, end long, score long"), "ref").collect())) == sorted(want)


def test_sweep_across_stretches(spark, rows):
    want = []
    for k, x in of_key(rows):
        kept = []
        for r in x:
            if kept and kept[-1][2] - r[1] > 5:
                kept[-1] = max(kept[-1], r, key=lambda v: v[3])
            else:
                kept.append(r)
        want += kept
    assert sorted(map(tuple, iv.best_non_overlapping(spark.createDataFrame(rows, "ref string, start long, end long, score long"), "ref", 5).collect())) == sorted(want)


def test_synteny_across_stretches(spark, rows):
    rng = random.Random(2)
    pairs = sorted((r[0], r[1], "x", r[1] + rng.choice([0, 1, 5, -9, 60])) for r in rows)
    want = []
    for k, x in of_key(pairs):
        blocks, before = [], None
        for i, r in enumerate(x):
            step = None if not i else (r[3] > x[i - 1][3]) - (r[3] < x[i - 1][3])
            turned = i > 1 and step != before
            if not i or turned or r[1] - x[i - 1][1] > 30 or abs(r[3] - x[i - 1][3]) > 30:
                blocks.append([])
            blocks[-1].append(r)
            before = step
        want += [(k, "x", n, len(b), b[0][1], b[-1][1], min(r[3] for r in b), max(r[3] for r in b), b[-1][3] >= b[0][3]) for n, b in enumerate(blocks) if len(b) >= 2]
    assert sorted(map(tuple, iv.synteny_blocks(spark.createDataFrame(pairs, "chrom1 string, pos1 long, chrom2 string, pos2 long"), 30, 2).collect())) == want
