"""Networks fused in blocks against those of whole matrices."""

import numpy as np
import pytest

from helixframe.operators import fusion
from helixframe.operators import integration as ig


def cells(rng, cohort, samples, layers=2):
    return [(cohort, f"b{v}", s, f, float(x)) for v in range(layers) for s in samples for f, x in enumerate(rng.normal(size=3 + v) + s % 3)]


@pytest.mark.parametrize("block, layers", [(7, 2), (512, 2), (5, 3)])
def test_blocks_are_the_whole_matrix(spark, monkeypatch, block, layers):
    monkeypatch.setattr(fusion, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = cells(rng, "x", range(23), layers) + cells(rng, "y", range(100, 112), layers)
    rows = [r for r in rows if not (r[0] == "x" and r[1] == "b1" and r[2] in (20, 21, 22))]  # samples without one layer
    df = spark.createDataFrame(rows, "cohort string, block string, sample long, feature long, value double").repartition(4)
    got = {(r.cohort, r.src, r.dst): r.weight for r in fusion.fused_network(df, 4, 3).collect()}
    want = {(r.cohort, r.src, r.dst): r.weight for r in ig.similarity_network(df, "cohort", 4, 3).collect()}
    assert set(got) == set(want) and len([k for k in got if k[0] == "x"]) == 23 * 22 // 2
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    mixed = {(r.cohort, r.src, r.dst): r.weight for r in ig.similarity_network(df, "cohort", 4, 3, most=15).collect()}
    assert set(mixed) == set(want) and all(mixed[k] == pytest.approx(want[k], rel=1e-9) for k in want)
