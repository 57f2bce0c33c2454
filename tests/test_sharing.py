"""Sums over pairs of samples that share features against pairs taken one by one, and how many rows they shuffle."""

import random
from itertools import combinations

import pytest

from helixframe.operators import statistics as st

HOW = {
    "braycurtis": lambda x, y, both: 1 - 2 * sum(min(x[f], y[f]) for f in both) / (sum(x.values()) + sum(y.values())), "manhattan": lambda x, y, both: sum(x.values()) + sum(y.values()) - 2 * sum(min(x[f], y[f]) for f in both),
    "euclidean": lambda x, y, both: sum((x.get(f, 0) - y.get(f, 0)) ** 2 for f in {*x, *y}) ** 0.5, "jaccard": lambda x, y, both: 1 - len(both) / len({*x, *y}),
}


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    out = {f"s{i:02}": {f: float(rng.randint(1, 9)) for f in rng.sample(range(30), rng.randint(1, 12))} for i in range(40)}
    return out | {"wide": {f: 2.0 for f in range(30)}, "lone": {99: 1.0}}


@pytest.mark.parametrize("bundle", [7, 60, 10_000])
@pytest.mark.parametrize("metric", sorted(HOW))
def test_distances_whatever_the_bundles(spark, samples, metric, bundle, monkeypatch):
    rows = [(s, f, v) for s, own in samples.items() for f, v in own.items()] + [("wide", 50, 0.0), ("s01", 50, None), ("s02", None, 0.0)]
    df = spark.createDataFrame(rows, "sample string, feature int, value double").repartition(5)
    got = {(r.a, r.b): r.distance for r in st.beta_diversity(df, metric, bundle=bundle).collect()}
    want = {(a, b): HOW[metric](samples[a], samples[b], samples[a].keys() & samples[b].keys()) for a, b in combinations(sorted(samples), 2) if samples[a].keys() & samples[b].keys()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_crosstalk_and_empty_tables(spark, samples):
    df = spark.createDataFrame([(s, f) for s, own in samples.items() for f in own for _ in range(2)], "pathway string, gene int")
    got = {(r.a, r.b): (r.overlap, r.jaccard) for r in st.crosstalk(df, 4, bundle=20).collect()}
    pairs = {(a, b): len(samples[a].keys() & samples[b].keys()) for a, b in combinations(sorted(samples), 2)}
    assert got == {(a, b): (n, n / len({*samples[a], *samples[b]})) for (a, b), n in pairs.items() if n >= 4}
    assert st.crosstalk(df.limit(0)).collect() == []


def test_slices_of_pairs_add_up(spark, samples, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(st, "MET", 5)
    rows = pd.DataFrame([(s, i, 1.0, f, v) for i, (s, own) in enumerate(samples.items()) for f, v in own.items()], columns=["sample", "place", "n", "feature", "value"])
    held = st._Bundle(rows, st.np.fmin)
    later = rows.iloc[::-1].assign(sample=lambda x: "z" + x["sample"]).reset_index(drop=True)
    got = {(r.a, r.b): r.total for r in held.pairs(later, False).itertuples()}
    assert got == {(a, "z" + b): sum(min(samples[a][f], samples[b][f]) for f in samples[a].keys() & samples[b].keys()) for a in samples for b in samples if samples[a].keys() & samples[b].keys()}


def shuffled(spark) -> int:
    """Rows that all stages of the session have shuffled."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_are_shuffled_not_pairs(spark):
    df = spark.range(4000).selectExpr("id AS sample", "id div 40 AS feature", "1.0D AS value")
    before = shuffled(spark)
    assert st.beta_diversity(df).count() == 100 * 780
    assert shuffled(spark) - before < 40_000


def test_shuffle_files_go_before_pairs_are_taken(spark, samples, monkeypatch):
    from helixframe.operators import graph

    stored, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, *a, **k: stored.append(df.columns) or settled(df, *a, **k))
    df = spark.createDataFrame([(s, f, v) for s, own in samples.items() for f, v in own.items()], "sample string, feature int, value double")
    plan = st.beta_diversity(df, bundle=50)._jdf.queryExecution().executedPlan().toString()
    # rows that are dealt out stand in a table, which frees what was shuffled for it: one shuffle is left
    assert any("tasks" in c for c in stored) and plan.count("Exchange") == 1 and "Window" not in plan


def test_pairs_below_the_least_overlap_stay_in_their_task(samples):
    import pandas as pd

    rows = pd.DataFrame([(s, i, 1.0, f, v) for i, (s, own) in enumerate(samples.items()) for f, v in own.items()], columns=["sample", "place", "n", "feature", "value"])
    later = rows.assign(sample=lambda x: "z" + x["sample"])
    every, few = (st._Bundle(rows, st.np.multiply, least).pairs(later, False) for least in (None, 40.0))
    assert 0 < len(few) < len(every) and few.reset_index(drop=True).equals(every[every["total"] >= 40].reset_index(drop=True))
