"""Molecules, simulations, Boolean networks, registry and pipelines."""

import math

import numpy as np
import pytest

from helixframe import registry
from helixframe.operators import molecules as mol
from helixframe.operators import simulation as sim


def decay():
    return sim.RateModel({"A": 10.0, "B": 0.0}, {"k": 0.5}, [("k * A", {"A": -1.0, "B": 1.0})])


def test_rate_model():
    times = [0.1 * i for i in range(41)]
    found = decay().simulate(times)
    assert found[-1, 0] == pytest.approx(10 * math.exp(-2.0), rel=1e-5) and np.allclose(found.sum(axis=1), 10)
    grow = sim.RateModel({"A": 0.0}, {"s": 2.0, "d": 0.5}, [("s - d * A", {"A": 1.0})])
    state = grow.steady_state()
    assert state[0] == pytest.approx(4.0, rel=1e-4) and grow.eigenvalues(state).real.max() == pytest.approx(-0.5, rel=1e-3)
    with pytest.raises(ValueError):
        sim.compiled("__import__('os')")


def test_grids_and_sensitivity(spark):
    grid = spark.createDataFrame([(1, 0.5), (2, 1.0)], "run int, k double")
    times = [0.1 * i for i in range(21)]
    rows = {(r.run, r.species): r.amount for r in sim.simulate_grid(decay(), grid, times).where(f"time = {times[-1]}").collect()}
    assert rows[2, "A"] == pytest.approx(10 * math.exp(-2.0), rel=1e-4)
    s = sim.local_sensitivity(decay(), spark, times, "A").first()
    assert s.parameter == "k" and s.sensitivity == pytest.approx(-1.0, abs=0.02)


def test_boolean(spark):
    rules = {"A": ("OR", [("B", 1)]), "B": ("OR", [("A", 1)])}
    found = {(r.attractor, r.period, r.basin) for r in sim.attractors(rules, spark).collect()}
    assert found == {(0, 1, 1), (3, 1, 1), (1, 2, 2)}
    table = spark.createDataFrame([("B", "A", 1, "AND"), ("B", "C", -1, "AND")], "target string, source string, sign int, logic string")
    states = spark.createDataFrame([(0, "A", True), (0, "B", False), (0, "C", False)], "run int, node string, value boolean")
    assert {r.node: r.value for r in sim.boolean_step(table, states).collect()} == {"A": True, "B": True, "C": False}


def test_molecules(spark):
    atoms = spark.createDataFrame([("w", 1, "O", 0.0, 0.0, 0.0), ("w", 2, "H", 0.96, 0.0, 0.0), ("w", 3, "H", -0.24, 0.93, 0.0), ("w", 4, "C", 9.0, 9.0, 9.0)], "molecule string, serial int, element string, x double, y double, z double")
    assert mol.formula(atoms).first().formula == "CH2O"
    assert {(b.i, b.j) for b in mol.bonds(atoms).collect()} == {(1, 2), (1, 3)} and mol.distances(atoms).count() == 6
    assert mol.center_of_mass(atoms.where("serial < 4"), "molecule").first().mass == pytest.approx(18.015)
    frames = spark.createDataFrame([(f, a, float(a + f), 0.0, 0.0) for f in (0, 1) for a in (0, 1)], "frame int, atom int, x double, y double, z double")
    reference = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "atom int, x double, y double, z double")
    assert [r.rmsd for r in mol.rmsd(frames, reference).collect()] == [0.0, 0.0] and {r.rmsf for r in mol.rmsf(frames).collect()} == {0.5}
    assert {r.distance for r in mol.atom_distance(frames, 0, 1).collect()} == {1.0} and {r.radius for r in mol.radius_of_gyration(frames).collect()} == {0.5}


def test_registry_and_pipeline(spark):
    known = registry.default_registry()
    assert known.get("Proteomics").category == "core" and len(known.list_modules("specialized")) == 5
    with pytest.raises(ValueError):
        known.register(registry.Module("PROTEOMICS", "core"))
    df = spark.range(10)
    flow = registry.Pipeline([registry.PipelineStep("even", lambda x: x.where("id % 2 = 0")), registry.PipelineStep("broken", lambda x: 1 / 0, required=False), registry.PipelineStep("first", lambda x: x.where("id < 5"), after=("even",))])
    assert flow.run(df).count() == 3 and [s for _, s in flow.log][0] == "done" and flow.log[1][1].startswith("failed")
    with pytest.raises(ValueError):
        flow.run(df, skip=("even",))
