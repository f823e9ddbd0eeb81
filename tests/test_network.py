import numpy as np
import pytest
from pyspark.sql import functions as F

from atomspan.operators import network, spatial

ATOM = "sid int, aid int, species string, x double, y double, z double"
SPINS, SETTINGS = {"A": -1, "B": 1}, (4.0, 2, 3.5, 2)


def model():
    r = np.random.default_rng(0)
    n = 2 * (SETTINGS[1] + SETTINGS[3] + 2)
    return {s: [(r.normal(size=(n, 4)), r.normal(size=4), "tanh"), (r.normal(size=(4, 1)), r.normal(size=1), "linear")] for s in "AB"}


def featured(spark, xyz, n=1):
    rows = [(k, i, "AABA"[i], *map(float, p)) for k, x in enumerate(xyz) for i, p in enumerate(x)]
    atoms = spark.createDataFrame(rows, ATOM)
    found = spatial.edges(atoms, 4.0)
    return network.atom_energies(spatial.descriptors(atoms, found, *SETTINGS, SPINS), model()), found


def test_forces_equal_finite_differences(spark):
    base = np.array([[0, 0, 0], [1.5, 0.2, 0.1], [0.3, 1.7, -0.2], [-0.9, 0.6, 1.3]])
    h, moved = 1e-5, [base]
    for i in range(4):
        for c in range(3):
            for s in (1, -1):
                m = base.copy()
                m[i, c] += s * h
                moved.append(m)
    atoms, found = featured(spark, moved)
    e = {r.sid: r.energy for r in network.energies(atoms).collect()}
    want = np.array([-(e[1 + 2 * k] - e[2 + 2 * k]) / (2 * h) for k in range(12)]).reshape(4, 3)
    first, near = atoms.where("sid = 0"), found.where("sid = 0")
    got = network.forces(first, network.gradients(near, *SETTINGS, SPINS)).orderBy("aid").collect()
    assert np.allclose([[r.fx, r.fy, r.fz] for r in got], want, atol=1e-5)
    direct = network.contracted_forces(first, near, *SETTINGS, SPINS).orderBy("aid").collect()
    assert np.allclose([[r.fx, r.fy, r.fz] for r in direct], [[r.fx, r.fy, r.fz] for r in got], atol=1e-10)


def test_whole_structures_have_the_forces_of_joins(spark):
    rng = np.random.default_rng(6)
    data = [(s, i, "AAB"[int(rng.integers(3))], *map(float, rng.random(3) * side)) for s, (k, side) in enumerate([(1, 1), (2, 2), (9, 4), (27, 7), (28, 7), (60, 9), (3, 30)]) for i in range(k)]
    data += [(7, k, "A", float(k), 0.0, 0.0) for k in range(4)] + [(8, 0, "B", 0.0, float(k), 0.0) for k in range(3)]
    atoms = spark.createDataFrame(data, ATOM).repartition(3)
    for spins, names in ((SPINS, "AB"), ({"A": 1}, "A")):
        kept = atoms.where(F.col("species").isin(*names))
        n = (SETTINGS[1] + SETTINGS[3] + 2) * len(names)
        layers = {s: [(rng.normal(size=(n, 4)), rng.normal(size=4), "tanh"), (rng.normal(size=(4, 1)), rng.normal(size=1), "linear")] for s in names}
        single = kept.where("sid != 8")
        found = spatial.edges(single, 4.0)
        full = network.atom_energies(spatial.descriptors(single, found, *SETTINGS, spins, 0.01), layers)
        want = {(r.sid, r.aid): (r.fx, r.fy, r.fz) for r in network.contracted_forces(full, found, *SETTINGS, spins, 0.01).collect()}
        got = network.structure_forces(kept, layers, spins, SETTINGS, 0.01).collect()
        assert len(got) == kept.count() and all((r.fx, r.fy, r.fz) == (0, 0, 0) for r in got if r.sid == 8)
        mine = {(r.sid, r.aid): (r.fx, r.fy, r.fz) for r in got if r.sid != 8}
        assert set(mine) == set(want) and np.allclose([mine[k] for k in want], list(want.values()), atol=1e-8)
    with pytest.raises(Exception, match="no typespin"):
        network.structure_forces(atoms, layers | {"B": layers["A"]}, {"A": 1, "C": 2}, SETTINGS, 0.01).collect()


def test_small_structures_are_shuffled_once(spark):
    atoms = spark.createDataFrame([(s, i, "A", float(i), 0.0, 0.0) for s in range(9) for i in range(3)], ATOM).repartition("sid").dropDuplicates(["sid", "aid"])
    plan = network.structure_forces(atoms, model(), SPINS, SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1 and "Join" not in plan
