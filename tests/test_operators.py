import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomspan.functions import scalars as S
from atomspan.operators import diversity, energies, generators, spatial, trajectory

ATOM = "sid int, aid int, species string, x double, y double, z double"


def rows(spark, *atoms, sid=1):
    return spark.createDataFrame([(sid, i, *a) for i, a in enumerate(atoms)], ATOM)


def test_dimer_has_one_neighbour_each(spark):
    found = spatial.edges(rows(spark, ("H", 0.0, 0.0, 0.0), ("H", 2.0, 0.0, 0.0)), 2.5).collect()
    assert sorted((r.i, r.j, r.d) for r in found) == [(0, 1, 2.0), (1, 0, 2.0)]


def test_shells_of_fcc(spark):
    a = 4.0
    atoms = rows(spark, ("Cu", 0.0, 0.0, 0.0), ("Cu", 0.0, 2.0, 2.0), ("Cu", 2.0, 0.0, 2.0), ("Cu", 2.0, 2.0, 0.0))
    found = spatial.periodic_edges(atoms, 1.25 * a, cell=[[a, 0, 0], [0, a, 0], [0, 0, a]])
    n = {round(r.d, 3): r.n for r in found.where("i = 0").groupBy(F.round("d", 6).alias("d")).agg(F.count("*").alias("n")).collect()}
    assert n == {round(a / math.sqrt(2), 3): 12, 4.0: 6, round(a * math.sqrt(1.5), 3): 24}


def test_periodic_neighbours_equal_those_of_a_supercell(spark):
    rng = np.random.default_rng(1)
    cell = [[5.0, 0.0, 0.0], [1.0, 4.0, 0.0], [0.5, 0.7, 6.0]]
    frac = rng.random((4, 3))
    atoms = rows(spark, *[("A", *p) for p in (frac @ np.array(cell)).tolist()])
    got = {(r.i, r.j, r.ox, r.oy, r.oz) for r in spatial.periodic_edges(atoms, 4.5, cell=cell).collect()}
    want = set()
    for i in range(4):
        for j in range(4):
            for o in np.ndindex(7, 7, 7):
                o = np.array(o) - 3
                d = np.linalg.norm((frac[j] + o - frac[i]) @ np.array(cell))
                if d <= 4.5 and (i != j or o.any()):
                    want.add((i, j, *map(int, o)))
    assert got == want


def test_open_axes_have_no_images(spark):
    atoms = rows(spark, ("H", 0.1, 0.0, 0.0), ("H", 3.9, 0.0, 5.0))
    found = spatial.periodic_edges(atoms, 2.0, cell=[[4.0, 0, 0], [0, 4.0, 0], [0, 0, 4.0]], pbc=(True, False, False))
    assert found.count() == 0


def test_descriptor_of_a_triangle(spark):
    h = math.sqrt(3)
    atoms = rows(spark, ("A", 0.0, 0.0, 0.0), ("A", 2.0, 0.0, 0.0), ("B", 1.0, h, 0.0))
    got = spatial.descriptors(atoms, spatial.edges(atoms, 4.0), 4.0, 1, 4.0, 1, {"A": -1, "B": 1}).where("aid = 0").first().fingerprint
    fc = 0.5 * (math.cos(math.pi / 2) + 1)
    assert np.allclose(got, [2 * fc, 0, fc**2, 0.5 * fc**2, 0, 0, -(fc**2), -0.5 * fc**2], atol=1e-12)


def test_typespins():
    assert [S.typespins(n) for n in (1, 2, 3, 4)] == [[0], [-1, 1], [-1, 0, 1], [-2, -1, 1, 2]]


def test_two_frames_of_msd(spark):
    p = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 3.0)], "pid int, frame int, x double")
    assert {r.lag: r.msd for r in trajectory.msd(p, 2).collect()} == {0: 0.0, 1: 2.5, 2: 9.0}


def test_unwrap_follows_a_constant_step(spark):
    p = spark.createDataFrame([(1, t, (7.0 * t) % 10) for t in range(6)], "pid int, frame int, x double")
    assert [r.x for r in trajectory.unwrap(p, 10.0).orderBy("frame").collect()] == [0.0, -3.0, -6.0, -9.0, -12.0, -15.0]


def test_reference_energies_are_recovered_and_rank_is_checked(spark):
    c = spark.createDataFrame([(1, 0, 1.0), (0, 1, 2.0), (2, 1, 4.0)], "n_A int, n_B int, energy double")
    assert energies.fit_reference_energies(c, ["A", "B"]) == pytest.approx({"A": 1.0, "B": 2.0})
    assert energies.fit_reference_energies(c, ["A", "B"], fixed={"A": 1.0}) == pytest.approx({"A": 1.0, "B": 2.0})
    with pytest.raises(ValueError):
        energies.fit_reference_energies(c.select("n_A", (F.col("n_A") * 2).alias("n_B"), "energy"), ["A", "B"])


def test_strains_keep_the_volume(spark):
    cube = rows(spark, ("A", 1.0, 0.0, 0.0), ("A", 0.0, 1.0, 0.0), ("A", 0.0, 0.0, 1.0))
    for made in (generators.uniaxial(cube, "x", 0.9, 1.1, 3, True), generators.orthorhombic(cube, -0.1, 0.1, 3), generators.monoclinic(cube, -0.1, 0.1, 3), generators.shear(cube, "xy", 0.0, 0.2, 3)):
        for step in range(3):
            m = np.array([[r.x, r.y, r.z] for r in made.where(F.col("step") == step).orderBy("aid").collect()])
            assert np.linalg.det(m) == pytest.approx(1.0)


def test_kabsch_finds_a_rotation(spark):
    a = rows(spark, ("A", 1.0, 0.2, 0.0), ("A", 0.0, 1.0, 0.3), ("A", 0.5, 0.0, 1.0), ("A", -1.0, 0.4, 0.2))
    r = generators.rotate(a, S.rotation((0.3, 1.0, 0.2), 40.0)).select("sid", "aid", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    found = generators.kabsch(a.join(r, ["sid", "aid"])).first()
    assert found.rmsd < 1e-6
    assert np.allclose(np.array(found.rotation).reshape(3, 3), S.rotation((0.3, 1.0, 0.2), 40.0), atol=1e-8)


def test_random_displacements_have_their_rms_and_repeat(spark):
    a = rows(spark, *[("A", float(i), 0.0, 0.0) for i in range(5)])
    one, two = (generators.random_displacements(a, 0.2, 1, 3).orderBy("aid").collect() for _ in range(2))
    assert one == two
    d = np.array([[r.x - r.aid, r.y, r.z] for r in one])
    assert np.sqrt((d**2).sum() / 5) == pytest.approx(0.2)
    assert np.abs(d.mean(0)).max() < 1e-12


def test_log_det_and_mean_cosine(spark):
    v = np.random.default_rng(0).normal(size=(6, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    cov = np.cov(v.T)
    assert diversity.log_det(df, "v") == pytest.approx(np.linalg.slogdet(cov + 1e-3 * np.trace(cov) / 3 * np.eye(3))[1])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert diversity.mean_cosine(df, "v").first().mean_cosine == pytest.approx((u @ u.T)[np.triu_indices(6, 1)].mean())
    with pytest.raises(ValueError):
        diversity.log_det(df.limit(1), "v")


def test_pair_means(spark, monkeypatch):
    monkeypatch.setattr(diversity, "PAIR_BLOCK", 3)
    v = np.random.default_rng(1).normal(size=(7, 5))
    v[3] = 2.0  # no correlation
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9, None)], "id int, v array<double>")
    got = diversity.pair_means(df, "id", "v").first()
    i, j = np.triu_indices(7, 1)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    u, c = unit(v), unit(v - v.mean(1, keepdims=True))
    assert got.n == 7 and got.mean_euclid == pytest.approx(np.linalg.norm(v[i] - v[j], axis=1).mean())
    assert got.mean_cosine == pytest.approx((u[i] * u[j]).sum(1).mean()) and got.mean_pearson == pytest.approx((c[i] * c[j]).sum(1).mean())
    with pytest.raises(ValueError):
        diversity.pair_means(df.where("id in (0, 9)"), "id", "v")


def test_pair_metrics_take_all_components(spark):
    import duckdb

    from atomspan.plans import registry

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.execute(registry.ORACLE_SQL["pair_metrics_whole"])
    names = [c[0] for c in want.description]
    got = registry.QUERIES["pair_metrics_whole"](spark, small)
    assert names == got.columns == ["a", "b", "euclid", "cosine", "pearson"]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
    vectors = {}
    for r in spark.read.parquet(f"{small}/embeddings.parquet").collect():
        vectors.setdefault(r.label, []).append(r.embedding)
    mean = {k: np.mean(np.array(x, float), 0) for k, x in vectors.items()}
    for r in got.collect():
        assert r.euclid == pytest.approx(np.linalg.norm(mean[r.a] - mean[r.b]), abs=1e-5)
        assert r.pearson == pytest.approx(np.corrcoef(mean[r.a], mean[r.b])[0, 1], abs=1e-5)
