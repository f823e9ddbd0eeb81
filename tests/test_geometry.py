import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomspan.functions import scalars as S
from atomspan.operators import generators, geometry, spatial
from atomspan.plans import chain

ATOM = "sid int, aid int, species string, x double, y double, z double"
CELL = [[5.0, 0.0, 0.0], [1.0, 4.0, 0.0], [0.5, 0.7, 6.0]]


def rows(spark, *atoms, sid=1, cell=None):
    made = spark.createDataFrame([(sid, i, *a) for i, a in enumerate(atoms)], ATOM)
    return made if cell is None else made.withColumn("cell", F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in cell]))


def some(spark, n=4, seed=1, cell=CELL):
    f = np.random.default_rng(seed).random((n, 3))
    return rows(spark, *[("AB"[i % 2], *p) for i, p in enumerate((f @ np.array(cell)).tolist())], cell=cell)


def places(df):
    return np.array([[r.x, r.y, r.z] for r in df.orderBy("aid").collect()])


def cells(df):
    return np.array([r.cell for r in df.orderBy("aid").collect()])


def fractions(df):
    return np.array([p @ np.linalg.inv(c) for p, c in zip(places(df), cells(df), strict=True)])


def counts(df, cutoff):
    found = spatial.periodic_edges(df, cutoff)
    return sorted(r["n"] for r in found.groupBy("i").agg(F.count("*").alias("n")).collect())


def test_strains_change_cells_and_keep_fractions(spark):
    base = some(spark).withColumns({"energy": F.lit(1.0), "fx": F.lit(2.0)})
    want = {
        "uniaxial": (generators.uniaxial(base, "y", 1.1, 1.2, 2), np.diag([1, 1.1, 1])),
        "volume": (generators.uniaxial(base, "z", 1.21, 1.3, 2, True), np.diag([1 / 1.1, 1 / 1.1, 1.21])),
        "isotropic": (generators.isotropic(base, 0.9, 1.0, 2), np.eye(3) * 0.9),
        "shear": (generators.shear(base, "xz", 0.2, 0.3, 2), np.array([[1, 0, 0.2], [0, 1, 0], [0, 0, 1]])),
        "orthorhombic": (generators.orthorhombic(base, 0.1, 0.2, 2, "yzx"), np.diag([1 / 0.99, 1.1, 0.9])),
        "monoclinic": (generators.monoclinic(base, 0.2, 0.4, 2), np.array([[1, 0.1, 0], [0.1, 1, 0], [0, 0, 1 + 0.04 / 3.96]])),
    }
    for name, (made, f) in want.items():
        one = made.where("step = 0")
        assert np.allclose(cells(one), np.array(CELL) @ f), name
        assert np.allclose(fractions(one), fractions(base)), name
        assert {(r.energy, r.fx) for r in one.collect()} == {(None, None)}
    # The strained cell's neighbours are those of brute force.
    one = want["shear"][0].where("step = 0")
    box, p = cells(one)[0], places(one)
    brute = []
    for i in range(4):
        brute.append(sum(np.linalg.norm(p[j] + np.array(o) @ box - p[i]) <= 4 and (i != j or any(o)) for j in range(4) for o in [(a, b, c) for a in range(-3, 4) for b in range(-3, 4) for c in range(-3, 4)]))
    assert counts(one.drop("step", "s"), 4.0) == sorted(brute)


def test_rotations_turn_cells_and_forces(spark):
    base = some(spark).withColumns({"fx": F.lit(1.0), "fy": F.lit(0.0), "fz": F.lit(0.0)})
    m = S.rotation_between((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))
    turned = generators.rotate(base, m)
    assert np.allclose(cells(turned), np.array(CELL) @ np.array(m)) and counts(turned, 4.0) == counts(base, 4.0)
    assert all((round(r.fx, 9), round(r.fy, 9)) == (0.0, 1.0) for r in turned.collect())
    for a, b in (((1.0, 2.0, 3.0), (-1.0, -2.0, -3.0)), ((0.0, 0.0, 2.0), (0.0, 0.0, 5.0)), ((1.0, 0.2, 0.0), (0.3, 0.1, -2.0))):
        got = np.array(a) @ np.array(S.rotation_between(a, b))
        assert np.allclose(got / np.linalg.norm(a), np.array(b) / np.linalg.norm(b))


def test_supercells_by_numbers_and_by_matrix_have_the_same_neighbours(spark):
    base = some(spark)
    one = generators.supercell(base, None, 2, 1, 2).drop("ia", "ib", "ic")
    two = geometry.transform_cell(base, [[2, 0, 0], [0, 1, 0], [0, 0, 2]])
    assert np.allclose(cells(one)[0], np.diag([2, 1, 2]) @ np.array(CELL)) and np.allclose(cells(two)[0], cells(one)[0])
    assert counts(one, 3.5) == counts(two, 3.5) == sorted(counts(base, 3.5) * 4)


@pytest.mark.parametrize("matrix", [[[1, -1, 0], [1, 0, -1], [1, 1, 1]], [[0, 1, 1], [1, 0, 1], [1, 1, 0]]])
def test_other_bases_are_the_same_crystal(spark, matrix):
    base = some(spark)
    new = geometry.transform_cell(base, matrix)
    k = round(abs(np.linalg.det(np.array(matrix))))
    assert new.count() == 4 * k and counts(new, 3.5) == sorted(counts(base, 3.5) * k)
    back = geometry.transform_cell(new, np.linalg.inv(np.array(matrix, float)).tolist())
    assert back.count() == 4 and counts(back, 3.5) == counts(base, 3.5)
    assert [r.species for r in back.orderBy("aid").collect()] == ["A", "A", "B", "B"]


def test_a_basis_without_whole_atoms_raises(spark):
    with pytest.raises(Exception, match="no whole number"):
        geometry.transform_cell(some(spark), [[0.5, 0, 0], [0, 1, 0], [0, 0, 1]]).collect()


def test_standard_cells_and_lattices(spark):
    turned = generators.rotate(some(spark), S.rotation((1.0, 2.0, 0.5), 70.0))
    new = geometry.standard_cell(turned)
    assert np.allclose(cells(new)[0], [[5, 0, 0], [1, 4, 0], [0.5, 0.7, 6]]) and np.allclose(fractions(new), fractions(turned))
    one, two = (geometry.lattice(x).first() for x in (turned, new))
    for c in ("a", "b", "c", "alpha", "beta", "gamma", "ab", "ac", "bc"):
        assert one[c] == pytest.approx(two[c])
    assert one.a == pytest.approx(5) and one.gamma == pytest.approx(math.degrees(math.acos(1 / math.sqrt(17))))
    assert np.allclose(places(geometry.cartesian(geometry.fractional(new).withColumns({c: F.lit(0.0) for c in "xyz"}))), places(new))


def test_scaling_by_vectors_keeps_labels(spark):
    base = some(spark).withColumn("energy", F.lit(3.0))
    got = generators.scaled(base, (2.0, 1.0, 0.5))
    assert np.allclose(cells(got)[0], np.diag([2, 1, 0.5]) @ np.array(CELL)) and np.allclose(fractions(got), fractions(base)) and got.first().energy == 3.0
    assert np.allclose(places(generators.scaled(base.drop("cell"), (2.0,))), 2 * places(base))
    with pytest.raises(ValueError):
        generators.scaled(base, (1.0, 2.0))


def test_vacuum(spark):
    slab = rows(spark, ("A", 0.0, 0.0, 0.05), ("B", 1.0, 1.0, 2.0), ("A", 2.0, 2.0, 3.95), cell=[[4.0, 0, 0], [0, 4.0, 0], [1.0, 0, 4.0]])
    got = geometry.add_vacuum(slab, 6.0)
    assert np.allclose(cells(got)[0][2], [2.5, 0, 10]) and got.count() == 5
    assert sorted(round(r.z, 6) for r in got.collect()) == [-0.05, 0.05, 2.0, 3.95, 4.05]
    assert geometry.add_vacuum(slab, 6.0, boundary=None).count() == 3
    box = geometry.add_vacuum(rows(spark, ("A", 0.0, 0.0, 0.0), ("B", 1.0, 2.0, 3.0)), 4.0)
    assert np.allclose(cells(box)[0], np.diag([5, 6, 7])) and np.allclose(places(box).mean(0), [2.5, 3, 3.5])
    assert not np.allclose(cells(geometry.add_vacuum(slab, 6.0, perpendicular=False))[0][2], cells(got)[0][2])


def test_translations(spark):
    base = some(spark)
    assert np.allclose(places(generators.translate(base, "origin")).mean(0), 0)
    assert np.allclose(places(generators.translate(base, "box")).mean(0), np.array(CELL).sum(0) / 2)
    assert np.allclose(places(generators.translate(base, "origin", reference=2))[2], 0)
    assert np.allclose(places(generators.translate(base, (1.0, 2.0, 3.0))) - places(base), [1, 2, 3])
    with pytest.raises(ValueError):
        generators.translate(base.drop("cell"), "box")


def test_redundant_images_and_symmetry(spark):
    base = some(spark)
    twice = base.unionByName(base.withColumns({"aid": F.col("aid") + 10, "x": F.col("x") + 5.0 + 1e-4}))
    assert sorted(r.aid for r in geometry.remove_redundant(twice).collect()) == [0, 1, 2, 3]
    # An axis of four turns about the origin of a square cell, and a shift along it.
    ops = [([[c, -s, 0], [s, c, 0], [0, 0, 1]], [0, 0, 0.25 * k]) for k, (c, s) in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)])]
    unit = rows(spark, ("A", 0.4, 0.8, 0.0), ("B", 0.0, 0.0, 0.0), cell=[[4.0, 0, 0], [0, 4.0, 0], [0, 0, 4.0]])
    got = geometry.symmetry_equivalent(unit, ops)
    f = {(r.species, *[round(float(v), 6) for v in p]) for r, p in zip(got.orderBy("aid").collect(), fractions(got), strict=True)}
    assert f == {("A", 0.1, 0.2, 0.0), ("A", 0.8, 0.1, 0.25), ("A", 0.9, 0.8, 0.5), ("A", 0.2, 0.9, 0.75), ("B", 0.0, 0.0, 0.0), ("B", 0.0, 0.0, 0.25), ("B", 0.0, 0.0, 0.5), ("B", 0.0, 0.0, 0.75)}


def test_surroundings(spark):
    base = some(spark)
    found = spatial.periodic_edges(base, 4.0)
    lists = {r.i: r for r in geometry.neighbour_lists(found).collect()}
    assert all([e.d for e in r.neighbours] == sorted(e.d for e in r.neighbours) and len(r.neighbours) == r.n for r in lists.values())
    env = {r.i: r for r in geometry.environments(base, found).collect()}
    for i, r in env.items():
        own = np.array([r.x, r.y, r.z])
        assert all(np.linalg.norm(np.array([e.x, e.y, e.z]) - own) == pytest.approx(e.d) for e in r.neighbours) and len(r.neighbours) == lists[i].n
    cut = geometry.neighbour_cluster(base, found, 2, 3.0).orderBy("aid").collect()
    p = np.array([[r.x, r.y, r.z] for r in cut])
    assert np.allclose(p[0], places(base)[2]) and len(cut) == 1 + sum(e.d <= 3 for e in lists[2].neighbours)
    assert np.allclose(np.linalg.norm(p[1:] - p[0], axis=1), [e.d for e in lists[2].neighbours if e.d <= 3])
    d = sorted(r.d for r in geometry.image_distances(base, 0, 1, 9.0).collect())
    f, box = fractions(base), np.array(CELL)
    assert d == pytest.approx(sorted(v for o in np.ndindex(9, 9, 9) if (v := np.linalg.norm((f[1] + np.array(o) - 4 - f[0]) @ box)) <= 9))
    ghosts = found.unionByName(found)
    assert geometry.drop_repeated_ghosts(ghosts).count() == found.count()


def test_an_image_at_just_the_cutoff_counts(spark):
    box = [[50.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 10.0]]
    made = [(k, i, "A", float(k + 10 * i), 3.0, 7.0) for k in range(40) for i in range(2)]
    atoms = spark.createDataFrame(made, ATOM).withColumn("cell", F.array(*[F.array(*map(F.lit, r)) for r in box]))
    got = geometry.image_distances(atoms, 0, 1, 60.0, pbc=(True, False, False)).collect()
    assert sorted((r.sid, r.ox, r.d) for r in got) == [(k, o, abs(10.0 + 50 * o)) for k in range(40) for o in (-1, 0, 1)]


def test_diameters_and_centres(spark):
    p = np.random.default_rng(3).normal(size=(60, 3)) * [3, 1, 1]
    base = rows(spark, *[("A", *map(float, v)) for v in p])
    want = max(np.linalg.norm(a - b) for a in p for b in p)
    assert geometry.diameter(base).first().diameter == pytest.approx(want)
    assert geometry.diameter(rows(spark, ("A", 1.0, 1.0, 1.0))).first().diameter == 0
    assert geometry.diameter(some(spark)).first().diameter is None
    # A dimer across the cell's end.
    dimer = rows(spark, ("A", 0.2, 1.0, 1.0), ("B", 9.6, 1.0, 1.0), cell=np.diag([10.0, 10, 10]).tolist()).withColumn("m", F.lit(1.0))
    c = geometry.centre_of_mass(dimer, "m").first()
    assert (c.x % 10, c.y) == pytest.approx((9.9, 1.0))
    assert generators.centre(dimer, mass="m").first().x == pytest.approx(4.9)


def test_alignment(spark):
    rng = np.random.default_rng(5)
    box, steps = np.array(CELL), 6
    f = np.cumsum(rng.normal(0, 0.1, (steps, 3, 3)), axis=0) + 0.5
    data = [(1, t, i, "A", *map(float, (f[t, i] % 1) @ box)) for t in range(steps) for i in range(3)]
    atoms = spark.createDataFrame(data, "sid int, frame int, aid int, species string, x double, y double, z double").withColumn("cell", F.array(*[F.array(*map(F.lit, r)) for r in CELL]))
    for constant in (True, False):
        out = geometry.align_frames(atoms, constant_cell=constant)
        assert out.columns == atoms.columns
        got = {(r.frame, r.aid): np.array([r.x, r.y, r.z]) for r in out.collect()}
        for i in range(3):
            for t in range(1, steps):
                assert np.allclose((got[t, i] - got[t - 1, i]) @ np.linalg.inv(box), f[t, i] - f[t - 1, i], atol=1e-9)
    near = {(r.frame, r.aid): np.array([r.x, r.y, r.z]) for r in geometry.align_frame(atoms, 2).collect()}
    assert all(np.abs((near[t, i] - near[2, i]) @ np.linalg.inv(box)).max() <= 0.5 + 1e-9 for t in range(steps) for i in range(3))


def test_random_and_optimal_moves(spark):
    base = some(spark, 5)
    made = generators.random_displacements(base, 0.3, 6, 2, orthogonal=True)
    moves = np.stack([places(made.where(F.col("copy") == k)) - places(base) for k in range(6)])
    flat = moves.reshape(6, -1)
    assert np.allclose(flat @ flat.T, np.eye(6) * 5 * 0.09) and np.abs(moves.mean(1)).max() < 1e-12 and "cell" in made.columns
    with pytest.raises(ValueError):
        generators.orthogonal_moves(2, 4, np.random.default_rng(0))
    value = lambda d: np.linalg.slogdet((u := d.reshape(len(d), -1) / np.linalg.norm(d.reshape(len(d), -1), axis=1, keepdims=True)) @ u.T + 1e-6 * np.eye(len(d)))[1]
    best = generators.d_optimal_moves(4, 5, np.random.default_rng(7))
    start = np.random.default_rng(7).normal(size=(5, 4, 3))
    assert value(best) > value(start - start.mean(1, keepdims=True)) and value(best) > -0.01 and np.abs(best.mean(1)).max() < 1e-12
    one = generators.d_optimal_displacements(base, 0.2, 2, 1)
    d = places(one.where("copy = 1")) - places(base)
    assert np.sqrt((d**2).sum() / 5) == pytest.approx(0.2)


def test_fixed_atoms_and_updated_cells(spark):
    base = some(spark).withColumn("energy", F.lit(1.0))
    assert [r.fixed for r in geometry.fix_atoms(base, [1, 4]).orderBy("aid").collect()] == [True, False, False, True]
    assert geometry.fix_atoms(base, mask=F.col("species") == "A").where("fixed").count() == 2
    new = np.diag([7.0, 7, 7]).tolist()
    one, two = generators.update_cell(base, None, new), generators.update_cell(base, None, new, keep_fractional=False)
    assert np.allclose(fractions(one), fractions(base)) and np.allclose(places(two), places(base)) and np.allclose(cells(two)[0], new)
    assert one.first().energy is None and two.first().energy is None


def test_chains(spark):
    base = some(spark)
    made = chain.Chain(chain.displacements(0.1), chain.uniaxial("x", 0.9, 1.1, 3), chain.random_displacements(0.05, 2, 1), chain.supercell(1, 2, 1))(base)
    structures = made.select("sid", "source", "path").distinct().collect()
    assert len(structures) == 12 * 3 * 2 and {r.source for r in structures} == {1}
    assert sorted(tuple(r.path) for r in structures) == sorted((a, b, c, d) for a in range(4) for b in range(3) for c in range(3) for d in range(2))
    assert made.count() == len(structures) * 8
    assert chain.Chain()(base).count() == 4 and chain.Chain(chain.Stage("none", lambda a: a.limit(0)), chain.isotropic(1, 2, 2))(base).count() == 0
    assert chain.Chain(chain.shear("xy", 0.1, 0.2, 2), chain.cell_matrix([[1, 0, 0], [0, 2, 0], [0, 0, 1]])).count(base).first().n == 2


def test_conversion_in_its_order(spark):
    base = some(spark).withColumn("frame", F.lit(0))
    out = chain.convert(base, supercell=(2, 1, 1), standard_cell=True, wrap=True, sort=["B", "A"], remove_atoms=[1], fix_atoms=[2])
    got = out.orderBy("aid").collect()
    assert [r.species for r in got] == ["B"] * 4 + ["A"] * 2 and [r.aid for r in got] == list(range(6))
    f = np.array([np.array([r.x, r.y, r.z]) @ np.linalg.inv(np.array(r.cell)) for r in got])
    assert (f > -1e-9).all() and (f < 1 + 1e-9).all() and sum(r.fixed for r in got) == 2
    cut = chain.convert(base, cut=(1, 3.0))
    assert cut.count() == 1 + spatial.periodic_edges(base, 3.0).where("i = 0").count()
    assert np.allclose(places(chain.convert(base, rotate=((0, 0, 1), 90.0), shift=(1.0, 0.0, 0.0)))[0], places(base)[0] @ np.array(S.rotation((0, 0, 1), 90.0)) + [1, 0, 0])
    with pytest.raises(ValueError):
        chain.convert(base, melt=True)


def test_pair_distributions_of_an_ideal_gas(spark):
    rng = np.random.default_rng(9)
    data = [(1, t, i, "AB"[i % 2], *map(float, rng.random(3) * 10)) for t in range(4) for i in range(200)]
    atoms = spark.createDataFrame(data, "sid int, frame int, aid int, species string, x double, y double, z double").withColumn("cell", F.array(*[F.array(*[F.lit(10.0 * (i == j)) for j in range(3)]) for i in range(3)]))
    found = spatial.periodic_edges(atoms, 3.0, ("sid", "frame"))
    for kinds in ((None, None), ("A", "B")):
        g = {r.bin: r.g for r in spatial.rdf_frames(found, atoms, 0.5, centre=kinds[0], other=kinds[1]).collect()}
        assert all(g[b] == pytest.approx(1, abs=0.15) for b in (3, 4, 5))
    weighed = {r.bin: r.g for r in spatial.rdf_frames(found, atoms, 0.5, weights={"A": 2.0, "B": 1.0}).collect()}
    assert weighed[5] == pytest.approx(1, abs=0.15)


def test_displaced_structures_are_whole_whatever_the_batches(spark):
    rng = np.random.default_rng(11)
    sizes = [1, 2, 9, 3, 1, 4]
    made = [(s, i, "A", *map(float, rng.random(3))) for s, k in enumerate(sizes) for i in range(k)]
    made += [(6, 0, "A", float(k), 0.0, 0.0) for k in range(5)] + [(None, k, "B", 0.0, float(k), 0.0) for k in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        one, two = (generators.random_displacements(spark.createDataFrame(rows, ATOM).repartition(3), 0.2, 2, 5) for rows in (made, made[::-1]))
        assert "FlatMapGroupsInPandas" not in one._jdf.queryExecution().executedPlan().toString()  # no call for each structure
        got, again = (sorted((r.sid is not None, r.sid or 0, r.copy, r.aid, r.x, r.y, r.z) for r in df.collect()) for df in (one, two))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == again and len(got) == 2 * len(made)  # atoms of one number too
    for s, k in enumerate(sizes):
        d = np.random.default_rng([5, zlib.crc32(str(s).encode())]).normal(size=(2, k, 3))
        d -= d.mean(1, keepdims=True)
        d *= 0.2 / np.sqrt((d**2).sum((1, 2)) / k)[:, None, None] if k > 1 else 0
        want = np.array([r[3:] for r in made if r[0] == s]) + d
        assert np.allclose([r[4:] for r in got if r[0] and r[1] == s], want.reshape(-1, 3), atol=1e-12)
