import pytest
from pyspark.sql import functions as F

from atomspan.operators import energies, structures as sets

FRAME = "sid int, frame int, pbc boolean, energy double"


def test_frames_are_chosen_and_appended(spark):
    a = spark.createDataFrame([(1, 0, True, 1.0), (1, 1, True, 2.0), (1, 2, True, 3.0), (2, 0, False, 4.0)], FRAME)
    pick = lambda k: {r.sid: r.frame for r in sets.frame_at(a, k).collect()}
    assert pick(-1) == {1: 2, 2: 0} and pick(0) == {1: 0, 2: 0} and pick(9) == {1: 2, 2: 0} and pick(-2) == {1: 1, 2: 0}
    assert sorted(r.frame for r in sets.stride(a.where("sid = 1"), 0, None, 2).collect()) == [0, 2]
    b = spark.createDataFrame([(1, 5, True, 9.0), (3, 7, True, 8.0)], FRAME)
    both = sets.append_frames(a, b)
    assert sorted((r.sid, r.frame, r.energy) for r in both.collect())[3:] == [(1, 3, 9.0), (2, 0, 4.0), (3, 0, 8.0)]
    with pytest.raises(ValueError):
        sets.append_frames(a, b.withColumn("pbc", F.lit(False)))
    more = sets.add_frame(a, spark.createDataFrame([(2, False, 7.0)], "sid int, pbc boolean, energy double"))
    assert sorted((r.frame, r.energy) for r in more.where("sid = 2").collect()) == [(0, 4.0), (1, 7.0)]
    assert {(r.sid, r.frame): r.energy for r in sets.amend_energy(a, -1.0).collect()} == {(1, 0): 1.0, (1, 1): 2.0, (1, 2): -1.0, (2, 0): -1.0}


def test_merging_and_removing(spark):
    atom = "sid int, frame int, aid int, species string, x double, fx double"
    a = spark.createDataFrame([(1, 0, 0, "A", 0.0, 1.0), (1, 0, 1, "B", 1.0, 1.0)], atom).withColumn("cell", F.lit("own"))
    b = spark.createDataFrame([(1, 0, 0, "C", 2.0, 1.0)], atom).withColumn("cell", F.lit("other"))
    got = sets.merge(a, b).orderBy("aid").collect()
    assert [(r.aid, r.species, r.cell) for r in got] == [(0, "A", "own"), (1, "B", "own"), (2, "C", "own")] and "fx" not in got[0]
    with pytest.raises(ValueError):
        sets.merge(a, b.unionByName(b.withColumn("frame", F.lit(1))))
    left = sets.remove_atoms(a, [0]).collect()
    assert [(r.aid, r.new_aid, r.fx) for r in left] == [(1, 0, 1.0)]
    forces = spark.createDataFrame([(1, 0, 1, 5.0, 6.0, 7.0)], "sid int, frame int, aid int, fx double, fy double, fz double")
    assert [(r.aid, r.fy) for r in sets.amend_forces(a, forces).orderBy("aid").collect()] == [(0, None), (1, 6.0)]
    assert sets.of_type(a, "B").count() == 1


def test_sorting_and_equality(spark):
    a = spark.createDataFrame([(1, 0, "B", 1.0), (1, 1, "A", 2.0), (1, 2, "B", 3.0), (2, 0, "A", 0.0)], "sid int, aid int, species string, z double")
    assert [r.place for r in sets.sort_atoms(a, ["B", "A"]).where("sid = 1").orderBy("aid").collect()] == [2, 3, 1]
    assert [(r.aid, r.species, r.z) for r in sets.sort_by_coordinate(a).where("sid = 1").orderBy("aid").collect()] == [(0, "A", 2.0), (1, "B", 1.0), (2, "B", 3.0)]
    b = a.withColumn("z", F.when((F.col("sid") == 1) & (F.col("aid") == 2), 3.0000001).otherwise(F.col("z"))).unionByName(a.limit(1).withColumn("sid", F.lit(3)))
    assert {r.sid: r.equal for r in sets.equal_structures(a, b).collect()} == {1: False, 2: True, 3: False}
    repeated = a.unionByName(a.where("sid = 2"))
    assert {r.sid: r.equal for r in sets.equal_structures(a, repeated).collect()} == {1: True, 2: False}
    assert sets.union_all(a, a.drop("z"), a).where("z is null").count() == 4


def test_checks_raise(spark):
    a = spark.createDataFrame([(1, "A"), (1, "Q"), (2, None)], "sid int, species string")
    with pytest.raises(ValueError, match="None, Q"):
        sets.check_species(a, ["A"])
    assert sets.check_species(a.where("species = 'A'"), ["A"]).count() == 1
    m = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "sid int, member int")
    with pytest.raises(ValueError):
        sets.check_members(m)
    assert sets.check_members(m.where("sid = 1")).count() == 2
    t = spark.createDataFrame([(0, "A"), (0, "B"), (1, "B")], "member int, species string")
    assert {r.member: r.same for r in sets.same_types(t).collect()} == {0: True, 1: False}


def test_names_forces_and_statistics(spark):
    d = spark.createDataFrame([(7, "", None, 0), (8, "x", "y", 2)], "n int, display string, source string, frame int")
    assert [r.name for r in sets.identifier(d, ["display", "source"], "n", "frame").orderBy("n").collect()] == ["structure_000007#frame=0", "x#frame=2"]
    assert [r.name for r in sets.identifier(d, ["source"], "n", "frame", always=False).orderBy("n").collect()] == ["structure_000007", "y#frame=2"]
    frames = spark.createDataFrame([(1,), (2,), (3,)], "sid int")
    atoms = spark.createDataFrame([(1, 0, "A", 1.0), (1, 1, "B", 1.0), (2, 0, "A", None)], "sid int, aid int, species string, fx double").withColumns({"fy": F.col("fx"), "fz": F.col("fx")})
    known = sets.with_forces(frames, atoms)
    assert {r.sid: r.has_forces for r in known.collect()} == {1: True, 2: False, 3: False}
    assert [sets.uses_forces(known, w, f, frames.where("sid = 2")).where("use_forces").count() for w, f in ((0.0, 1.0), (1.0, 1.0), (1.0, 0.5))] == [0, 1, 0]
    s = sets.dataset_statistics(known, atoms).first()
    assert (s.n_structures, s.n_with_forces, s.n_atoms, s.mean_atoms, s.species) == (3, 1, 3, 1.0, ["A", "B"])
    assert {r.sid: r.composition for r in sets.samples(frames.withColumn("energy", F.lit(1.0)), atoms).collect()} == {1: {"A": 1, "B": 1}, 2: {"A": 1}}
    assert spark.range(1).select(sets.composition_of(F.array(F.lit("O"), F.lit("H"), F.lit("H"))).alias("c")).first().c == {"H": 2, "O": 1}


def test_nesting_is_the_inverse_of_flattening(spark):
    nested = spark.createDataFrame([(1, [("A", 0.0), ("B", 1.0)]), (2, [("C", 2.0)])], "sid int, atoms array<struct<species:string,x:double>>")
    frames, atoms = sets.flatten_frames(nested)
    assert {r.sid: r.n_atoms for r in frames.collect()} == {1: 2, 2: 1}
    back = sets.nest_frames(frames.select("sid"), atoms.repartition(3))
    assert {r.sid: [(a.aid, a.species, a.x) for a in r.atoms] for r in back.collect()} == {1: [(0, "A", 0.0), (1, "B", 1.0)], 2: [(0, "C", 2.0)]}
    assert sets.longest_descriptor(spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "fingerprint array<double>")).first().n_features == 2


def test_joins(spark):
    t = spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "sid int, frame int, step int")
    log = spark.createDataFrame([(10, 1.5), (15, 2.5), (10, 9.5)], "step int, energy double")
    got = {r.frame: r.energy for r in sets.merge_log(t, log.where("energy < 9")).collect()}
    assert got == {0: 1.5, 1: None}
    z = sets.zip_frames(t, spark.createDataFrame([(1, 1, 7.0)], "sid int, frame int, e double"))
    assert {r.frame: r.e for r in z.collect()} == {0: None, 1: 7.0}


def test_references_and_compounds(spark):
    rows = spark.createDataFrame([(1, "A1", 1.0), (2, "A2", 1.8), (3, "B1", 5.0), (4, "A2,B2", 3.0), (5, "A1,B1", 1.4), (6, "B1", 4.0)], "sid int, key string, energy double")
    found = energies.compound_references(rows, {"a": {"A": 4}, "ab": {"A": 1, "B": 1}})
    assert found["energies"] == pytest.approx({"A": 0.9, "B": 0.5}) and found["samples"] == {"a": 2, "ab": 5}
    with pytest.raises(ValueError, match="no sample of c"):
        energies.compound_references(rows, {"a": {"A": 1}, "c": {"C": 1}})
    with pytest.raises(ValueError, match="determine"):
        energies.compound_references(rows, {"ab": {"A": 1, "B": 1}})
    c = spark.createDataFrame([(1, 0, 1.0), (0, 1, 2.0), (2, 1, 4.5)], "n_A int, n_B int, energy double")
    fit = energies.reference_fit(c, ["A", "B"])
    assert fit["n_samples"] == 3 and fit["n_compositions"] == 3 and fit["rmse"] > 0
    with pytest.raises(ValueError):
        energies.reference_fit(c.unionByName(c.limit(1).withColumn("energy", F.lit(float("nan")))), ["A", "B"])
    assert energies.decompose({"Li": 2, "O": 1}, {"Li2O2": {"Li": 2, "O": 2}, "Li": {"Li": 1}}) == pytest.approx({"Li2O2": 0.5, "Li": 1.0})
    with pytest.raises(ValueError):
        energies.decompose({"Li": 1}, {"a": {"Li": 1, "O": 1}, "b": {"Li": 2, "O": 2}})
    s = spark.createDataFrame([(1, 10.0), (2, 5.0)], "sid int, energy double")
    a = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "sid int, species string")
    co = energies.cohesive_energy(s, a, {"A": 1.0, "B": 2.0})
    assert {r.sid: (r.cohesive, r.cohesive_per_atom, r.energy_per_atom) for r in co.collect()} == {1: (7.0, 3.5, 5.0), 2: (4.0, 4.0, 5.0)}
    assert {r.sid: r.energy for r in energies.total_energy(co.select("sid", "cohesive"), a, {"A": 1.0, "B": 2.0}).collect()} == {1: 10.0, 2: 5.0}


def test_running_totals_by_keys_of_any_type(spark):
    rows = spark.createDataFrame([(f"s{k:04d}", k % 5) for k in range(500)], "sid string, n_atoms long").repartition(7)
    got = {r.sid: r.first_atom for r in energies.first_atom_offsets(rows).collect()}
    total = 0
    for k in range(500):
        assert got[f"s{k:04d}"] == total
        total += k % 5
    assert energies.first_atom_offsets(rows.limit(0)).count() == 0
