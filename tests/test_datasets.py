import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomspan.functions import scalars as S
from atomspan.operators import diversity, training
from atomspan.sources import archives, datasets, formats, reports
from atomspan.streaming import features

SPINS, SETTINGS = {"H": -1, "O": 1}, (3.0, 1, 3.0, 1)


def frames(spark, n=7):
    rng = np.random.default_rng(2)
    out = []
    for k in range(n):
        atoms = [(s, *map(float, p), 0.1 * k, 0.0, 0.0) if k % 3 else (s, *map(float, p), None, None, None) for s, p in zip("OHH", rng.random((3, 3)) * 1.5, strict=True)]
        out.append({"name": f"s{k}", "cell": [[4.0, 0, 0], [0, 4.0, 0], [0, 0, 4.0]] if k % 2 else None, "energy": -10.0 - k, "atoms": atoms})
    return archives.records(spark, out)


def test_sets_are_saved_sliced_and_pruned(spark, tmp_path):
    folder = str(tmp_path / "set")
    datasets.featurise(frames(spark), folder, SPINS, SETTINGS, {"H": -1.0, "O": -2.0}, "water", max_energy=-2.0, max_force=0.45)
    s = datasets.load(spark, folder)
    # e_ref = (energy + 4) / 3 <= -2 leaves all, the forces of s5 are too large.
    assert len(s) == 6 and s.meta["name"] == "water" and s.meta["species"] == ["H", "O"] and s.meta["n_atoms"] == 18 and s.meta["references"] == [-1.0, -2.0]
    assert s.meta["e_min"] == pytest.approx((-16 + 4) / 3) and s.meta["n_with_forces"] == 3
    one, atoms = s[-1]
    assert one.first().path == "s6" and atoms.count() == 3 and len(atoms.first().fingerprint) == 8
    assert [r.path for r in s[1:5:2][0].orderBy("sid").collect()] == ["s1", "s3"]
    with pytest.raises(IndexError):
        s[6]
    with pytest.raises(ValueError):
        s[::-1]
    assert [(r.sid, len(a)) for r, a in s] == [(k, 3) for k in range(6)] and [r.sid for r, _ in s.cursor(4)] == [4, 5]
    bare = datasets.load(spark, folder, coords=False, forces=False, features=False)
    assert bare.atoms.columns == ["sid", "aid", "species"]
    stats = datasets.species_statistics(s.atoms)
    assert stats.count() == 16 and stats.where("low > mean + 1e-9 or high < mean - 1e-9 or abs(square - mean * mean - std * std) > 1e-9").count() == 0
    # Features of a structure with a cell are those of its images as well.
    from atomspan.operators import spatial

    own = s.atoms.where("sid = 1").join(s.frames.select("sid", "cell"), "sid")
    want, _ = spatial.describe(own, SPINS, SETTINGS)
    got = {r.aid: r.fingerprint for r in own.collect()}
    assert all(got[r.aid] == pytest.approx(list(r.fingerprint)) for r in want.collect())
    with pytest.raises(ValueError, match="not declared"):
        datasets.featurise(frames(spark), folder, {"H": 0}, SETTINGS)
    assert len(datasets.load(spark, folder)) == 6  # what failed left the set as it was


def test_kinds_of_training_sets(spark):
    rows = spark.createDataFrame([("a", bytearray(b"\x89HDF\r\n\x1a\nxx")), ("b", bytearray("Ti é".encode())), ("c", bytearray(b"\xff\xfe\x00"))], "path string, content binary")
    assert {r.path: r.kind for r in datasets.kind(rows).collect()} == {"a": "hdf5", "b": "ascii", "c": "binary"}


def test_reports(spark, tmp_path):
    compared = spark.createDataFrame([(1, -10.0, -9.0, 2, 1.0, 0.5, "a.xsf"), (2, -4.0, -4.0, 1, 0.0, 0.0, "b.xsf")], "sid int, reference double, predicted double, n_atoms int, difference double, per_atom double, path string")
    counts = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "sid int, n_H int, n_O int")
    line = reports.energy_lines(compared, counts, ["H", "O"]).orderBy("sid").first().line
    assert line.split() == ["-1.000000E+01", "-9.000000E+00", "2", "-5.000000E+00", "-4.500000E+00", "5.000000E-01", "2.500000E-01", "1", "1", "a.xsf"]
    c = reports.correlation(compared).first()
    assert c.n == 2 and c.rmse == pytest.approx(math.sqrt(0.125)) and c.mae == 0.25 and c.slope == pytest.approx(0.5) and c.r2 == pytest.approx(1.0)
    curves = reports.error_curves(spark.createDataFrame([(0, 1.0, float("nan")), (1, 0.5, 2.0)], "epoch int, a double, b double"), ("a", "b"))
    assert sorted(map(tuple, curves.collect())) == [(0, "a", 1.0), (1, "a", 0.5), (1, "b", 2.0)]
    reports.save_energies(compared, counts, ["H", "O"], str(tmp_path / "energies"))
    text = [r.value for r in spark.read.text(str(tmp_path / "energies")).collect()]
    assert len(text) == 3 and sum(x.startswith("Ref(eV)") for x in text) == 1
    history = training.history_frame(spark, [{"epoch": 0, "learning_rate": 0.1, "epoch_time": 2.0}, {"epoch": 1, "learning_rate": 0.05}])
    reports.save_history(history, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/history.csv").orderBy("epoch").collect()
    assert [float(r.learning_rate) for r in back] == [0.1, 0.05] and back[1].epoch_time == "NaN" and spark.read.json(f"{tmp_path}/history.json").count() == 2
    prints = spark.createDataFrame([(1, [0.5, 1.5])], "sid int, fingerprint array<double>")
    for _ in range(2):
        reports.append_fingerprints(prints, str(tmp_path / "prints"), n=3)
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "prints")).collect())) == [("1", "0.5", "1.5", None)] * 2
    members = spark.createDataFrame([(1, 0.2), (0, 0.1)], "member int, rmse double")
    assert json.loads(reports.committee_metadata(members, size=2, name="c").first().json) == {"settings": {"name": "c", "size": 2}, "members": [{"member": 0, "rmse": 0.1}, {"member": 1, "rmse": 0.2}]}
    curve = spark.createDataFrame([(1, 2.5), (0, 0.0)], "lag int, msd double")
    assert [r.line.split() for r in reports.msd_report(curve, 0.5).collect()] == [["0.0000", "0.00000000"], ["0.5000", "2.50000000"]]


def test_potentials_manifests_and_decks():
    model = training.build(["O"], 4, [(3, "tanh"), (2, "sigmoid")], seed=1)
    stats = [{"dim": 0, "low": 0.0, "high": 1.0, "mean": 0.5, "square": 0.3}]
    text = reports.potential("O", model["O"], ["H", "O"], {"cutoff": 3.0}, stats, {"n": 5})
    species, layers, neighbours, settings, back, meta = reports.read_potential(text)
    assert (species, neighbours, settings, meta) == ("O", ["H", "O"], {"cutoff": 3.0}, {"n": 5}) and back == stats
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2] for a, b in zip(layers, model["O"], strict=True))
    one, two = reports.manifest({"a": 1, "b": 2.5}, ["H"]), reports.manifest({"b": 2.5, "a": 1}, ["H"])
    assert one == two and reports.restore_manifest(*one) == ({"a": 1, "b": 2.5}, ["H"]) and one[1] != reports.manifest({"a": 1, "b": 2.5}, ["O"])[1]
    with pytest.raises(ValueError):
        reports.restore_manifest(one[0].replace("2.5", "2.6"), one[1])
    assert "FILES\n2\na\nb\n" in reports.generate_deck("out", {"H": -1.5}, {"H": "H.stp"}, ["a", "b"], True)
    deck = reports.train_deck("x.train", {"H": ("H.nn", [(10, "tanh"), (5, "linear")])}, 10, 50, "lm", {"batch": 100}, 0.5)
    assert "H H.nn 2 10:tanh 5:linear" in deck and "lm batch=100" in deck and "MAXENERGY 0.5" in deck
    assert "FORCES" in reports.predict_deck({"H": "H.nn"}, ["a"], True) and "FORCES" not in reports.predict_deck({"H": "H.nn"}, ["a"])
    assert reports.metrics_line(3, 1.23456, 0.5, 0.25, -2.0) == "n = 3, euclidean 1.235, cosine 0.500, pearson 0.250, log-det -2.000"
    assert reports.mean_and_deviation(1.23456789, 0.001) == "1.23457 ± 0.001"


def test_texts_and_checks(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(S.pairs(F.lit(" Co = 0.5, Ni=0.5 "))) == {"Co": "0.5", "Ni": "0.5"}
    assert one(S.nested_pairs(F.lit("Co=Co:0.5,Ni:0.5;Li=Li:1"))) == {"Co": {"Co": 0.5, "Ni": 0.5}, "Li": {"Li": 1.0}}
    assert [tuple(one(S.number(F.lit(t)))) for t in ("12", "1.5D2", "x")] == [(12, 12.0), (None, 150.0), (None, None)]
    assert one(S.decoded(F.lit(bytearray(b"Ti\x00\x00")))) == "Ti" and one(S.encoded(F.lit("abc"), 3)) == "abc" and one(S.file_name(F.lit("/a/b c#1.xsf"))) == "b_c_1.xsf"
    with pytest.raises(Exception, match="longer than"):
        one(S.encoded(F.lit("é" * 3), 5))
    m = lambda **k: F.create_map(*[F.lit(x) for pair in k.items() for x in pair])
    assert one(S.check_composition(m(A=1.0, B=0.0))) == {"A": 1.0, "B": 0.0}
    for bad in (m(A=-1.0), m(A=0.0), m(A=float("nan"))):
        with pytest.raises(Exception, match="no composition"):
            one(S.check_composition(bad))
    for bad in (float("inf"), float("nan"), None):
        with pytest.raises(Exception, match="no finite energy"):
            one(S.check_energy(F.lit(bad).cast("double")))
    radii = spark.createDataFrame([("Fe", "2+", "VI", "high", 0.78), ("Fe", "2+", "VI", "low", 0.61), ("Fe", "3+", "VI", "high", 0.645)], "species string, state string, coordination string, spin string, radius double")
    assert S.radius_of(radii, "Fe", "2", "VI", "low").first().radius == 0.61 and S.radius_of(radii, "Fe", "3").count() == 1
    got = one(S.scattering_factor([1.0, 2.0], [3.0, 4.0], 0.5, F.lit(60.0), 1.5))
    s2 = (0.5 / 1.5) ** 2
    assert got == pytest.approx(math.exp(-3 * s2) + 2 * math.exp(-4 * s2) + 0.5)


def test_moment_fingerprints_and_clusters(spark):
    rows = [(1, "A", [1.0, 2.0]), (1, "A", [3.0, 6.0]), (2, "B", [1.0, 1.0]), (2, "C", [9.0, 9.0])]
    df = spark.createDataFrame(rows, "sid int, species string, fingerprint array<double>")
    got = {r.sid: r.fingerprint for r in diversity.moment_fingerprint(df, ["A", "B"], 2).collect()}
    assert got == {1: [2, 4, 1, 4, 0, 0, 0, 0], 2: [0, 0, 0, 0, 1, 1, 0, 0]}
    weighed = {r.sid: r.fingerprint for r in diversity.moment_fingerprint(df, ["A", "B"], 1, weights={"A": -1.0, "B": 1.0}).collect()}
    assert weighed == {1: [2, 4, -2, -4, 0, 0, 0, 0], 2: [0, 0, 0, 0, 1, 1, 1, 1]}
    outer = {r.sid: r.fingerprint for r in diversity.moment_fingerprint(df, ["A", "B"], 1, 2, {"A": -1.0, "B": 1.0}, append=False).collect()}
    assert outer == {1: [-1, -2, 1, 4], 2: [0.5, 0.5, 0.25, 0.25]}
    with pytest.raises(ValueError):
        diversity.moment_fingerprint(df, ["A"], 0)
    r = np.random.default_rng(1)
    v = [(k, (r.normal(0, 0.1, 4) + 5 * (k % 2)).tolist(), float(k % 2)) for k in range(40)]
    assigned, table = diversity.cluster(spark.createDataFrame(v, "sid int, fingerprint array<double>, energy double"), 2, 2)
    groups = {}
    for x in assigned.collect():
        groups.setdefault(x.cluster, set()).add(x.sid % 2)
    assert sorted(map(len, groups.values())) == [1, 1] and [(x.n, x["mean"], x["std"]) for x in table.collect()] == [(20, 0.0, 0.0), (20, 1.0, 0.0)]
    with pytest.raises(ValueError):
        diversity.pair_metrics(spark.range(diversity.PAIR_ROWS + 1).select("id", F.array(F.lit(1.0)).alias("v")), "id", "v")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(f"2024-01-01 00:0{k}:00", float(k), [float(k), 1.0]) for k in range(10)], "t string, v double, fingerprint array<double>").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    q = features.feature_statistics(stream()).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.dim: r for r in spark.table("stats").collect()}
    assert got[0].n == 10 and got[0]["mean"] == pytest.approx(4.5) and got[1]["std"] == pytest.approx(1e-6)
    q = features.windowed_energies(stream(), "t", "v", "5 minutes", "1 minute").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r["mean"], r.low) for r in spark.table("windows").orderBy("start").collect()] == [(5, 2.0, 0.0)]
