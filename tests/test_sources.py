import pytest

from atomspan.sources import formats, logs

FRAME = {"cell": [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 6.0]], "energy": -3.5, "atoms": [("Ti", 0.5, 1.0, 1.5, 0.1, 0.2, 0.3), ("O", 2.0, 2.5, 3.0, -0.1, 0.0, 0.25)]}


@pytest.mark.parametrize("form", ["xsf", "xyz", "vasp", "aims", "runner"])
def test_round_trip(form):
    (got,) = formats.READERS[form](formats.WRITERS[form](FRAME))
    assert [a[0] for a in got["atoms"]] == ["Ti", "O"]
    for a, b in zip(got["atoms"], FRAME["atoms"], strict=True):
        assert a[1:4] == pytest.approx(b[1:4], abs=1e-6)
        if form in ("xsf", "xyz", "runner"):
            assert a[4:] == pytest.approx(b[4:], abs=1e-6)
    assert sum(got["cell"], []) == pytest.approx(sum(FRAME["cell"], []))
    if form in ("xsf", "xyz", "runner"):
        assert got["energy"] == pytest.approx(-3.5)


def test_isolated_and_animated_xsf():
    text = "# total energy = 1.0 eV\nATOMS\nH 0 0 0\nH 0 0 1\n\n# total energy = 2.0 eV\nATOMS\nH 0 0 0\nH 0 0 2\n"
    frames = formats.read_xsf(text)
    assert [f["energy"] for f in frames] == [1.0, 2.0]
    assert frames[1]["atoms"][1][3] == 2.0 and frames[0]["cell"] is None


def test_lammps_dump():
    text = "ITEM: TIMESTEP\n5\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n1 5\n0 4\n0 4\nITEM: ATOMS id element x y z fx fy fz\n2 O 2 2 2 0 0 1\n1 H 1 1 1 0 0 0\n"
    (f,) = formats.read_lammps(text)
    assert f["step"] == 5 and [a[0] for a in f["atoms"]] == ["H", "O"] and f["atoms"][0][1] == 0.0 and f["atoms"][1][6] == 1.0


def test_read_keeps_bad_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(formats.write_xyz(FRAME) * 2)
    (tmp_path / "b.xyz").write_text("many\natoms\n")
    rows = formats.read(spark, str(tmp_path))
    assert rows.where("error is not null").count() == 1
    frames, atoms = formats.frames_and_atoms(rows)
    assert frames.count() == 2 and atoms.count() == 4
    assert formats.as_text(rows, "vasp").where("frame = 1").first().text.startswith("structure")


def test_logs(spark, tmp_path):
    (tmp_path / "train.out").write_text("header\n   0   2.6E+00  <2.7E+00>  2.5E+00  2.8E+00 <\n   1   1.0  0.9  0.8  0.7 <\n")
    assert [r.epoch for r in logs.train_log(spark, str(tmp_path / "train.out")).orderBy("epoch").collect()] == [0, 1]
    (tmp_path / "predict.out").write_text("Cohesive energy : -1.5 eV\nTotal energy : -2.5 eV\nCohesive energy : -3.0 eV\nTotal energy : -4.0 eV\n")
    assert [(r.cohesive, r.total) for r in logs.predictions(spark, str(tmp_path / "predict.out")).orderBy("nth").collect()] == [(-1.5, -2.5), (-3.0, -4.0)]
