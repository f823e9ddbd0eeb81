import math

import numpy as np
import pytest

from atomspan.functions.elements import MASSES, NUMBERS, SYMBOLS
from atomspan.functions.scalars import BOHR_ANGSTROM, HARTREE_EV, KCAL_PER_MOL_EV, RYDBERG_EV
from atomspan.sources import archives, codes, formats, logs

CELL = [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 6.0]]
SKEW = [[4.0, 0.0, 0.0], [1.0, 5.0, 0.0], [0.5, 0.7, 6.0]]
ATOMS = [("Ti", 0.5, 1.0, 1.5, 0.1, 0.2, 0.3), ("O", 2.0, 2.5, 3.0, -0.1, 0.0, 0.25)]


def frame(cell=CELL, energy=-3.5):
    return {"cell": cell, "energy": energy, "atoms": ATOMS}


def distances(f):
    p = np.array([a[1:4] for a in f["atoms"]], float)
    d = (p[1] - p[0]) @ np.linalg.inv(np.array(f["cell"])) if f["cell"] else p[1] - p[0]
    return np.linalg.norm((d - np.rint(d)) @ np.array(f["cell"])) if f["cell"] else np.linalg.norm(d)


def test_elements():
    assert len(SYMBOLS) == len(set(SYMBOLS)) == 118 and NUMBERS["Ti"] == 22 and NUMBERS["U"] == 92 and NUMBERS["Og"] == 118
    assert MASSES["O"] == pytest.approx(15.999) and MASSES["U"] == pytest.approx(238.03) and MASSES["Hg"] == pytest.approx(200.59)


@pytest.mark.parametrize("form", ["espresso", "crystal", "atat", "lammps", "tinker"])
@pytest.mark.parametrize("cell", [CELL, SKEW])
def test_round_trips_of_periodic_structures(form, cell):
    (got,) = formats.READERS[form](formats.WRITERS[form](frame(cell)))
    assert [a[0] for a in got["atoms"]] == ["Ti", "O"]
    a, b = (np.array(f["cell"]) for f in (got, frame(cell)))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-4) and distances(got) == pytest.approx(distances(frame(cell)), abs=1e-4)


@pytest.mark.parametrize("form", ["lammps", "tinker", "prism", "pdb", "lammps-data"])
def test_writers_take_structures_without_a_cell(form):
    text = formats.WRITERS[form](frame(None, None))
    if form in ("lammps", "tinker"):
        (got,) = formats.READERS[form](text)
        assert got["cell"] is None and distances(got) == pytest.approx(distances(frame(None)), abs=1e-4)
    assert text.endswith("\n")


def test_writers_refuse_what_they_can_not_hold():
    for form in ("espresso", "crystal", "atat"):
        with pytest.raises(ValueError):
            formats.WRITERS[form](frame(None))
    with pytest.raises(ValueError):
        formats.WRITERS["prism"](frame(SKEW))
    text = formats.WRITERS["prism"](frame(CELL))
    assert text.splitlines()[1].split() == ["4.00000000", "5.00000000", "6.00000000"] and formats.READERS["prism"](text)[0]["atoms"][0][1] == 0.5
    data = formats.WRITERS["lammps-data"](frame(SKEW)).splitlines()
    assert "2 atoms" in data and any(x.split()[-3:] == ["xy", "xz", "yz"] for x in data if x) and any(x.split() == ["1", "47.86700000"] for x in data)
    assert formats.write_pdb(frame(), [1.25, 2.5]).splitlines()[1][60:66] == "  2.50"


def test_espresso_inputs():
    text = "&control\n calculation='scf' ! a note\n/\n&system\n ibrav=2, celldm(1)=10.0, nat=2, ntyp=2, nosym=.true.\n/\nATOMIC_POSITIONS {crystal}\nSi 0.0 0.0 0.0\nC 0.25 0.25 0.25\n"
    assert codes.namelist(text) == {"ibrav": 2, "celldm(1)": 10.0, "nat": 2, "ntyp": 2, "nosym": True} and codes.namelist(text, "control") == {"calculation": "scf"}
    (f,) = codes.read_espresso(text)
    a = 10 * BOHR_ANGSTROM
    assert abs(np.linalg.det(f["cell"])) == pytest.approx(a**3 / 4) and np.linalg.norm(f["atoms"][1][1:4]) == pytest.approx(a * math.sqrt(3) / 4)
    free = "&SYSTEM\n ibrav = 0\n A = 3.0, nat = 1 /\nCELL_PARAMETERS (alat)\n1 0 0\n0 2 0\n0 0 3\nATOMIC_POSITIONS (bohr)\nH 1 1 1\n"
    (f,) = codes.read_espresso(free)
    assert np.allclose(f["cell"], np.diag([3, 6, 9])) and f["atoms"][0][1] == pytest.approx(BOHR_ANGSTROM)
    volumes = {1: 1, 2: 1 / 4, 3: 1 / 2, 4: math.sqrt(3) / 2 * 1.5, 6: 1.5, 7: 0.75, 8: 1.2 * 1.5, 9: 0.9, 10: 0.45, 11: 0.9}
    for kind, v in volumes.items():
        cell, _ = codes.bravais({"ibrav": kind, "celldm(1)": 1 / BOHR_ANGSTROM, "celldm(2)": 1.2, "celldm(3)": 1.5})
        assert abs(np.linalg.det(cell)) == pytest.approx(v), kind
    for kind in (5, -5):
        cell, _ = codes.bravais({"ibrav": kind, "a": 2.0, "celldm(4)": 0.3})
        assert np.allclose(np.array(cell) @ np.array(cell).T, 4 * np.array([[1, 0.3, 0.3], [0.3, 1, 0.3], [0.3, 0.3, 1]]))
    cell, _ = codes.bravais({"ibrav": 14, "a": 2.0, "celldm(2)": 1.2, "celldm(3)": 1.5, "celldm(4)": 0.1, "celldm(5)": 0.2, "celldm(6)": 0.3})
    assert np.allclose(np.array(cell) @ np.array(cell).T, [[4, 0.48, 1.2], [0.48, 5.76, 2.16], [1.2, 2.16, 9]])
    for kind, c in ((12, "celldm(4)"), (-12, "celldm(5)"), (13, "celldm(4)")):
        cell, _ = codes.bravais({"ibrav": kind, "a": 1.0, "celldm(2)": 1.2, "celldm(3)": 1.5, c: 0.2})
        assert abs(np.linalg.det(cell)) == pytest.approx(1.8 * math.sqrt(0.96) / (2 if kind == 13 else 1))
    with pytest.raises(ValueError):
        codes.bravais({"ibrav": 99})
    with pytest.raises(ValueError):
        codes.read_espresso(text.replace("ATOMIC", "CELL_PARAMETERS\n1 0 0\n0 1 0\n0 0 1\nATOMIC"))


def test_crystal_geometries_are_expanded():
    # Two operations: the identity, and an inversion through the middle of a cubic cell.
    eye, inv = "1 0 0\n0 1 0\n0 0 1\n0 0 0\n", "-1 0 0\n0 -1 0\n0 0 -1\n2 2 2\n"
    text = f"3 1 1\n4 0 0\n0 4 0\n0 0 4\n2\n{eye}{inv}2\n 8 0.4 0.8 1.2\n 222 1.0 1.0 1.0\n"
    (f,) = codes.read_crystal(text)
    got = [(a[0], *[round(v, 6) for v in a[1:4]]) for a in f["atoms"]]
    assert got == [("O", 0.4, 0.8, 1.2), ("O", 1.6, 1.2, 0.8), ("Ti", 1.0, 1.0, 1.0)]


def test_aims_outputs():
    geometry = "  Input geometry:\n  | Unit cell:\n  |  4.0 0.0 0.0\n  |  0.0 4.0 0.0\n  |  0.0 0.0 4.0\n  | Atomic structure:\n  |       Atom                x [A]            y [A]            z [A]\n  |    1: Species H             0.0 0.0 0.0\n  |    2: Species H             0.0 0.0 0.7\n\n"
    step = "  Begin self-consistency loop: x\n  Self-consistency cycle converged.\n  | Total energy corrected        :         {e} eV  <-- extrapolated\n  Total atomic forces (unitary forces cleaned) [eV/Ang]:\n  |    1          0.0  0.0 {f}\n  |    2          0.0  0.0 -{f}\n"
    move = "  Updated atomic structure:\n                         x [A]             y [A]             z [A]\n  lattice_vector 4.1 0 0\n  lattice_vector 0 4.1 0\n  lattice_vector 0 0 4.1\n            atom         0.0 0.0 0.0  H\n            atom         0.0 0.0 0.8  H\n"
    frames = codes.read_aims_output(geometry + step.format(e="-30.5", f="0.5") + move + step.format(e="-31.0", f="0.1") + "          Have a nice day.\n")
    assert [f["energy"] for f in frames] == [-30.5, -31.0] and [f["atoms"][1][3] for f in frames] == [0.7, 0.8]
    assert [f["atoms"][1][6] for f in frames] == [-0.5, -0.1] and [f["cell"][0][0] for f in frames] == [4.0, 4.1]
    md = "  Molecular dynamics time step\n" + geometry + "  | Total energy, T -> 0          :         -1.0 Ha         -27.2 eV\n  Total atomic forces [eV/Ang]:\n  |    1          0.0  0.0 0.3\n  |    2          0.0  0.0 -0.3\n  Atomic structure (and velocities) as used in the preceding time step:\n            atom         0.0 0.0 0.0  H\n            velocity 0 0 0\n            atom         0.0 0.0 0.9  H\n"
    (f,) = codes.read_aims_output(md)
    assert f["energy"] == -27.2 and f["atoms"][1][3] == 0.9 and f["atoms"][0][6] == 0.3


def test_runs_of_several_files(spark, tmp_path):
    folder = tmp_path / "cp"
    folder.mkdir()
    (folder / "run.out").write_text(" alat = 10.0\n a1 = 10.0 0.0 0.0\n a2 = 0.0 10.0 0.0\n a3 = 0.0 0.0 10.0\n\n ATOMIC_POSITIONS\n O 0 0 0\n H 1 0 0\n\n")
    (folder / "run.pos").write_text("  10  0.1\n 0 0 0\n 1 0 0\n  20  0.2\n 0 0 0\n 2 0 0\n")
    (folder / "bad.pos").write_text("1 2 3\n")
    rows = codes.read_runs(spark, str(folder), "cp").orderBy("path", "frame").collect()
    assert rows[0].error is not None and [r.atoms[1].x for r in rows[1:]] == pytest.approx([BOHR_ANGSTROM, 2 * BOHR_ANGSTROM])
    assert [a.species for a in rows[1].atoms] == ["O", "H"] and rows[1].cell[0][0] == pytest.approx(10 * BOHR_ANGSTROM)
    t = tmp_path / "tinker"
    t.mkdir()
    two = lambda v: "2 x\n 1 O 0.0 0.0 0.0 1\n 2 H 0.0 0.0 %s 2\n" % v
    (t / "w.arc").write_text(two("1.0") + two("1.5"))
    (t / "w.frc").write_text(two("2.0") + two("0.5D+01"))
    (t / "w.key").write_text("parameters x\nA-AXIS 9.0\nB-axis 8.0\nc-axis 7.0\n")
    (t / "w.out").write_text(" Simulation Time 0.1\n Potential Energy -3.0 Kcal\n Frame Number 1\n Potential Energy -4.0 Kcal\n Temperature 300.0 K\n Frame Number 2\n")
    rows = codes.read_runs(spark, str(t), "tinker").orderBy("frame").collect()
    assert [r.energy for r in rows] == pytest.approx([-3 * KCAL_PER_MOL_EV, -4 * KCAL_PER_MOL_EV]) and rows[1].atoms[1].fz == pytest.approx(5 * KCAL_PER_MOL_EV)
    assert rows[0].cell[1][1] == pytest.approx(8.0) and codes.tinker_log((t / "w.out").read_text())[1]["temperature"] == 300.0
    assert codes.tinker_cell("nothing") is None


def test_lammps_dumps_meet_their_logs(spark, tmp_path):
    from atomspan.operators import structures

    dump = "".join(f"ITEM: TIMESTEP\n{s}\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 4\n0 4\n0 4\nITEM: ATOMS id type xs ys zs\n1 1 0.5 0.5 0.5\n" for s in (0, 10, 15))
    (tmp_path / "a.dump").write_text(dump)
    (tmp_path / "one.log").write_text("---------------- Step        0 ----- CPU = 0.0 (sec) ----------------\nTotEng   =      -1.5 KinEng = 0.0\n---------------- Step       10 ----- CPU = 0.1 (sec) ----------------\nTotEng   =      -2.5 KinEng = 0.1\n")
    (tmp_path / "two.log").write_text("Step Temp TotEng Press\n   0  300.0  -1.5  1.0\n  10  301.0  -2.5  1.0\nLoop time\n")
    frames = formats.read(spark, str(tmp_path / "a.dump"))
    for name in ("one.log", "two.log"):
        got = structures.merge_log(frames, codes.lammps_log(spark, str(tmp_path / name)).select("step", "energy"))
        assert {r.step: r.energy for r in got.collect()} == {0: -1.5, 10: -2.5, 15: None}


def test_vasp_files():
    xml = "<modeling><atominfo><array name='atoms'><set><rc><c>Si </c><c>1</c></rc></set></array></atominfo>" + "".join(f"<calculation><scstep><energy><i name='e_0_energy'>-9.0</i></energy></scstep><scstep><energy><i name='e_0_energy'>-8.5</i></energy></scstep><structure><crystal><varray name='basis'><v>2 0 0</v><v>0 2 0</v><v>0 0 2</v></varray></crystal><varray name='positions'><v>0.5 0 {z}</v></varray></structure><varray name='forces'><v>0 0 1</v></varray>{e}</calculation>" for z, e in ((0.25, "<energy><i name='e_wo_entrp'>-7.5</i></energy>"), (0.5, ""))) + "</modeling>"
    one, two = formats.read_vasprun(xml)
    assert (one["energy"], two["energy"]) == (-7.5, -8.5) and two["atoms"][0][1:4] == (1.0, 0.0, 1.0) and one["atoms"][0][6] == 1.0
    text = "x\n1.0\n2 0 0\n0 2 0\n0 0 2\nSi O\n1 1\nDirect configuration= 1\n0 0 0\n0.5 0.5 0.5\nDirect configuration= 2\n0 0 0.1\n0.5 0.5 0.5\n"
    frames = formats.read_xdatcar(text)
    assert len(frames) == 2 and frames[1]["atoms"][0][3] == pytest.approx(0.2) and [a[0] for a in frames[0]["atoms"]] == ["Si", "O"]


def test_pw_outputs_with_updates_of_the_cell():
    text = "     lattice parameter (alat)  =      10.0000  a.u.\n     a(1) = (   1.0   0.0   0.0 )\n     a(2) = (   0.0   1.0   0.0 )\n     a(3) = (   0.0   0.0   1.0 )\n         1           H   tau(   1) = (   0.1   0.0   0.0  )\n         2           H   tau(   2) = (   0.2   0.0   0.0  )\n!    total energy              =     -2.0 Ry\n     atom    1 type  1   force =     0.1    0.0    0.0\n     atom    2 type  1   force =    -0.1    0.0    0.0\nCELL_PARAMETERS (alat= 10.00000000)\n   2.0   0.0   0.0\n   0.0   1.0   0.0\n   0.0   0.0   1.0\n\nATOMIC_POSITIONS (crystal)\nH   0.25 0.0 0.0\nH   0.50 0.0 0.0\n\n!    total energy              =     -3.0 Ry\n"
    one, two = formats.read_pw(text)
    a = 10 * BOHR_ANGSTROM
    assert one["energy"] == pytest.approx(-2 * RYDBERG_EV) and two["energy"] == pytest.approx(-3 * RYDBERG_EV)
    assert one["cell"][0][0] == pytest.approx(a) and two["cell"][0][0] == pytest.approx(2 * a) and two["atoms"][0][1] == pytest.approx(a / 2)
    assert one["atoms"][0][4] == pytest.approx(0.1 * RYDBERG_EV / BOHR_ANGSTROM) and two["atoms"][0][4] is None


def test_small_formats():
    (f,) = formats.read_atat("4 5 6 90 90 90\n1 0 0\n0 1 0\n0 0 2\n0.5 0.5 0.5 Ti\n")
    assert np.allclose(f["cell"], np.diag([4, 5, 12])) and f["atoms"][0][1:4] == pytest.approx((2.0, 2.5, 3.0))
    (p,) = formats.read_prism("note\n 4 5 6\n22 1.0 2.0 3.0 1.0 0.08\n-1\n")
    assert p["cell"][2][2] == 6.0 and p["atoms"][0][1:4] == (1.0, 2.0, 3.0)
    same = '2\nLattice="1 0 0 0 1 0 0 0 1" energy=-1.5\nH 0 0 0\nH 0 0 1\n'
    assert [f["energy"] for f in formats.read_gap(same * 2)] == [-1.5, -1.5]
    with pytest.raises(ValueError):
        formats.read_gap(same + same.replace("H 0 0 1", "O 0 0 1"))
    runner = "begin\nlattice 1 0 0\nlattice 0 1 0\nlattice 0 0 1\natom 0 0 1 H 0 0 0 0 1\nenergy 2.0\nend\n"
    a, b = formats.read_runner(runner + runner.replace("2.0", "3.0"))
    assert b["energy"] == pytest.approx(3 * HARTREE_EV) and a["atoms"][0][3] == pytest.approx(BOHR_ANGSTROM)
    (frac,) = formats.read_aims("lattice_vector 2 0 0\nlattice_vector 0 2 0\nlattice_vector 0 0 2\natom_frac 0.5 0.5 0.5 C\natom 1.5 0 0 C\n")
    assert frac["atoms"][0][1:4] == (1.0, 1.0, 1.0) and frac["atoms"][1][1] == 1.5
    assert formats.guess_format("a/POSCAR.1") == "vasp" and formats.guess_format("x/fort.34") == "crystal"
    with pytest.raises(ValueError):
        formats.guess_format("a.unknown")
    formats.register("mine", lambda text: [], None, ("mine",))
    assert formats.guess_format("a.mine") == "mine" and ("mine", True, False) in formats.formats()


def test_frames_are_written_and_read_again(spark, tmp_path):
    rows = archives.records(spark, [frame(), frame() | {"energy": -4.0}])
    formats.write(rows, str(tmp_path / "apart"), "xsf")
    back = formats.read(spark, str(tmp_path / "apart" / "*" / "*.txt"), "xsf")
    assert sorted(r.energy for r in back.collect()) == [-4.0, -3.5]
    formats.write(rows.coalesce(1), str(tmp_path / "whole"), "xyz", apart=False)
    assert sorted((r.frame, r.energy) for r in formats.read(spark, str(tmp_path / "whole" / "*.txt"), "xyz").collect()) == [(0, -3.5), (1, -4.0)]
    bad = archives.records(spark, [frame(None)])
    assert formats.as_text(bad, "vasp").first().error is not None
    with pytest.raises(Exception, match="can't be written"):
        formats.write(bad, str(tmp_path / "no"), "crystal")


def test_sources(spark, tmp_path):
    import tarfile

    (tmp_path / "a.xsf").write_text(formats.write_xsf(frame()))
    (tmp_path / "b.txt").write_text("no structure")
    for name in ("one.tar", "two.tar.gz"):
        with tarfile.open(tmp_path / name, "w:gz" if name.endswith("gz") else "w") as tar:
            tar.add(tmp_path / "a.xsf", "d/a.xsf")
            tar.add(tmp_path / "a.xsf", "d/a.xsf")
            tar.add(tmp_path / "b.txt", "d/b.txt")
    found = archives.members(spark, [str(tmp_path / "one.tar"), str(tmp_path / "two.tar.gz")], (".xsf",)).orderBy("archive", "idx").collect()
    assert [r.path.rsplit("/", 1)[-1] for r in found] == ["a.xsf@member=0", "a.xsf@member=1"] * 2
    read = archives.structures(spark, [str(tmp_path / "one.tar"), str(tmp_path / "a.xsf")])
    assert read.where("error is null").count() == 3 and read.where("error is not null").count() == 1
    own = archives.structures(spark, [frame() | {"name": "x"}, frame() | {"name": "x"}, frame()])
    assert sorted((r.path, r.frame) for r in own.collect()) == [("structure_000002", 0), ("x", 0), ("x", 1)]
    assert archives.structures(spark, frame()).count() == 1 and archives.structures(spark, own) is own
    for bad in ([], ["a", frame()], [1], [{"atoms": []}]):
        with pytest.raises(ValueError):
            archives.structures(spark, bad)
    with pytest.raises(ValueError):
        archives.structures(spark, spark.range(1))
    loaded = archives.load(spark, ["1", "2", "x"], lambda i: [formats._frame([("H", float(i), 0, 0, None, None, None)])])
    assert {r.path: r.error is None for r in loaded.collect()} == {"1": True, "2": True, "x": False}
    assert {r.name for r in archives.named(own).collect()} == {"x", "structure_000002"}


def test_prediction_logs_and_tables(spark, tmp_path):
    (tmp_path / "p.out").write_text(" O 0.1 0.2 0.3 1.0 2.0 3.0 -1.5\n H 0.0 0.0 1.0 -1.0 -2.0 -3.0 -0.5\n Cohesive energy : -2.0 eV\n Total energy : -9.0 eV\n O 0.1 0.2 0.3\n Cohesive energy : -3.0 eV\n Total energy : -8.0 eV\n")
    rows = logs.atom_predictions(spark, str(tmp_path / "p.out")).orderBy("nth", "aid").collect()
    assert [(r.nth, r.aid, r.species, r.fz) for r in rows] == [(0, 0, "O", 3.0), (0, 1, "H", -3.0), (1, 0, "O", None)]
    assert rows[1].e_atom == -0.5 and math.isnan(rows[2].e_atom)
    (tmp_path / "energies.test").write_text("# Ref(eV) ANN(eV) #atoms Cost Func Path\n 1.0 2.0 3 0.5 ./a.xsf\n 4.0 5.0 6 0.25 ./b.xsf\n")
    t = logs.energy_table(spark, str(tmp_path / "energies.test"))
    assert t.columns == ["Ref(eV)", "ANN(eV)", "atoms", "Cost-Func", "Path"] and sorted(r["Cost-Func"] for r in t.collect()) == [0.25, 0.5]
    assert logs.energy_table(spark, str(tmp_path / "energies.test"), ["a", "b"]).columns == ["a", "b", "path"]
    text = "set\nF\n1.0\n0.0\n2\nTi O\n-1.0 -2.0\n3\n2\n-5.0 -1.0 -3.0\n./s1.xsf\n2 2\n-4.0\n1\n0.0 0.0 0.0\n0.1 0.2 0.3\n2\n0.5 0.6\n2\n1.0 0.0 0.0\n0.0 0.0 0.0\n2\n0.7 0.8\n./s2.xsf\n1 1\n-2.0\n2\n0.0 0.0 0.0\n0.0 0.0 0.0\n2\n0.1 0.2\n"
    (tmp_path / "set.ascii").write_text(text)
    got = logs.training_set(spark, str(tmp_path / "set.ascii")).orderBy("nth").collect()
    assert [(r.structure, r.energy, len(r.atoms)) for r in got] == [("./s1.xsf", -4.0, 2), ("./s2.xsf", -2.0, 1)]
    assert [a.species for a in got[0].atoms] == ["Ti", "O"] and got[0].atoms[1].fingerprint == [0.7, 0.8] and got[0].atoms[0].fz == 0.3
