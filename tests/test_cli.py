import json

import numpy as np
import pytest

from atomspan import cli
from atomspan.sources import datasets, formats

CELL = [[4.0, 0.0, 0.0], [1.0, 5.0, 0.0], [0.0, 0.0, 6.0]]


def put(folder, name, cell, energy, atoms):
    (folder / name).write_text(formats.write_xsf({"cell": cell, "energy": energy, "atoms": [(*a, 0.0, 0.0, 0.1) for a in atoms]}))


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "a.xsf", CELL, -5.0, [("O", 0.1, 0.2, 0.3), ("H", 1.0, 1.0, 1.0)])
    put(tmp_path, "b.xsf", None, -6.0, [("O", 0.0, 0.0, 0.0), ("H", 1.0, 0.0, 0.0), ("H", 0.0, 1.0, 0.0)])
    return tmp_path


def test_tools(spark, folder, capsys):
    files = [str(folder / n) for n in ("a.xsf", "b.xsf")]
    cli.main(["formats"], spark)
    assert "xsf            read   write" in capsys.readouterr().out
    cli.main(["info", *files], spark)
    out = capsys.readouterr().out
    assert "a.xsf: 1 frames, 2 atoms, periodic" in out and "b.xsf: 1 frames, 3 atoms, isolated" in out
    cli.main(["references", *files], spark)
    assert json.loads(capsys.readouterr().out)["energies"] == pytest.approx({"H": -1.0, "O": -4.0})
    cli.main(["featurise", *files, "--out", str(folder / "set"), "--species", "H,O", "--radial", "3,1", "--angular", "3,1", "--references", '{"H": -1.0}'], spark)
    assert json.loads(capsys.readouterr().out) == {"structures": 2} and datasets.load(spark, str(folder / "set")).atoms.count() == 5


def test_conversion(spark, folder):
    cli.main(["convert", *[str(folder / n) for n in ("a.xsf", "b.xsf")], "--to", "xyz", "--out", str(folder / "out"), "--supercell", "2,1,1", "--shift", "1,0,0", "--sort"], spark)
    rows = {len(r.atoms): r for r in formats.read(spark, str(folder / "out" / "*" / "*.txt"), "xyz").collect()}
    assert sorted(rows) == [3, 4] and np.allclose(rows[4].cell, np.diag([2, 1, 1]) @ np.array(CELL)) and rows[3].cell is None
    assert [a.species for a in rows[4].atoms] == ["H", "H", "O", "O"] and sorted(a.x for a in rows[3].atoms) == [1.0, 1.0, 2.0]
    assert all(r.energy is None for r in rows.values())
    cli.main(["convert", str(folder / "a.xsf"), "--to", "xyz", "--out", str(folder / "same")], spark)
    assert formats.read(spark, str(folder / "same" / "*" / "*.txt"), "xyz").first().energy == -5.0


def test_tools_of_ones_own(monkeypatch, tmp_path, capsys):
    (tmp_path / "extra_tools.py").write_text("from atomspan import cli\n\n@cli.tool('hello', lambda p: p.add_argument('name'))\ndef hello(spark, args):\n    print('hello', args.name)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("ATOMSPAN_TOOLS", "extra_tools")
    cli.discovered.cache_clear()
    cli.main(["hello", "you"], spark=object())
    assert capsys.readouterr().out == "hello you\n"
    cli.TOOLS.pop("hello")
    cli.discovered.cache_clear()
