"""Readers and writers of structure files.

A reader takes a file's text and gives frames, dicts of ``cell`` (rows are lattice vectors; None without periodicity),
``energy`` (eV or None) and ``atoms``: (species, x, y, z, fx, fy, fz) in angstrom and eV/angstrom, forces None if absent.
:func:`read` runs readers in tasks, a file each, and keeps a bad file as a row with its error.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import BOHR_ANGSTROM, HARTREE_EV, RYDBERG_EV

Frame = dict
READERS: dict[str, Callable[[str], list[Frame]]] = {}
WRITERS: dict[str, Callable[[Frame], str]] = {}
#: Format by a part of the file's name, tried first, then by its extension.
NAMES = {"fort.34": "crystal", "fhiaims.out": "aimsout", "POSCAR": "vasp", "CONTCAR": "vasp", "XDATCAR": "xdatcar", "geometry.in": "aims", "str.out": "atat", "pw.out": "pw", "input.data": "runner", "vasprun.xml": "vasprun"}
EXTENSIONS = {"xsf": "xsf", "xyz": "xyz", "vasp": "vasp", "in": "aims", "aims": "aims", "gap": "gap", "dump": "lammps", "lammps": "lammps", "lmp": "lammps", "prism": "prism", "xml": "vasprun", "espresso": "espresso", "gui": "crystal", "arc": "tinker", "txyz": "tinker"}


def guess_format(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    for part, kind in NAMES.items():
        if part in name:
            return kind
    kind = EXTENSIONS.get(name.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"no format is known for {name}")
    return kind


def register(name: str, reader: Callable[[str], list[Frame]] | None = None, writer: Callable[[Frame], str] | None = None, extensions: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> None:
    """A format of one's own: readable with a reader, writable with a writer; known by extensions and parts of file names."""
    if reader:
        READERS[name] = reader
    if writer:
        WRITERS[name] = writer
    EXTENSIONS.update(dict.fromkeys(extensions, name))
    NAMES.update(dict.fromkeys(names, name))


def formats() -> list[tuple[str, bool, bool]]:
    """(name, readable, writable) of all formats."""
    return [(n, n in READERS, n in WRITERS) for n in sorted({*READERS, *WRITERS})]


def _reader(name: str):
    return lambda f: READERS.setdefault(name, f)


def _writer(name: str):
    return lambda f: WRITERS.setdefault(name, f)


def _atom(words: list[str], scale: float = 1.0, force: float = 1.0) -> tuple:
    """species x y z [fx fy fz]"""
    n = [float(w) for w in words[1:7]]
    xyz = [v * scale for v in n[:3]]
    return (words[0], *xyz, *([v * force for v in n[3:6]] if len(n) == 6 else [None] * 3))


def _frame(atoms: list, cell=None, energy=None) -> Frame:
    return {"cell": [list(map(float, v)) for v in cell] if cell is not None else None, "energy": energy, "atoms": [(str(a[0]), *[None if v is None else float(v) for v in a[1:]]) for a in atoms]}


def _cartesian(cell, frac) -> np.ndarray:
    return np.array(frac, float) @ np.array(cell, float)


@_reader("xsf")
def read_xsf(text: str) -> list[Frame]:
    """Periodic or isolated, with animation steps; the energy is that of the last comment before a frame's atoms."""
    lines = text.splitlines()
    frames, cell, energy, i = [], None, None, 0
    while i < len(lines):
        line = lines[i].strip()
        if m := re.search(r"total energy\s*=\s*(\S+)", line):
            energy = float(m[1])
        word = line.split()[0] if line else ""
        if word == "PRIMVEC":
            cell = [list(map(float, x.split()[:3])) for x in lines[i + 1 : i + 4]]
            i += 3
        elif word == "PRIMCOORD":
            n = int(lines[i + 1].split()[0])
            frames.append(_frame([_atom(x.split()) for x in lines[i + 2 : i + 2 + n]], cell, energy))
            energy, i = None, i + 1 + n
        elif word == "ATOMS":
            j = i + 1
            while j < len(lines) and len(lines[j].split()) >= 4 and not lines[j].lstrip().startswith("#"):
                j += 1
            frames.append(_frame([_atom(x.split()) for x in lines[i + 1 : j]], None, energy))
            energy, i = None, j - 1
        i += 1
    return frames


@_reader("xyz")
def read_xyz(text: str) -> list[Frame]:
    """Frames one after the other; a lattice and an energy in the comment line are taken if they are there."""
    lines, frames, i = text.splitlines(), [], 0
    while i < len(lines) and lines[i].strip():
        n, comment = int(lines[i].split()[0]), lines[i + 1]
        cell = re.search(r'Lattice="([^"]*)"', comment, re.I)
        energy = re.search(r"\benergy=\s*(\S+)", comment, re.I)
        box = np.array(cell[1].split(), float).reshape(3, 3) if cell else None
        frames.append(_frame([_atom(x.split()) for x in lines[i + 2 : i + 2 + n]], box, float(energy[1]) if energy else None))
        i += 2 + n
    return frames


@_reader("gap")
def read_gap(text: str) -> list[Frame]:
    """Extended XYZ whose frames must all have the same atoms."""
    frames = read_xyz(text)
    if any([a[0] for a in f["atoms"]] != [a[0] for a in frames[0]["atoms"]] for f in frames):
        raise ValueError("frames differ in their atoms")
    return frames


@_reader("vasp")
def read_poscar(text: str) -> list[Frame]:
    lines = text.splitlines()
    scale = float(lines[1].split()[0])
    cell = np.array([x.split()[:3] for x in lines[2:5]], float)
    if scale < 0:
        scale = (-scale / abs(np.linalg.det(cell))) ** (1 / 3)
    cell, at = cell * scale, 5
    names = None
    if not lines[5].split()[0].isdigit():
        names, at = lines[5].split(), 6
    counts = [int(x) for x in lines[at].split()]
    names = names or [f"X{k + 1}" for k in range(len(counts))]
    at += 1
    if lines[at].strip()[:1] in "Ss":
        at += 1
    fractional = lines[at].strip()[:1] not in "CcKk"
    xyz = np.array([x.split()[:3] for x in lines[at + 1 : at + 1 + sum(counts)]], float).reshape(-1, 3)
    xyz = xyz @ cell if fractional else xyz * scale
    species = [s for s, n in zip(names, counts, strict=True) for _ in range(n)]
    return [_frame([(s, *p, None, None, None) for s, p in zip(species, xyz.tolist(), strict=True)], cell)]


@_reader("xdatcar")
def read_xdatcar(text: str) -> list[Frame]:
    lines = text.splitlines()
    cell = np.array([x.split()[:3] for x in lines[2:5]], float) * float(lines[1].split()[0])
    species = [s for s, n in zip(lines[5].split(), lines[6].split(), strict=True) for _ in range(int(n))]
    frames = []
    for i, line in enumerate(lines):
        if line.lstrip().startswith("Direct"):
            xyz = _cartesian(cell, [x.split()[:3] for x in lines[i + 1 : i + 1 + len(species)]])
            frames.append(_frame([(s, *p, None, None, None) for s, p in zip(species, xyz.tolist(), strict=True)], cell))
    return frames


@_reader("vasprun")
def read_vasprun(text: str) -> list[Frame]:
    """All ionic steps, with the energy without entropy; where a step has none, that of its last electronic step."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(text)
    species = [c.find("c").text.strip() for c in root.find("atominfo/array[@name='atoms']/set")]
    rows = lambda e: [list(map(float, v.text.split())) for v in e] if e is not None else None
    frames = []
    for step in root.iter("calculation"):
        cell = rows(step.find("structure/crystal/varray[@name='basis']"))
        xyz = _cartesian(cell, rows(step.find("structure/varray[@name='positions']")))
        forces = rows(step.find("varray[@name='forces']")) or [[None] * 3] * len(species)
        e = step.find("energy/i[@name='e_wo_entrp']")
        if e is None:
            last = step.findall("scstep/energy/i[@name='e_0_energy']")
            e = last[-1] if last else None
        frames.append(_frame([(s, *p, *f) for s, p, f in zip(species, xyz.tolist(), forces, strict=True)], cell, float(e.text) if e is not None else None))
    return frames


@_reader("aims")
def read_aims(text: str) -> list[Frame]:
    cell, atoms, fractional = [], [], []
    for words in map(str.split, text.splitlines()):
        if words[:1] == ["lattice_vector"]:
            cell.append(words[1:4])
        elif words[:1] in (["atom"], ["atom_frac"]):
            atoms.append((words[4], *map(float, words[1:4]), None, None, None))
            fractional.append(words[0] == "atom_frac")
    if any(fractional):
        atoms = [(a[0], *_cartesian(cell, [a[1:4]])[0], *a[4:]) if f else a for a, f in zip(atoms, fractional, strict=True)]
    return [_frame(atoms, cell or None)]


@_reader("atat")
def read_atat(text: str) -> list[Frame]:
    """Axes as three vectors or as lengths and angles, then cell vectors and sites in their terms."""
    from ..functions.scalars import cell_from_parameters

    rows = [x.split() for x in text.splitlines() if x.split()]
    axes, at = (cell_from_parameters(*map(float, rows[0])), 1) if len(rows[0]) == 6 else ([list(map(float, r[:3])) for r in rows[:3]], 3)
    cell = _cartesian(axes, [r[:3] for r in rows[at : at + 3]])
    xyz = _cartesian(axes, [r[:3] for r in rows[at + 3 :]])
    return [_frame([(r[3], *p, None, None, None) for r, p in zip(rows[at + 3 :], xyz.tolist(), strict=True)], cell)]


@_reader("prism")
def read_prism(text: str) -> list[Frame]:
    """A comment, three cell lengths, then atomic numbers and places up to a line of -1."""
    lines = text.splitlines()
    cell = np.diag(np.array(lines[1].split()[:3], float))
    atoms = []
    for words in map(str.split, lines[2:]):
        if not words or words[0] == "-1":
            break
        atoms.append((words[0], *map(float, words[1:4]), None, None, None))
    return [_frame(atoms, cell)]


@_reader("lammps")
def read_lammps(text: str) -> list[Frame]:
    """Dump files; a box is periodic if all its sides are."""
    frames = []
    for part in text.split("ITEM: TIMESTEP")[1:]:
        lines = part.strip().splitlines()
        n = int(lines[lines.index("ITEM: NUMBER OF ATOMS") + 1])
        b = next(i for i, x in enumerate(lines) if x.startswith("ITEM: BOX BOUNDS"))
        bounds = np.array([(x.split() + ["0"])[:3] for x in lines[b + 1 : b + 4]], float)
        xy, xz, yz = bounds[:, 2]
        lo = bounds[:, 0] - [min(0, xy, xz, xy + xz), min(0, yz), 0]
        hi = bounds[:, 1] - [max(0, xy, xz, xy + xz), max(0, yz), 0]
        size = hi - lo
        cell = [[size[0], 0, 0], [xy, size[1], 0], [xz, yz, size[2]]]
        a = next(i for i, x in enumerate(lines) if x.startswith("ITEM: ATOMS"))
        names = lines[a].split()[2:]
        rows = [dict(zip(names, x.split(), strict=False)) for x in lines[a + 1 : a + 1 + n]]
        rows.sort(key=lambda r: int(r.get("id", 0)))
        kind = "element" if "element" in names else "type"
        if "xs" in names:
            xyz = _cartesian(cell, [[r["xs"], r["ys"], r["zs"]] for r in rows])
        else:
            xyz = np.array([[r["x"], r["y"], r["z"]] for r in rows], float) - lo
        atoms = [(r[kind], *p, *[r.get(f) for f in ("fx", "fy", "fz")]) for r, p in zip(rows, xyz.tolist(), strict=True)]
        frames.append(_frame(atoms, cell if lines[b].split()[-3:] == ["pp"] * 3 else None) | {"step": int(lines[0])})
    return frames


@_reader("runner")
def read_runner(text: str) -> list[Frame]:
    """Structures between begin and end, in Bohr and Hartree."""
    frames = []
    for part in re.findall(r"^begin\b(.*?)^end\b", text, re.M | re.S):
        cell, atoms, energy = [], [], None
        for w in map(str.split, part.splitlines()):
            if w[:1] == ["lattice"]:
                cell.append([float(v) * BOHR_ANGSTROM for v in w[1:4]])
            elif w[:1] == ["atom"]:
                atoms.append((w[4], *[float(v) * BOHR_ANGSTROM for v in w[1:4]], *[float(v) * HARTREE_EV / BOHR_ANGSTROM for v in w[7:10]]))
            elif w[:1] == ["energy"]:
                energy = float(w[1]) * HARTREE_EV
        frames.append(_frame(atoms, cell or None, energy))
    return frames


@_reader("pw")
def read_pw(text: str) -> list[Frame]:
    """Positions in units of the lattice parameter, their updates and those of the cell, energies in Rydberg and forces in
    Rydberg a Bohr."""
    alat = float(re.search(r"lattice parameter \(alat\)\s*=\s*(\S+)", text)[1]) * BOHR_ANGSTROM
    cell = np.array([re.search(rf"a\({k}\)\s*=\s*\(\s*(.*?)\s*\)", text)[1].split() for k in (1, 2, 3)], float) * alat
    first = re.findall(r"^\s+\d+\s+(\w+)\s+tau\(\s*\d+\)\s*=\s*\(\s*(.*?)\s*\)", text, re.M)
    species, xyz = [s for s, _ in first], np.array([p.split() for _, p in first], float) * alat
    frames = []
    updates = re.split(r"ATOMIC_POSITIONS", text)
    for k, part in enumerate(updates):
        if new := re.search(r"CELL_PARAMETERS\s*\(?\s*(\w+)?[^\n]*\n((?:\s*[-+.\dEe]+\s+[-+.\dEe]+\s+[-+.\dEe]+\s*\n){3})", updates[k - 1].rsplit("Begin final", 1)[-1] if k else ""):
            unit = re.search(r"CELL_PARAMETERS[^\n]*?alat\s*=\s*([-+.\dEe]+)", updates[k - 1])
            scale = float(unit[1]) * BOHR_ANGSTROM if unit else {"angstrom": 1.0, "bohr": BOHR_ANGSTROM}.get(new[1], alat)
            cell = np.array(new[2].split(), float).reshape(3, 3) * scale
        if frames:
            head, *rows = part.splitlines()
            pos = np.array([r.split()[1:4] for r in rows[: len(species)]], float)
            xyz = pos @ cell if "crystal" in head else pos * (alat if "alat" in head else BOHR_ANGSTROM if "bohr" in head else 1.0)
        energy = re.search(r"^!\s+total energy\s*=\s*(\S+)", part, re.M)
        found = re.findall(r"atom\s+\d+\s+type\s+\d+\s+force\s*=\s*(.*)", part)[: len(species)]
        forces = (np.array([f.split() for f in found], float) * RYDBERG_EV / BOHR_ANGSTROM).tolist() if len(found) == len(species) else [[None] * 3] * len(species)
        frames.append(_frame([(s, *p, *f) for s, p, f in zip(species, xyz.tolist(), forces, strict=True)], cell, float(energy[1]) * RYDBERG_EV if energy else None))
    return [f for f in frames if f["energy"] is not None] or frames[:1]


def _rows(frame: Frame, form: str = "%14.8f") -> list[str]:
    return ["%-3s %s" % (a[0], " ".join(form % v for v in a[1:] if v is not None)) for a in frame["atoms"]]


@_writer("xsf")
def write_xsf(frame: Frame) -> str:
    head = [f"# total energy = {frame['energy']!r} eV", ""] if frame["energy"] is not None else []
    if frame["cell"] is None:
        return "\n".join([*head, "ATOMS", *_rows(frame)]) + "\n"
    cell = [" ".join("%14.8f" % v for v in r) for r in frame["cell"]]
    return "\n".join([*head, "CRYSTAL", "PRIMVEC", *cell, "PRIMCOORD", f"{len(frame['atoms'])} 1", *_rows(frame)]) + "\n"


@_writer("xyz")
def write_xyz(frame: Frame) -> str:
    notes = []
    if frame["cell"] is not None:
        notes.append('Lattice="' + " ".join(repr(float(v)) for r in frame["cell"] for v in r) + '"')
    if frame["energy"] is not None:
        notes.append(f"energy={frame['energy']!r}")
    return "\n".join([str(len(frame["atoms"])), " ".join(notes), *_rows(frame)]) + "\n"


@_writer("vasp")
def write_poscar(frame: Frame) -> str:
    names = list(dict.fromkeys(a[0] for a in frame["atoms"]))
    frac = np.array([a[1:4] for a in frame["atoms"]]) @ np.linalg.inv(np.array(frame["cell"]))
    frac -= np.floor(frac)
    rows = ["%18.12f %18.12f %18.12f" % tuple(p) for s in names for a, p in zip(frame["atoms"], frac, strict=True) if a[0] == s]
    cell = [" ".join("%18.12f" % v for v in r) for r in frame["cell"]]
    return "\n".join(["structure", "1.0", *cell, " ".join(names), " ".join(str(sum(a[0] == s for a in frame["atoms"])) for s in names), "Direct", *rows]) + "\n"


@_writer("aims")
def write_aims(frame: Frame) -> str:
    cell = ["lattice_vector " + " ".join("%14.8f" % v for v in r) for r in frame["cell"] or []]
    return "\n".join([*cell, *["atom " + " ".join("%14.8f" % v for v in a[1:4]) + " " + a[0] for a in frame["atoms"]]]) + "\n"


@_writer("pdb")
def write_pdb(frame: Frame, attribute: list[float] | None = None) -> str:
    """With a number of each atom in the place of the temperature factor, such as an uncertainty; 0 without."""
    factor = attribute or [0.0] * len(frame["atoms"])
    rows = ["HETATM%5d %-4s UNK     1    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s" % (i + 1, a[0], *a[1:4], 1.0, v, a[0]) for i, (a, v) in enumerate(zip(frame["atoms"], factor, strict=True))]
    return "\n".join([*rows, "END"]) + "\n"


@_writer("runner")
def write_runner(frame: Frame) -> str:
    cell = ["lattice " + " ".join("%.10f" % (v / BOHR_ANGSTROM) for v in r) for r in frame["cell"] or []]
    atoms = ["atom " + " ".join("%.10f" % (v / BOHR_ANGSTROM) for v in a[1:4]) + f" {a[0]} 0.0 0.0 " + " ".join("%.10f" % ((v or 0.0) * BOHR_ANGSTROM / HARTREE_EV) for v in a[4:7]) for a in frame["atoms"]]
    return "\n".join(["begin", *cell, *atoms, "energy %.10f" % ((frame["energy"] or 0.0) / HARTREE_EV), "charge 0.0", "end"]) + "\n"


SCHEMA = "path string, frame int, cell array<array<double>>, energy double, atoms array<struct<species:string,x:double,y:double,z:double,fx:double,fy:double,fz:double>>, error string, step long"
#: What a text that isn't of its format raises.
FAILURES = (ValueError, IndexError, KeyError, TypeError, AttributeError, StopIteration, SyntaxError)
_ATOM = ("species", "x", "y", "z", "fx", "fy", "fz")


def as_rows(path: str, frames: list[Frame]) -> list[tuple]:
    return [(path, k, f["cell"], f["energy"], [dict(zip(_ATOM, a, strict=True)) for a in f["atoms"]], None, f.get("step")) for k, f in enumerate(frames)]


def as_pandas(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["path", "frame", "cell", "energy", "atoms", "error", "step"]).astype({"frame": "Int32", "step": "Int64"})


def parse(files: DataFrame, form: str | None = None) -> DataFrame:
    """Frames of rows (path, content), content being bytes; see SCHEMA."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += as_rows(path, READERS[form or guess_format(path)](bytes(content).decode("utf-8", "replace")))
                except FAILURES as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}", None))
            yield as_pandas(rows)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, paths: str | list[str], form: str | None = None) -> DataFrame:
    """Frames of structure files, a row each (see SCHEMA); a file that can't be read is a row with ``error``."""
    return parse(spark.read.format("binaryFile").load(paths), form)


def frames_and_atoms(read_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms): one row a frame and one an atom, by path and frame."""
    good = read_rows.where("error is null")
    frames = good.select("path", "frame", "cell", "energy", F.size("atoms").alias("n_atoms"), F.col("cell").isNotNull().alias("pbc"))
    return frames, good.select("path", "frame", F.posexplode("atoms").alias("aid", "a")).select("path", "frame", "aid", "a.*")


def _plain(value):
    """None for NaN, which is how pandas hands over nulls."""
    return None if value is None or value != value else float(value)


def as_text(read_rows: DataFrame, form: str) -> DataFrame:
    """(path, frame, text, error): each frame in a format; one that the format can't hold has an error in place of a text."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, k, cell, energy, atoms in zip(pdf["path"], pdf["frame"], pdf["cell"], pdf["energy"], pdf["atoms"], strict=True):
                frame = {"cell": None if cell is None else [list(map(float, v)) for v in cell], "energy": _plain(energy), "atoms": [(a["species"], *[_plain(a[c]) for c in _ATOM[1:]]) for a in atoms]}
                try:
                    out.append((path, k, WRITERS[form](frame), None))
                except FAILURES as e:
                    out.append((path, k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "frame", "text", "error"])

    return read_rows.where("error is null").select("path", "frame", "cell", "energy", "atoms").mapInPandas(run, "path string, frame int, text string, error string")


def write(read_rows: DataFrame, folder: str, form: str, apart: bool = True) -> None:
    """Frames in a format as text files under a folder, written by tasks through Spark, so that any file system will do.

    A folder of its own for each frame, or with ``apart`` False one file a task with its frames one after the other, which is
    how formats of several frames are read again and the only way for very many of them. A frame that the format can't
    hold stops the writing.
    """
    texts = as_text(read_rows, form)
    checked = F.regexp_replace(F.coalesce("text", F.raise_error(F.concat(F.lit("a frame can't be written: "), "error")).cast("string")), r"\n\z", "").alias("value")
    if not apart:
        return texts.select(checked).write.text(folder)
    name = F.concat(F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"[^A-Za-z0-9_.-]", "_"), F.lit("-"), F.format_string("%06d", "frame"))
    return texts.select(name.alias("sid"), checked).write.partitionBy("sid").text(folder)
