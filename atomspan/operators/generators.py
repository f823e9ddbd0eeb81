"""Structures made from structures: every generator is an explode of a small step table over atom rows.

Where atoms have a column ``cell`` (rows are lattice vectors), it is changed with them, so that neighbours under periodic
boundaries stay right. Energies and forces (columns energy, fx, fy, fz) that no longer hold become null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types

from ..functions.scalars import cell_matrix, determinant, inverse, matrix_times, wrap
from ._whole import in_structures, portions


def _steps(low: float, high: float, n: int):
    """n evenly spaced numbers from low to high as an array column; the step is kept as ``step``."""
    values = [low] if n == 1 else [low + (high - low) * k / (n - 1) for k in range(n)]
    return F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("step", "s")


def clear_labels(atoms: DataFrame) -> DataFrame:
    """Energies and forces of another structure become null."""
    return atoms.withColumns({c: F.lit(None).cast(t) for c, t in atoms.dtypes if c in ("energy", "fx", "fy", "fz")})


def rows_times(cell, m):
    """A 3x3 matrix of columns times another, as an array<array<double>> column; entries of ``m`` are columns or numbers."""
    return F.array(*[F.array(*[v.cast("double") for v in matrix_times(row, m)]) for row in cell])


def deform(df: DataFrame, gradient: list[list], keep_labels: bool = False) -> DataFrame:
    """Places x, y, z and lattice vectors ``cell``, where ``df`` has them, as row vectors times a matrix of columns or
    numbers: fractional coordinates stay. Labels are cleared unless they are kept."""
    new = {}
    if "x" in df.columns:
        new |= {c: p for c, p in zip("xyz", matrix_times([F.col("x"), F.col("y"), F.col("z")], gradient), strict=True)}
    if "cell" in df.columns:
        new["cell"] = rows_times(cell_matrix(), gradient)
    return (df if keep_labels else clear_labels(df)).withColumns(new)


def _diagonal(x, y, z) -> list[list]:
    return [[x, 0.0, 0.0], [0.0, y, 0.0], [0.0, 0.0, z]]


def displacements(atoms: DataFrame, size: float, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, moved, axis, the atoms' other columns): one structure for each atom and axis, with that atom moved along it."""
    atoms = clear_labels(atoms)
    who = atoms.select(*keys, F.col("aid").alias("moved"), F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("axis"))
    new = {c: F.when((F.col("aid") == F.col("moved")) & (F.col("axis") == c), F.col(c) + size).otherwise(F.col(c)) for c in "xyz"}
    return who.join(atoms, list(keys)).withColumns(new)


def supercell(atoms: DataFrame, cell: list[list[float]] | None, na: int, nb: int, nc: int) -> DataFrame:
    """Images na x nb x nc of each atom; aid counts the images of an atom one after the other. The cell is a matrix of
    numbers, or each row's column ``cell``; a column ``cell`` becomes that of the supercell."""
    n = na * nb * nc
    rows = clear_labels(atoms)
    for name, k in (("ia", na), ("ib", nb), ("ic", nc)):
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    shift = matrix_times([F.col("ia"), F.col("ib"), F.col("ic")], cell or cell_matrix())
    number = F.col("aid") * n + (F.col("ia") * nb + F.col("ib")) * nc + F.col("ic")
    new = {"aid": number} | {c: F.col(c) + s for c, s in zip("xyz", shift, strict=True)}
    if "cell" in atoms.columns:
        new["cell"] = F.array(*[F.array(*[v * k for v in row]) for row, k in zip(cell_matrix(), (na, nb, nc), strict=True)])
    return rows.withColumns(new)


def isotropic(atoms: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """Atoms and cells at n scales of all lengths, from low to high; volumes go with the cube."""
    return deform(atoms.select("*", _steps(low, high, n)), _diagonal(*[F.col("s")] * 3))


def scaled(atoms: DataFrame, factors: tuple[float, ...]) -> DataFrame:
    """Atoms scaled by one factor, or by one for each lattice vector (rows with a ``cell``) or axis (rows without).

    Labels are kept, as the same structure is meant in other units.
    """
    f = [float(factors[0])] * 3 if len(factors) == 1 else list(map(float, factors))
    if len(f) != 3:
        raise ValueError("scaling takes one factor or three")
    plain = [F.col(c) * k for c, k in zip("xyz", f, strict=True)]
    if "cell" not in atoms.columns:
        return atoms.withColumns(dict(zip("xyz", plain, strict=True)))
    m = cell_matrix()
    frac = matrix_times([F.col("x"), F.col("y"), F.col("z")], inverse(m))
    grown = [[v * k for v in row] for row, k in zip(m, f, strict=True)]
    new = {c: F.when(F.col("cell").isNull(), a).otherwise(b) for c, a, b in zip("xyz", plain, matrix_times(frac, grown), strict=True)}
    return atoms.withColumns(new | {"cell": F.when(F.col("cell").isNotNull(), F.array(*[F.array(*row) for row in grown]))})


def uniaxial(atoms: DataFrame, axis: str, low: float, high: float, n: int, keep_volume: bool = False) -> DataFrame:
    """Atoms and cells strained by n factors along an axis; the others stay or shrink as s^-1/2, which keeps the volume."""
    other = 1 / F.sqrt("s") if keep_volume else F.lit(1.0)
    return deform(atoms.select("*", _steps(low, high, n)), _diagonal(*[F.col("s") if c == axis else other for c in "xyz"]))


def _plain(axes: str) -> list[list]:
    return [[F.lit(float(i == j)) for j in range(3)] for i in range(3)], ["xyz".index(c) for c in axes]


def shear(atoms: DataFrame, plane: str, low: float, high: float, n: int) -> DataFrame:
    """Simple shear in a plane such as xy by n amounts: the first coordinate's multiple is added to the second."""
    m, (a, b) = _plain(plane)
    m[a][b] = F.col("s")
    return deform(atoms.select("*", _steps(low, high, n)), m)


def orthorhombic(atoms: DataFrame, low: float, high: float, n: int, axes: str = "xyz") -> DataFrame:
    """Factors 1 + s, 1 - s and 1 / (1 - s^2) along the axes in the order given; the volume stays."""
    m, (a, b, c) = _plain(axes)
    m[a][a], m[b][b], m[c][c] = 1 + F.col("s"), 1 - F.col("s"), 1 / (1 - F.col("s") * F.col("s"))
    return deform(atoms.select("*", _steps(low, high, n)), m)


def monoclinic(atoms: DataFrame, low: float, high: float, n: int, axes: str = "xyz") -> DataFrame:
    """Engineering shear s: half of it both ways in the plane of the first two axes, and 1 + s^2 / (4 - s^2) along the
    third; the volume stays."""
    m, (a, b, c) = _plain(axes)
    s = F.col("s")
    m[a][b] = m[b][a] = s / 2
    m[c][c] = 1 + s * s / (4 - s * s)
    return deform(atoms.select("*", _steps(low, high, n)), m)


def interpolate(first: DataFrame, last: DataFrame, n: int, keys: tuple[str, ...] = ("sid", "aid"), middle: DataFrame | None = None) -> DataFrame:
    """n + 2 frames from one to the other: straight, or the parabola through a third structure at one half."""
    b = last.select(*keys, *[F.col(c).alias(f"{c}1") for c in "xyz"])
    rows = first.join(b, list(keys))
    if middle is not None:
        rows = rows.join(middle.select(*keys, *[F.col(c).alias(f"{c}m") for c in "xyz"]), list(keys))
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n + 1)))).withColumn("t", F.col("frame") / F.lit(float(n + 1)))
    t = F.col("t")
    if middle is None:
        new = {c: F.col(c) + t * (F.col(f"{c}1") - F.col(c)) for c in "xyz"}
    else:
        new = {c: F.col(c) * (2 * t - 1) * (t - 1) + F.col(f"{c}m") * 4 * t * (1 - t) + F.col(f"{c}1") * t * (2 * t - 1) for c in "xyz"}
    return rows.withColumns(new).drop(*[f"{c}1" for c in "xyz"], *[f"{c}m" for c in "xyz"])


def update_cell(atoms: DataFrame, old: list[list[float]] | None, new: list[list[float]], keep_fractional: bool = True) -> DataFrame:
    """Atoms in another cell, with their fractional coordinates or their places kept; labels are cleared. The old cell is a
    matrix of numbers or each row's column ``cell``, which becomes the new one."""
    rows = clear_labels(atoms)
    values = {}
    if keep_fractional:
        back = inverse(cell_matrix()) if old is None else np.linalg.inv(np.array(old)).tolist()
        values = {c: p for c, p in zip("xyz", matrix_times(matrix_times([F.col("x"), F.col("y"), F.col("z")], back), new), strict=True)}
    if "cell" in atoms.columns:
        values["cell"] = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in new])
    return rows.withColumns(values) if values else rows


def wrap_to_cell(atoms: DataFrame) -> DataFrame:
    """Atoms moved into the cell of their column ``cell``."""
    m = cell_matrix()
    frac = [wrap(f) for f in matrix_times([F.col("x"), F.col("y"), F.col("z")], inverse(m))]
    return atoms.withColumns({c: p for c, p in zip("xyz", matrix_times(frac, m), strict=True)})


def volume(frames: DataFrame) -> DataFrame:
    """With ``volume``: the signed volume of the column ``cell``."""
    return frames.withColumn("volume", determinant(cell_matrix()))


def rotate(atoms: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Atoms, cells and forces turned by a matrix for row vectors, as of :func:`~..functions.scalars.rotation` or
    :func:`~..functions.scalars.rotation_between`."""
    rows = deform(atoms, matrix, keep_labels=True)
    if not {"fx", "fy", "fz"} <= set(atoms.columns):
        return rows
    return rows.withColumns({c: p for c, p in zip(("fx", "fy", "fz"), matrix_times([F.col("fx"), F.col("fy"), F.col("fz")], matrix), strict=True)})


def translate(atoms: DataFrame, shift: tuple[float, float, float] | str, keys: tuple[str, ...] = ("sid",), reference: int | None = None) -> DataFrame:
    """Atoms moved by a vector; or so that their centre, or the atom with aid ``reference``, comes to the origin ("origin") or
    to the middle of the column ``cell`` ("box")."""
    if not isinstance(shift, str):
        return atoms.withColumns({c: F.col(c) + v for c, v in zip("xyz", shift, strict=True)})
    if shift not in ("origin", "box"):
        raise ValueError(f"atoms can be moved to the origin or the box, not to {shift}")
    if shift == "box" and "cell" not in atoms.columns:
        raise ValueError("only atoms with a cell can be moved to the middle of the box")
    from_ = centre(atoms, keys) if reference is None else atoms.where(F.col("aid") == reference).select(*keys, "x", "y", "z")
    rows = atoms.join(from_.withColumnsRenamed({c: f"__{c}" for c in "xyz"}), list(keys))
    half = matrix_times([F.lit(0.5)] * 3, cell_matrix()) if shift == "box" else [F.lit(0.0)] * 3
    return rows.withColumns({c: F.col(c) - F.col(f"__{c}") + h for c, h in zip("xyz", half, strict=True)}).drop("__x", "__y", "__z")


def centre(atoms: DataFrame, keys: tuple[str, ...] = ("sid",), mass: str | None = None) -> DataFrame:
    """(keys, x, y, z): the mean place, or the centre of mass."""
    if mass is None:
        return atoms.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return atoms.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(mass) * F.col(c)), F.sum(mass)).alias(c) for c in "xyz"])


#: Rows that a task of :func:`_displaced` makes at a time; one structure may be more.
MADE_ROWS = 1 << 16


def _displaced(atoms: DataFrame, make, rms: float, n: int, seed: int, sid: str) -> DataFrame:
    """n structures each whose atoms are moved by what ``make(atoms, rng)`` gives for a number of atoms: (n, atoms, 3), without
    the centre's move and scaled to the rms. A structure's atoms come together in one task, which moves many structures at a
    time; the numbers depend on seed and structure only."""
    names = [sid, "aid", "species", "x", "y", "z", *(["cell"] if "cell" in atoms.columns else [])]
    kept = atoms.select(*names)
    schema = types.StructType([*kept.schema.fields, types.StructField("copy", types.IntegerType())])

    def run(batch, starts):
        given = batch.column(0).take(pa.array(starts[:-1])).to_pylist()
        size = np.diff(starts)
        for i, j in portions(size * n, MADE_ROWS):
            m, own = size[i:j], batch.slice(starts[i], starts[j] - starts[i])
            first = starts[i:j] - starts[i]
            d = np.empty((n, own.num_rows, 3))
            for key, at, k in zip(given[i:j], first, m, strict=True):
                d[:, at : at + k] = make(int(k), np.random.default_rng([seed, zlib.crc32(str(key).encode())]))
            d -= np.repeat(np.add.reduceat(d, first, 1) / m[:, None], m, 1)
            far = np.sqrt(np.add.reduceat((d**2).sum(2), first, 1) / m)
            d *= np.repeat(np.where(far > 0, rms / np.where(far > 0, far, 1), 0), m, 1)[:, :, None]
            for k in range(n):
                moved = [pc.add(own.column(c).cast(pa.float64()), pa.array(d[k, :, c - 3])).cast(own.column(c).type) for c in (3, 4, 5)]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *moved, *own.columns[6:], pa.array(np.full(own.num_rows, k, np.int32))], names=schema.names)

    return in_structures(kept.repartition(sid), (sid,), ("aid", "species", "x", "y", "z"), run if n else lambda batch, starts: iter(()), schema)


def orthogonal_moves(atoms: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """n random moves of all atoms (n, atoms, 3), without a move of the centre and orthogonal to each other; at most
    3 * atoms - 3 of them are."""
    if n > 3 * atoms - 3:
        raise ValueError(f"{atoms} atoms have no more than {3 * atoms - 3} orthogonal moves")
    d = rng.normal(size=(n, atoms, 3))
    d -= d.mean(1, keepdims=True)
    return np.linalg.qr(d.reshape(n, -1).T)[0].T.reshape(n, atoms, 3)


def random_displacements(atoms: DataFrame, rms: float, n: int, seed: int, sid: str = "sid", orthogonal: bool = False) -> DataFrame:
    """n structures each with Gaussian moves of all atoms, without a move of the centre, scaled to the given rms; with
    ``orthogonal`` the moves of a structure are orthogonal to each other."""

    make = lambda k, rng: orthogonal_moves(k, n, rng) if orthogonal else rng.normal(size=(n, k, 3))
    return _displaced(atoms, make, rms, n, seed, sid)


def d_optimal_moves(atoms: int, n: int, rng: np.random.Generator, steps: int = 200, ridge: float = 1e-6) -> np.ndarray:
    """n moves of unit length (n, atoms, 3) without a move of the centre whose log-determinant of D D' + ridge is as large as
    projected gradient ascent makes it; it starts from random moves, than which it never ends lower."""
    d = rng.normal(size=(n, atoms, 3))
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    flat = unit((d - d.mean(1, keepdims=True)).reshape(n, -1))
    value = lambda v: np.linalg.slogdet(v @ v.T + ridge * np.eye(n))[1]
    best, now, step = flat, value(flat), 0.1
    for _ in range(steps):
        slope = 2 * np.linalg.solve(best @ best.T + ridge * np.eye(n), best)
        slope = slope.reshape(n, atoms, 3)
        slope = (slope - slope.mean(1, keepdims=True)).reshape(n, -1)
        slope -= (slope * best).sum(1, keepdims=True) * best  # along the sphere
        trial = unit(best + step * slope)
        if (found := value(trial)) > now:
            best, now, step = trial, found, step * 1.2
        else:
            step /= 2
            if step < 1e-8:
                break
    return best.reshape(n, atoms, 3)


def d_optimal_displacements(atoms: DataFrame, rms: float, n: int, seed: int, sid: str = "sid") -> DataFrame:
    """n structures each with moves as different from each other as :func:`d_optimal_moves` makes them."""
    return _displaced(atoms, lambda k, rng: d_optimal_moves(k, n, rng), rms, n, seed, sid)


def kabsch(pairs: DataFrame, sid: str = "sid") -> DataFrame:
    """(sid, rmsd, rotation) of rows (sid, x, y, z, rx, ry, rz) onto their references, centred.

    Sums of products are made in the cluster; a structure's 3x3 matrix is decomposed on its own.
    """
    a, b = ("x", "y", "z"), ("rx", "ry", "rz")
    sums = pairs.groupBy(sid).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in (*a, *b)], *[F.covar_pop(p, q).alias(f"c{i}{j}") for i, p in enumerate(a) for j, q in enumerate(b)], *[F.var_pop(c).alias(f"v{c}") for c in (*a, *b)])
    kind = dict(pairs.dtypes)[sid]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                u, s, vt = np.linalg.svd(np.array([[r[f"c{i}{j}"] for j in range(3)] for i in range(3)]))
                sign = np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0
                s[-1] *= sign
                u[:, -1] *= sign
                total = sum(r[f"v{c}"] for c in (*a, *b)) - 2 * s.sum()
                rows.append((r[sid], float(np.sqrt(max(total, 0.0))), (u @ vt).ravel().tolist()))
            yield pd.DataFrame(rows, columns=[sid, "rmsd", "rotation"])

    return sums.mapInPandas(run, f"{sid} {kind}, rmsd double, rotation array<double>")
