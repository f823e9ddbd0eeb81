"""Structures seen and changed as wholes: coordinates, cells, images, surroundings of atoms, alignment.

Atoms are rows (keys..., aid, species, x, y, z), with a column ``cell`` where they are periodic (rows are lattice vectors).
Functions that compare the atoms of a structure in sequence work in one task a structure; all others are expressions and
joins.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types

from ..functions.scalars import cell_matrix, determinant, inverse, matrix_times, wrap
from .generators import centre, clear_labels
from .spatial import image_range

_XYZ = ("x", "y", "z")


def _place() -> list[Column]:
    return [F.col(c) for c in _XYZ]


def _length(v: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in v]))


def _dot(a: list, b: list) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list, b: list) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


# Coordinates and cells


def fractional(atoms: DataFrame, into_cell: bool = False) -> DataFrame:
    """With u, v, w: coordinates in terms of the column ``cell``; ``into_cell``: in [0, 1)."""
    f = matrix_times(_place(), inverse(cell_matrix()))
    return atoms.withColumns({c: wrap(x) if into_cell else x for c, x in zip("uvw", f, strict=True)})


def cartesian(atoms: DataFrame) -> DataFrame:
    """x, y, z from the columns u, v, w and ``cell``."""
    return atoms.withColumns(dict(zip(_XYZ, matrix_times([F.col(c) for c in "uvw"], cell_matrix()), strict=True)))


def lattice(df: DataFrame) -> DataFrame:
    """With a, b, c (lengths of the vectors in ``cell``), alpha, beta, gamma (degrees) and ab, ac, bc (areas)."""
    m = cell_matrix()
    size = [_length(v) for v in m]
    angle = lambda i, j: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(m[i], m[j]) / (size[i] * size[j])))))
    area = lambda i, j: _length(_cross(m[i], m[j]))
    return df.withColumns({"a": size[0], "b": size[1], "c": size[2], "alpha": angle(1, 2), "beta": angle(0, 2), "gamma": angle(0, 1), "ab": area(0, 1), "ac": area(0, 2), "bc": area(1, 2)})


def standard_cell(df: DataFrame) -> DataFrame:
    """The cell with its first vector along x and its second in the xy plane, and atoms turned with it; lengths, angles and
    fractional coordinates stay. Forces, which would have to be turned as well, become null."""
    m = cell_matrix()
    a = _length(m[0])
    b1, c1 = _dot(m[1], m[0]) / a, _dot(m[2], m[0]) / a
    b2 = F.sqrt(F.greatest(_dot(m[1], m[1]) - b1 * b1, F.lit(0.0)))
    c2 = (_dot(m[1], m[2]) - b1 * c1) / b2
    c3 = F.sqrt(F.greatest(_dot(m[2], m[2]) - c1 * c1 - c2 * c2, F.lit(0.0)))
    new = [[a, F.lit(0.0), F.lit(0.0)], [b1, b2, F.lit(0.0)], [c1, c2, c3]]
    values = {"cell": F.array(*[F.array(*row) for row in new])}
    if "x" in df.columns:
        values |= dict(zip(_XYZ, matrix_times(matrix_times(_place(), inverse(m)), new), strict=True))
    values |= {c: F.lit(None).cast("double") for c in ("fx", "fy", "fz") if c in df.columns}
    return df.withColumns(values)


def fix_atoms(atoms: DataFrame, numbers: list[int] | None = None, mask: Column | None = None) -> DataFrame:
    """With ``fixed``: whether an atom is held; by a list of numbers from 1, or by a condition."""
    return atoms.withColumn("fixed", (F.col("aid") + 1).isin(list(numbers or [])) if mask is None else F.coalesce(mask, F.lit(False)))


def add_vacuum(atoms: DataFrame, amount: float, direction: int = 3, keys: tuple[str, ...] = ("sid",), perpendicular: bool = True, boundary: float | None = 0.2) -> DataFrame:
    """Periodic structures with room along a lattice vector (1, 2 or 3), which is made longer; structures without a cell in a
    box of their extents and ``amount``.

    ``perpendicular``: the amount is measured across the other two vectors. ``boundary``: atoms nearer than that to the cell's
    ends in this direction stand at both of them, with numbers after the others'; None leaves them alone.
    Labels are cleared. Without a column ``cell`` all structures are boxed.
    """
    rows = clear_labels(atoms)
    if "cell" not in rows.columns:
        return _boxed(rows, amount, keys)
    k = direction - 1
    m = cell_matrix()
    others = [m[i] for i in range(3) if i != k]
    normal = _cross(*others)
    depth = F.abs(_dot(m[k], normal)) / _length(normal) if perpendicular else _length(m[k])
    grown = F.array(*[F.array(*[v * ((depth + amount) / depth) if i == k else v for v in row]) for i, row in enumerate(m)])
    slab = fractional(rows.where(F.col("cell").isNotNull()), into_cell=True)
    if boundary is not None:
        w = F.col("uvw"[k])
        near = F.lit(boundary) / _length(m[k])
        step = F.when(F.abs(w) < near, F.array(F.lit(0.0), F.lit(1.0))).when(F.abs(w - 1) < near, F.array(F.lit(0.0), F.lit(-1.0))).otherwise(F.array(F.lit(0.0)))
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__s") != 0, "aid")).cast("int") - 1
        slab = slab.withColumn("__s", F.explode(step)).withColumn("uvw"[k], w + F.col("__s"))
        slab = cartesian(slab).withColumn("__n", number).withColumn("aid", F.col("__n").cast(dict(atoms.dtypes)["aid"])).drop("__s", "__n")
    slab = slab.withColumn("cell", grown).drop("u", "v", "w")
    return slab.unionByName(_boxed(rows.where(F.col("cell").isNull()), amount, keys))


def _boxed(atoms: DataFrame, amount: float, keys: tuple[str, ...]) -> DataFrame:
    ends = atoms.groupBy(*keys).agg(*[(F.max(c) - F.min(c) + amount).alias(f"__l{c}") for c in _XYZ], *[F.avg(c).alias(f"__m{c}") for c in _XYZ])
    rows = atoms.join(ends, list(keys))
    box = F.array(*[F.array(*[F.col(f"__l{c}") if c == d else F.lit(0.0) for d in _XYZ]) for c in _XYZ])
    moved = {c: F.col(c) - F.col(f"__m{c}") + F.col(f"__l{c}") / 2 for c in _XYZ}
    return rows.withColumns(moved | {"cell": box}).select(*atoms.columns, *([] if "cell" in atoms.columns else ["cell"]))


# Images


def _greedy(rows: DataFrame, keys: tuple[str, ...], tolerance: float, order: list[str], periodic: bool) -> DataFrame:
    """Of a structure's places in u, v, w those nearer than ``tolerance`` to none that is kept before, in the order given."""

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        f = pdf[["u", "v", "w"]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(f)):
            d = f[kept] - f[i]
            if periodic:
                d -= np.rint(d)
            if not len(kept) or np.sqrt((d * d).sum(1)).min() >= tolerance:
                kept.append(i)
        return pdf.iloc[kept]

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def remove_redundant(atoms: DataFrame, tolerance: float = 0.05, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Atoms without images of atoms before them (by aid): those within ``tolerance``, in fractional coordinates, of one that
    is kept, across the cell's ends as well."""
    return _greedy(fractional(atoms, into_cell=True), keys, tolerance, ["aid"], True).select(*atoms.columns)


def drop_repeated_ghosts(found: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Edges of which the same neighbour in the same image is there once for each atom."""
    return found.dropDuplicates([*keys, "i", "j", *[c for c in ("ox", "oy", "oz") if c in found.columns]])


def symmetry_equivalent(atoms: DataFrame, operations: list[tuple[list[list[float]], list[float]]], tolerance: float = 1e-4, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """All atoms that symmetry operations (S, T), on fractional coordinates as columns S r + T, make of those given; one that is
    nearer than ``tolerance`` to one made before, by aid and operation, is left out. aid counts them from 0."""
    ops = F.array(*[F.struct(F.lit(k).alias("op"), *[F.lit(float(v)).alias(f"s{i}{j}") for i, row in enumerate(s) for j, v in enumerate(row)], *[F.lit(float(v)).alias(f"t{i}") for i, v in enumerate(t)]) for k, (s, t) in enumerate(operations)])
    rows = fractional(clear_labels(atoms)).withColumn("__o", F.explode(ops))
    f = [F.col(c) for c in "uvw"]
    made = {c: wrap(_dot([F.col(f"__o.s{i}{j}") for j in range(3)], f) + F.col(f"__o.t{i}")) for i, c in enumerate("uvw")}
    rows = rows.withColumns(made).withColumn("__op", F.col("__o.op")).drop("__o")
    kept = cartesian(_greedy(rows, keys, tolerance, ["aid", "__op"], False))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("aid", "__op")) - 1
    return kept.withColumn("__n", number).withColumn("aid", F.col("__n").cast(dict(atoms.dtypes)["aid"])).select(*atoms.columns)


def transform_cell(atoms: DataFrame, matrix: list[list[float]], keys: tuple[str, ...] = ("sid",), tolerance: float = 0.05) -> DataFrame:
    """Structures in the basis matrix * cell, with as many atoms as its volume has; sorted by species, then by the third
    fractional coordinate, and numbered anew. Labels are cleared.

    A matrix of whole numbers repeats each atom by the lattice vectors within the new cell, which are counted out
    beforehand; any other one (to a smaller cell, say) takes images around and leaves out redundant ones. Rows whose
    number of atoms doesn't come out whole raise an error.
    """
    t = np.array(matrix, float)
    size = abs(np.linalg.det(t))
    if size < 1e-9:
        raise ValueError("the new lattice vectors lie in a plane")
    back = np.linalg.inv(t)
    exact = np.allclose(t, np.rint(t))
    reach = [int(math.ceil(np.abs(t[:, k]).sum())) + (0 if exact else 1) for k in range(3)]
    shifts = np.array(list(product(*[range(-r, r + 1) for r in reach])))
    if exact:
        inside = shifts @ back
        shifts = shifts[((inside > -1e-9) & (inside < 1 - 1e-9)).all(1)]
        assert len(shifts) == round(size)
    rows = fractional(clear_labels(atoms)).withColumn("__n", F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(c) for c, v in zip("uvw", s, strict=True)]) for s in shifts])))
    new = [wrap(x) for x in matrix_times([F.col(c) + F.col(f"__n.{c}") for c in "uvw"], back.tolist())]
    m = cell_matrix()
    cell = F.array(*[F.array(*[_dot([F.lit(float(v)) for v in row], [m[k][j] for k in range(3)]) for j in range(3)]) for row in t])
    rows = rows.withColumns(dict(zip("uvw", new, strict=True)) | {"cell": cell}).drop("__n")
    if not exact:
        rows = _greedy(rows.withColumn("__a", F.col("aid")), keys, tolerance, ["__a", "u", "v", "w"], True).drop("__a")
        want = atoms.groupBy(*keys).agg((F.count("*") * size).alias("__want"))
        have = rows.groupBy(*keys).agg(F.count("*").alias("__have")).join(want, list(keys))
        whole = F.abs(F.col("__have") - F.col("__want")) < 0.01
        rows = rows.join(have.select(*keys, F.when(whole, True).otherwise(F.raise_error(F.lit("the transformation leaves no whole number of atoms")).cast("boolean")).alias("__ok")), list(keys)).where("__ok").drop("__ok")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("species", "w", "u", "v")) - 1
    return cartesian(rows).withColumn("__n", number).withColumn("aid", F.col("__n").cast(dict(atoms.dtypes)["aid"])).select(*atoms.columns)


# Surroundings of atoms


def neighbours_of(found: DataFrame, i: int) -> DataFrame:
    """Edges from one atom."""
    return found.where(F.col("i") == i)


def neighbour_lists(found: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, n, neighbours): each atom's edges as an array of (d, j, species, place relative to it, image), nearest first.
    An array holds one atom's neighbours, whose number the cutoff bounds."""
    image = [F.col(c) for c in ("ox", "oy", "oz") if c in found.columns]
    one = F.struct("d", "j", F.col("species_j").alias("species"), "dx", "dy", "dz", *image)
    return found.groupBy(*keys, "i").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("neighbours"))


def environments(atoms: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Every atom with its neighbours (:func:`neighbour_lists`) at their places, moved into its image; without itself. An atom
    without neighbours has an empty array."""
    own = atoms.select(*keys, F.col("aid").alias("i"), "species", "x", "y", "z")
    lists = own.join(neighbour_lists(found, keys).drop("n"), [*keys, "i"], "left")
    placed = F.transform("neighbours", lambda e: F.struct(e["j"].alias("j"), e["species"].alias("species"), (F.col("x") + e["dx"]).alias("x"), (F.col("y") + e["dy"]).alias("y"), (F.col("z") + e["dz"]).alias("z"), e["d"].alias("d")))
    empty = F.array().cast("array<struct<j:int,species:string,x:double,y:double,z:double,d:double>>")
    return lists.withColumn("neighbours", F.coalesce(placed, empty))


def neighbour_cluster(atoms: DataFrame, found: DataFrame, i: int, cutoff: float | None = None, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, aid, species, x, y, z): an atom, as number 0 and at its place, and its neighbours, nearest first, as structures
    without a cell; of a sphere of radius ``cutoff`` at most."""
    own = atoms.where(F.col("aid") == i).select(*keys, "species", "x", "y", "z")
    near = neighbours_of(found, i) if cutoff is None else neighbours_of(found, i).where(F.col("d") <= cutoff)
    around = own.withColumnRenamed("species", "__s").join(near.select(*keys, F.col("species_j").alias("species"), "dx", "dy", "dz", "d", "j"), list(keys))
    placed = around.select(*keys, "species", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in _XYZ], "d", F.col("j").alias("__j"))
    both = own.select(*keys, "species", "x", "y", "z", F.lit(-1.0).alias("d"), F.lit(-1).alias("__j")).unionByName(placed)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("d", "__j", "x", "y", "z")) - 1
    return both.select(*keys, number.alias("aid"), "species", "x", "y", "z")


def image_distances(atoms: DataFrame, i: int, j: int, cutoff: float, keys: tuple[str, ...] = ("sid",), pbc: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """(keys, ox, oy, oz, d): distances up to the cutoff from atom i to all images of atom j, in the column ``cell``.

    Fractional coordinates only say how many images to look at; distances are of places, so that one of just the cutoff isn't
    rounded beyond it.
    """
    m = cell_matrix()
    a = atoms.where(F.col("aid") == i).select(*keys, "cell", *[F.col(c).alias(f"{c}1") for c in _XYZ])
    b = atoms.where(F.col("aid") == j).select(*keys, *_XYZ)
    pair = fractional(a.join(b, list(keys)).withColumns({c: F.col(c) - F.col(f"{c}1") for c in _XYZ}))
    span = image_range(m, cutoff, pbc)
    for c, o, s in zip("uvw", ("ox", "oy", "oz"), span, strict=True):
        reach = s + F.ceil(F.abs(F.col(c))).cast("int")
        pair = pair.withColumn(o, F.explode(F.sequence(-reach, reach)) if pbc["uvw".index(c)] else F.lit(0))
    d = _length([p + s for p, s in zip(_place(), matrix_times([F.col(o) for o in ("ox", "oy", "oz")], m), strict=True)])
    rows = pair.withColumn("d", d).where(F.col("d") <= cutoff).select(*keys, "ox", "oy", "oz", "d")
    return rows.where("ox != 0 or oy != 0 or oz != 0") if i == j else rows


def diameter(atoms: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, diameter): the largest distance of two atoms of a structure without a cell; 0 for a single atom, and null for
    structures with a cell.

    Pairs are of atoms of different numbers. Not all of them are looked at: some pair is as far apart as the first atom and the
    one farthest from it, and the ends of a wider pair lie together at least as far from the centre, so atoms nearer to it than that
    allows are left out beforehand.
    """
    c = centre(atoms, keys).withColumnsRenamed({k: f"m{k}" for k in _XYZ})
    first = atoms.groupBy(*keys).agg(F.min_by(F.struct("aid", *_XYZ), "aid").alias("__first"))
    gap = lambda other: _length([F.col(k) - other(k) for k in _XYZ])
    far = atoms.join(c, list(keys)).join(first, list(keys)).withColumn("r", gap(lambda k: F.col(f"m{k}")))
    known = F.max(F.when(F.col("aid") != F.col("__first.aid"), gap(lambda k: F.col(f"__first.{k}"))))
    bound = far.groupBy(*keys).agg(known.alias("w"), F.max("r").alias("rmax"))
    ends = far.join(bound, list(keys)).where(F.col("r") >= F.col("w") - F.col("rmax") - 1e-9)
    a = ends.select(*keys, "aid", "x", "y", "z")
    b = a.select(*keys, F.col("aid").alias("bid"), *[F.col(k).alias(f"b{k}") for k in _XYZ])
    d = _length([F.col(k) - F.col(f"b{k}") for k in _XYZ])
    widest = a.join(b, list(keys)).where("aid < bid").groupBy(*keys).agg(F.max(d).alias("diameter"))
    every = atoms.groupBy(*keys).agg((F.max(F.col("cell").isNotNull()) if "cell" in atoms.columns else F.lit(False)).alias("__pbc"))
    return every.join(widest, list(keys), "left").select(*keys, F.when(~F.col("__pbc"), F.coalesce("diameter", F.lit(0.0))).alias("diameter"))


def centre_of_mass(atoms: DataFrame, mass: str, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, x, y, z): the centre of mass; with a column ``cell``, that of the most compact choice of images.

    For each atom as a start, the others are taken in the image that is nearest to it; of these choices the one with the
    smallest mean distance to its centre counts, ties to the first atom. That is the compactest choice of all wherever a
    structure is smaller than half its cell, at the cost of pairs and not of all combinations.
    """
    if "cell" not in atoms.columns:
        return centre(atoms, keys, mass)
    schema = types.StructType([*[f for f in atoms.schema.fields if f.name in keys], *[types.StructField(c, types.DoubleType()) for c in _XYZ]])

    def run(pdf):
        pdf = pdf.sort_values("aid")
        m, r, cell = pdf[mass].to_numpy(float), pdf[list(_XYZ)].to_numpy(float), pdf["cell"].iloc[0]
        best = (np.inf, r)
        if cell is not None:
            box = np.array([list(v) for v in cell], float)
            f = r @ np.linalg.inv(box)
            for k in range(len(f)):
                d = f - f[k]
                own = (f[k] + d - np.rint(d)) @ box
                spread = np.linalg.norm(own - np.average(own, axis=0, weights=m), axis=1).mean()
                if spread < best[0] - 1e-9:
                    best = (spread, own)
        out = pdf.iloc[:1][list(keys)].copy()
        out[list(_XYZ)] = np.average(best[1], axis=0, weights=m)
        return out

    return atoms.select(*keys, "aid", "x", "y", "z", "cell", mass).groupBy(*keys).applyInPandas(run, schema)


# Alignment


def _nearest(df: DataFrame, reference: list[str]) -> DataFrame:
    """x, y, z in the image, by whole lattice vectors of ``cell``, that is nearest to the reference columns."""
    m = cell_matrix()
    back = inverse(m)
    f = matrix_times(_place(), back)
    g = matrix_times([F.col(c) for c in reference], back)
    shift = [F.rint(a - b) for a, b in zip(g, f, strict=True)]
    return df.withColumns({c: F.col(c) + s for c, s in zip(_XYZ, matrix_times(shift, m), strict=True)})


def align_to(atoms: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Atoms moved by lattice vectors to where they are nearest to the atoms with their aid in another structure. Keys of
    the other are matched where it has them; atoms that it lacks are left out."""
    on = [k for k in (*keys, "aid") if k in other.columns]
    ref = other.select(*on, *[F.col(c).alias(f"__r{c}") for c in _XYZ])
    return _nearest(atoms.join(ref, on), [f"__r{c}" for c in _XYZ]).select(*atoms.columns)


def align_frame(atoms: DataFrame, reference: int, keys: tuple[str, ...] = ("sid",), frame: str = "frame") -> DataFrame:
    """All frames aligned to one of them."""
    return align_to(atoms, atoms.where(F.col(frame) == reference).select(*keys, "aid", "x", "y", "z"), keys)


def align_frames(atoms: DataFrame, keys: tuple[str, ...] = ("sid",), frame: str = "frame", constant_cell: bool = True) -> DataFrame:
    """Each frame's atoms moved by lattice vectors to be nearest to the aligned frame before it.

    With a constant cell the shifts between given frames add up, as a running sum for each atom; with a cell that changes,
    each atom's frames are gone through in one task.
    """
    if constant_cell:
        m = cell_matrix()
        back = inverse(m)
        steps = Window.partitionBy(*keys, "aid").orderBy(frame)
        rows = atoms.withColumns({f"__f{c}": f for c, f in zip(_XYZ, matrix_times(_place(), back), strict=True)})
        rows = rows.withColumns({f"__s{c}": F.coalesce(F.rint(F.lag(f"__f{c}").over(steps) - F.col(f"__f{c}")), F.lit(0.0)) for c in _XYZ})
        rows = rows.withColumns({f"__t{c}": F.sum(f"__s{c}").over(steps) for c in _XYZ})
        moved = matrix_times([F.col(f"__t{c}") for c in _XYZ], m)
        return rows.withColumns({c: F.col(c) + v for c, v in zip(_XYZ, moved, strict=True)}).select(*atoms.columns)

    def run(pdf):
        pdf = pdf.sort_values(frame)
        r = pdf[list(_XYZ)].to_numpy(float)
        for t in range(1, len(r)):
            box = np.array([list(v) for v in pdf["cell"].iloc[t]], float)
            r[t] += np.rint((r[t - 1] - r[t]) @ np.linalg.inv(box)) @ box
        pdf[list(_XYZ)] = r
        return pdf

    return atoms.groupBy(*keys, "aid").applyInPandas(run, atoms.schema)


def volume_of(cell: str = "cell") -> Column:
    """Volume of a cell, whatever the order of its vectors."""
    return F.abs(determinant(cell_matrix(cell)))
