"""Neighbour lists as band joins, triplets, and descriptors as grouped sums.

Atoms are rows (keys..., aid, species, x, y, z). A band join deals atoms into cubic cells as wide as the cutoff; one side
stands in the cells around its own as well, so an equi-join by structure and cell finds every pair within the cutoff, and
its cost grows with the number of neighbours and not with the square of a structure's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import angular_basis, cell_matrix, inverse, matrix_times, radial_basis, wrap


#: Structures of at most so many atoms are one cell: all pairs are fewer rows than 27 copies of each atom.
SMALL = 27


def _sized(atoms: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """With ``__small``: whether the structure is small enough to be one cell. Counts are summed before their shuffle."""
    n = atoms.groupBy(*keys).agg((F.count("*") <= SMALL).alias("__small"))
    return atoms.join(n, list(keys))


def _cells(cutoff: float) -> dict[str, Column]:
    """Cell of an atom."""
    return {f"c{c}": F.when(F.col("__small"), 0).otherwise(F.floor(F.col(c) / cutoff).cast("long")) for c in "xyz"}


def _spread(rows: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Each row in its own cell and, unless its structure is one cell, in those at ``steps``; ``__home``: in its own."""
    step = lambda v: F.struct(*[F.lit(x).alias(k) for x, k in zip(v, "xyz", strict=True)])
    home = F.array(step((0, 0, 0)))
    spread = rows.withColumn("__s", F.explode(F.when(F.col("__small"), home).otherwise(F.array(step((0, 0, 0)), *map(step, steps)))))
    moved = spread.withColumns({f"c{k}": F.col(f"c{k}") + F.col(f"__s.{k}") for k in "xyz"})
    return moved.withColumn("__home", (F.col("__s.x") == 0) & (F.col("__s.y") == 0) & (F.col("__s.z") == 0)).drop("__s")


_AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
_AHEAD = [s for s in _AROUND if s > (0, 0, 0)]
_LENGTH = "sqrt(dx * dx + dy * dy + dz * dz)"


def edges(atoms: DataFrame, cutoff: float, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, j, species_i, species_j, dx, dy, dz, d) of all ordered pairs of different atoms with d <= cutoff.

    Atoms stand in the 13 cells ahead of their own, so a pair from two cells meets once and is given in both directions.
    The join is sorted and merged: the size of an exploded side is not what Spark takes it for, so it is never broadcast.
    """
    rows = _sized(atoms.select(*keys, "aid", "species", "x", "y", "z"), keys).withColumns(_cells(cutoff))
    a = rows.select(*keys, F.col("aid").alias("i"), F.col("species").alias("species_i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"), "cx", "cy", "cz")
    b = _spread(rows, _AHEAD).drop("__small").withColumnsRenamed({"aid": "j", "species": "species_j"})
    met = a.hint("merge").join(b, [*keys, "cx", "cy", "cz"]).where("i != j").select(*keys, "i", "j", "species_i", "species_j", "__home", (F.col("x") - F.col("xi")).alias("dx"), (F.col("y") - F.col("yi")).alias("dy"), (F.col("z") - F.col("zi")).alias("dz"))
    near = met.withColumn("d", F.expr(_LENGTH)).where(F.col("d") <= cutoff)
    pair = lambda i, j, sign: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(f"species_{i}").alias("species_i"), F.col(f"species_{j}").alias("species_j"), *[(sign * F.col(c)).alias(c) for c in ("dx", "dy", "dz")])
    both = F.when(F.col("__home"), F.array(pair("i", "j", 1.0))).otherwise(F.array(pair("i", "j", 1.0), pair("j", "i", -1.0)))
    return near.select(*keys, "d", F.explode(both).alias("e")).select(*keys, "e.*", "d")


def image_range(cell: list[list], cutoff: float, pbc: tuple[bool, bool, bool] = (True, True, True), inv: list[list] | None = None) -> list:
    """Images on either side along each lattice vector: the cutoff over the distance of opposite faces, rounded up."""
    inv = inv or inverse(cell)
    out = []
    for k in range(3):
        length = F.sqrt(reduce(lambda s, r: s + r[k] * r[k], inv[1:], inv[0][k] * inv[0][k]) + F.lit(0.0))
        out.append(F.ceil(F.lit(cutoff) * length).cast("int") if pbc[k] else F.lit(0))
    return out


def periodic_edges(atoms: DataFrame, cutoff: float, keys: tuple[str, ...] = ("sid",), cell: list[list[float]] | None = None, pbc: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """:func:`edges` under periodic boundaries, with the image (ox, oy, oz) of the neighbour.

    The cell is a matrix of numbers, or each row's column ``cell``. Atoms are wrapped along periodic axes first; an atom's
    own images count, the atom itself doesn't. Only images within the cutoff of the cell's faces are made.
    """
    m = [[F.lit(float(v)) for v in row] for row in cell] if cell else cell_matrix()
    inv = inverse(m)
    if not cell:  # computed once a row, not once a use
        atoms = atoms.withColumn("__inv", F.array(*[F.array(*row) for row in inv]))
        inv = cell_matrix("__inv")
    fractions = matrix_times([F.col("x"), F.col("y"), F.col("z")], inv)
    wrapped = [wrap(f) if p else f for f, p in zip(fractions, pbc, strict=True)]
    rows = _sized(atoms, keys).withColumns({f"f{k}": f for k, f in zip("xyz", wrapped, strict=True)})
    place = matrix_times([F.col("fx"), F.col("fy"), F.col("fz")], m)
    home = rows.withColumns({k: p for k, p in zip("xyz", place, strict=True)})
    span = image_range(m, cutoff, pbc, inv)
    margin = [F.lit(cutoff) * F.sqrt(reduce(lambda s, r: s + r[k] * r[k], inv[1:], inv[0][k] * inv[0][k]) + F.lit(0.0)) for k in range(3)]
    ghosts = rows
    for k, s, w in zip("xyz", span, margin, strict=True):
        ghosts = ghosts.withColumn(f"o{k}", F.explode(F.sequence(-s, s)))
        if pbc["xyz".index(k)]:
            ghosts = ghosts.where((F.col(f"f{k}") + F.col(f"o{k}") >= -w - 1e-9) & (F.col(f"f{k}") + F.col(f"o{k}") <= 1 + w + 1e-9))
    moved = matrix_times([F.col(f"f{k}") + F.col(f"o{k}") for k in "xyz"], m)
    ghosts = ghosts.withColumns({k: p for k, p in zip("xyz", moved, strict=True)})
    # The atoms of the cell itself are spread; their images, of which there are more, stay in one cell each.
    a = _spread(home.withColumns(_cells(cutoff)), _AROUND).select(*keys, F.col("aid").alias("i"), F.col("species").alias("species_i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"), "cx", "cy", "cz")
    b = ghosts.withColumns(_cells(cutoff)).select(*keys, F.col("aid").alias("j"), F.col("species").alias("species_j"), "ox", "oy", "oz", "x", "y", "z", "cx", "cy", "cz")
    met = a.hint("merge").join(b, [*keys, "cx", "cy", "cz"]).where("i != j or ox != 0 or oy != 0 or oz != 0").select(*keys, "i", "j", "species_i", "species_j", "ox", "oy", "oz", (F.col("x") - F.col("xi")).alias("dx"), (F.col("y") - F.col("yi")).alias("dy"), (F.col("z") - F.col("zi")).alias("dz"))
    return met.withColumn("d", F.expr(_LENGTH)).where(F.col("d") <= cutoff)


def pair_cutoff(found: DataFrame, cutoffs: dict[tuple[str, str], float], default: float) -> DataFrame:
    """Edges within the cutoff of their pair of species, whatever its order."""
    limit = F.lit(default)
    for (a, b), value in cutoffs.items():
        low, high = sorted((a, b))
        limit = F.when((F.least("species_i", "species_j") == low) & (F.greatest("species_i", "species_j") == high), F.lit(value)).otherwise(limit)
    return found.where(F.col("d") <= limit)


def neighbor_counts(atoms: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, n) of every atom, 0 for those without a neighbour."""
    n = found.groupBy(*keys, "i").agg(F.count("*").alias("n"))
    return atoms.select(*keys, F.col("aid").alias("i")).join(n, [*keys, "i"], "left").fillna(0, ["n"])


def nearest_shell(found: DataFrame, dr: float, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Edges within ``dr`` of the shortest one of their atom."""
    low = F.min("d").over(Window.partitionBy(*keys, "i"))
    return found.withColumn("__low", low).where(F.col("d") <= F.col("__low") + dr).drop("__low")


def triplets(found: DataFrame, cutoff: float, min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, j, k, d_ij, d_ik, cos_theta) of unordered pairs of neighbours, both at min_cutoff < d <= cutoff."""
    image = [c for c in ("ox", "oy", "oz") if c in found.columns]
    near = found.where((F.col("d") > min_cutoff) & (F.col("d") <= cutoff)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "i").orderBy("j", *image)))
    a = near.select(*keys, "i", F.col("j").alias("j"), F.col("species_j").alias("species_j"), F.col("rank").alias("ra"), *[F.col(c).alias(f"{c}a") for c in ("dx", "dy", "dz")], F.col("d").alias("d_ij"))
    b = near.select(*keys, "i", F.col("j").alias("k"), F.col("species_j").alias("species_k"), F.col("rank").alias("rb"), *[F.col(c).alias(f"{c}b") for c in ("dx", "dy", "dz")], F.col("d").alias("d_ik"))
    dot = F.col("dxa") * F.col("dxb") + F.col("dya") * F.col("dyb") + F.col("dza") * F.col("dzb")
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (F.col("d_ij") * F.col("d_ik"))))
    return a.join(b, [*keys, "i"]).where("ra < rb").select(*keys, "i", "j", "k", "species_j", "species_k", "d_ij", "d_ik", cos.alias("cos_theta"))


def _spin(column: str, spins: dict[str, int]) -> Column:
    """Typespin of a species; one that has none raises an error."""
    out = F.raise_error(F.concat(F.lit("no typespin for species "), F.coalesce(column, F.lit("null")))).cast("double")
    for s, v in spins.items():
        out = F.when(F.col(column) == s, F.lit(float(v))).otherwise(out)
    return out


def radial_sums(found: DataFrame, cutoff: float, order: int, spins: dict[str, int] | None = None, min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, r0.., rw0..): sums of the radial basis, plain and weighted by the neighbour's typespin."""
    near = found.where((F.col("d") > min_cutoff) & (F.col("d") <= cutoff))
    basis = [radial_basis(n, F.col("d"), cutoff, min_cutoff) for n in range(order + 1)]
    sums = [F.sum(b).alias(f"r{n}") for n, b in enumerate(basis)]
    if spins:
        sums += [F.sum(b * _spin("species_j", spins)).alias(f"rw{n}") for n, b in enumerate(basis)]
    return near.groupBy(*keys, "i").agg(*sums)


def angular_sums(found: DataFrame, cutoff: float, order: int, spins: dict[str, int] | None = None, min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, a0.., aw0..): sums of the angular basis over pairs of neighbours, plain and weighted by both typespins."""
    tri = triplets(found, cutoff, min_cutoff, keys)
    basis = [angular_basis(n, F.col("cos_theta"), F.col("d_ij"), F.col("d_ik"), cutoff) for n in range(order + 1)]
    sums = [F.sum(b).alias(f"a{n}") for n, b in enumerate(basis)]
    if spins:
        sums += [F.sum(b * _spin("species_j", spins) * _spin("species_k", spins)).alias(f"aw{n}") for n, b in enumerate(basis)]
    return tri.groupBy(*keys, "i").agg(*sums)


def descriptors(atoms: DataFrame, found: DataFrame, rad_cutoff: float, rad_order: int, ang_cutoff: float, ang_order: int, spins: dict[str, int], min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, aid, species, fingerprint): radial and angular sums, then both weighted if there are two species or more."""
    weigh = spins if len(spins) > 1 else None
    r, a = radial_sums(found, rad_cutoff, rad_order, weigh, min_cutoff, keys), angular_sums(found, ang_cutoff, ang_order, weigh, min_cutoff, keys)
    names = [f"r{n}" for n in range(rad_order + 1)] + [f"a{n}" for n in range(ang_order + 1)]
    names += ([f"rw{n}" for n in range(rad_order + 1)] + [f"aw{n}" for n in range(ang_order + 1)]) if weigh else []
    full = atoms.select(*keys, F.col("aid").alias("i"), "species").join(r, [*keys, "i"], "left").join(a, [*keys, "i"], "left")
    return full.select(*keys, F.col("i").alias("aid"), "species", F.array(*[F.coalesce(n, F.lit(0.0)) for n in names]).alias("fingerprint"))


def coordination(found: DataFrame, cutoff: float, smooth: bool = False, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, cn): neighbours within the cutoff, or the sum of (1 - s^6) / (1 - s^12) = 1 / (1 + s^6), s = d / cutoff.

    The smooth number takes edges of up to twice the cutoff.
    """
    if not smooth:
        return found.groupBy(*keys, "i").agg(F.sum((F.col("d") <= cutoff).cast("long")).alias("cn"))
    return found.where(F.col("d") <= 2 * cutoff).groupBy(*keys, "i").agg(F.sum(1 / (1 + F.pow(F.col("d") / cutoff, 6))).alias("cn"))


def bond_length(found: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, d): distance to the nearest neighbour."""
    return found.groupBy(*keys, "i").agg(F.min("d").alias("d"))


def rdf_histogram(found: DataFrame, dr: float) -> DataFrame:
    """(bin, n): edges by floor(d / dr)."""
    return found.groupBy(F.floor(F.col("d") / dr).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rdf(found: DataFrame, dr: float, centres: int, density: float) -> DataFrame:
    """(bin, r, g): the histogram over centres, density and the exact volume of each shell."""
    volume = F.lit(4 / 3 * 3.141592653589793 * dr**3) * (F.pow(F.col("bin") + 1, 3) - F.pow(F.col("bin").cast("double"), 3))
    return rdf_histogram(found, dr).select("bin", ((F.col("bin") + 0.5) * dr).alias("r"), (F.col("n") / centres / (density * volume)).alias("g"))


def rdf_frames(found: DataFrame, atoms: DataFrame, dr: float, keys: tuple[str, ...] = ("sid", "frame"), centre: str | None = None, other: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(sid, bin, r, g) of trajectories: for each structure, the first key, edges from atoms of one species to atoms of another
    (any where None) by floor(d / dr), over centres and the shells' exact volumes, as the mean of its frames over the density of the other
    species in its last frame's cell.

    With weights of species, such as scattering factors, each edge counts the product of its two atoms' weights over the mean
    product of the atoms of its frame. Atoms have a column ``cell``.
    """
    sid, *rest = keys
    w = (lambda c: F.coalesce(*[F.when(F.col(c) == s, F.lit(float(v))) for s, v in weights.items()], F.lit(0.0))) if weights else (lambda c: F.lit(1.0))
    is_centre = F.lit(True) if centre is None else F.col("species") == centre
    is_other = F.lit(True) if other is None else F.col("species") == other
    m = cell_matrix()
    volume = F.abs(m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    frames = atoms.groupBy(*keys).agg(F.count_if(is_centre).alias("nc"), F.count_if(is_other).alias("no"), F.first(volume).alias("volume"), F.avg(F.when(is_centre, w("species"))).alias("wc"), F.avg(F.when(is_other, w("species"))).alias("wo"))
    ends = frames.groupBy(sid).agg(F.count("*").alias("frames"), F.max_by(F.col("no") / F.col("volume"), F.struct(*rest) if rest else F.lit(0)).alias("density"))
    kept = found
    if centre is not None:
        kept = kept.where(F.col("species_i") == centre)
    if other is not None:
        kept = kept.where(F.col("species_j") == other)
    hist = kept.groupBy(*keys, F.floor(F.col("d") / dr).cast("long").alias("bin")).agg(F.sum(w("species_i") * w("species_j")).alias("n"))
    shell = F.lit(4 / 3 * 3.141592653589793 * dr**3) * (F.pow(F.col("bin") + 1, 3) - F.pow(F.col("bin").cast("double"), 3))
    per = hist.join(frames, list(keys)).select(sid, "bin", F.try_divide(F.col("n"), F.col("nc") * F.col("wc") * F.col("wo")).alias("n"))
    total = per.groupBy(sid, "bin").agg(F.sum("n").alias("n")).join(ends, sid)
    return total.select(sid, "bin", ((F.col("bin") + 0.5) * dr).alias("r"), F.try_divide(F.col("n") / F.col("frames"), F.col("density") * shell).alias("g"))


def describe(atoms: DataFrame, spins: dict[str, int], settings: tuple[float, int, float, int], min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> tuple[DataFrame, DataFrame]:
    """(descriptors, edges) from places in one call: settings are radial cutoff and order, angular cutoff and order; atoms
    with a column ``cell`` are wrapped into it and have periodic neighbours."""
    reach = max(settings[0], settings[2])
    found = periodic_edges(atoms, reach, keys) if "cell" in atoms.columns else edges(atoms, reach, keys)
    return descriptors(atoms, found, *settings, spins, min_cutoff, keys), found
