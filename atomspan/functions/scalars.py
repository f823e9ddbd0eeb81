"""Scalar expressions of atomistic analysis, all as JVM-side columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: CODATA 2018 constants in SI units and conversions to eV and angstrom.
HARTREE_EV, RYDBERG_EV, BOHR_ANGSTROM, KCAL_PER_MOL_EV = 27.211386245988, 13.605693122994, 0.529177210903, 0.0433641153087705
BOLTZMANN_EV, PLANCK_EV_S, LIGHT_M_S, AVOGADRO, ELEMENTARY_CHARGE_C = 8.617333262e-5, 4.135667696e-15, 299792458.0, 6.02214076e23, 1.602176634e-19
ATOMIC_MASS_KG, KJ_PER_MOL_EV, GPA_EV_ANGSTROM3, FEMTOSECOND_S = 1.66053906660e-27, 0.010364269656262, 0.006241509074, 1e-15


def chebyshev(n: int, x: Column) -> Column:
    """T_n(x) with x held within -1 and 1."""
    return F.cos(F.lit(n) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def rescale(r: Column, r_min: float, r_max: float) -> Column:
    """r from [r_min, r_max] to [-1, 1], held within."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * r - r_min - r_max) / (r_max - r_min)))


def cosine_cutoff(r: Column, radius: float) -> Column:
    """(cos(pi r / radius) + 1) / 2 below the radius, 0 from there on."""
    return F.when(r < radius, 0.5 * (F.cos(F.lit(math.pi) * r / radius) + 1)).otherwise(0.0)


def cosine_cutoff_derivative(r: Column, radius: float) -> Column:
    return F.when(r < radius, -0.5 * math.pi / radius * F.sin(F.lit(math.pi) * r / radius)).otherwise(0.0)


def chebyshev_derivative(n: int, x: Column) -> Column:
    """dT_n/dx; the denominator stays above 1e-5."""
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return n * F.sin(n * F.acos(held)) / F.sqrt(F.greatest(1 - held * held, F.lit(1e-10)))


def radial_basis(n: int, r: Column, radius: float, r_min: float = 0.0) -> Column:
    return chebyshev(n, rescale(r, r_min, radius)) * cosine_cutoff(r, radius)


def angular_basis(n: int, cos_theta: Column, r_ij: Column, r_ik: Column, radius: float) -> Column:
    return chebyshev(n, cos_theta) * cosine_cutoff(r_ij, radius) * cosine_cutoff(r_ik, radius)


def typespins(n: int) -> list[int]:
    """Whole numbers around 0, without 0 if their count is even."""
    half = n // 2
    return [k for k in range(-half, half + 1) if k or n % 2]


def distance2(*pairs: tuple[Column, Column]) -> Column:
    out = None
    for a, b in pairs:
        d = (a - b) * (a - b)
        out = d if out is None else out + d
    return out


def wrap(x: Column) -> Column:
    """A fractional coordinate in [0, 1); what rounds to 1 becomes 0 or less than 1e-10 below it."""
    w = x - F.floor(x)
    return F.when(w >= 1 - 1e5 * 2.220446049250313e-16, w - 1).otherwise(w)


def minimal(d: Column) -> Column:
    """A fractional difference of the nearest images."""
    return d - F.rint(d)


def matrix_times(v: list[Column], m) -> list[Column]:
    """Row vector times 3x3 matrix; entries are columns or numbers."""
    return [v[0] * m[0][k] + v[1] * m[1][k] + v[2] * m[2][k] for k in range(3)]


def determinant(m) -> Column:
    """Of a 3x3 matrix; the signed volume of a cell."""
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse(m) -> list[list]:
    """Of a 3x3 matrix, by its adjugate."""
    d = determinant(m)
    rest = lambda i, j: [[m[a][b] for b in range(3) if b != j] for a in range(3) if a != i]
    minor = lambda i, j: (lambda s: s[0][0] * s[1][1] - s[0][1] * s[1][0])(rest(i, j))
    return [[((-1) ** (i + j)) * minor(j, i) / d for j in range(3)] for i in range(3)]


def cell_matrix(cell: str = "cell") -> list[list[Column]]:
    """Entries of an array<array<double>> column, rows being lattice vectors."""
    return [[F.col(cell)[i][j] for j in range(3)] for i in range(3)]


def cell_from_parameters(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Lattice vectors of lengths and angles in degrees; the first along x, the second in the xy plane."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    return [[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [cx, cy, math.sqrt(max(c * c - cx * cx - cy * cy, 0.0))]]


def rotation(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """Matrix that turns row vectors about an axis."""
    n = math.sqrt(sum(x * x for x in axis))
    x, y, z = (v / n for v in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = 1 - c
    return [[t * x * x + c, t * x * y + s * z, t * x * z - s * y], [t * x * y - s * z, t * y * y + c, t * y * z + s * x], [t * x * z + s * y, t * y * z - s * x, t * z * z + c]]


def rotation_between(old: tuple[float, float, float], new: tuple[float, float, float]) -> list[list[float]]:
    """Matrix that turns row vectors along ``old`` into the direction of ``new`` the shortest way."""
    a, b = ([v / math.sqrt(sum(x * x for x in w)) for v in w] for w in (old, new))
    axis = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    s, c = math.sqrt(sum(x * x for x in axis)), sum(x * y for x, y in zip(a, b, strict=True))
    if s < 1e-12:  # along each other, or opposite: then about any axis across
        k = min(range(3), key=lambda i: abs(a[i]))
        across = [float(i == k) - a[i] * a[k] for i in range(3)]
        return rotation(tuple(across), 0.0 if c > 0 else 180.0)
    return rotation(tuple(axis), math.degrees(math.atan2(s, c)))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rows_of_formula(formula: Column) -> Column:
    """(species, count) of a formula such as TiO2; a repeated species is summed up."""
    found = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]*)([0-9]*)"), F.lit(0))
    each = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^[A-Z][a-z]*", 0).alias("s"), F.coalesce(F.nullif(F.regexp_extract(x, "[0-9]+$", 0), F.lit("")).cast("int"), F.lit(1)).alias("n")))
    names = F.array_sort(F.array_distinct(F.transform(each, lambda e: e["s"])))
    return F.transform(names, lambda s: F.struct(s.alias("species"), F.aggregate(F.filter(each, lambda e: e["s"] == s), F.lit(0), lambda a, e: a + e["n"]).alias("count")))


def range_list(text: Column) -> Column:
    """Whole numbers of a list such as 1,3:5, whose ranges include both ends."""
    part = lambda p: F.sequence(F.element_at(F.split(p, ":"), 1).cast("int"), F.element_at(F.split(p, ":"), -1).cast("int"))
    return F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), part))


def scattering_factor(a: list[float], b: list[float], c: float, two_theta_degrees: Column, wavelength: float) -> Column:
    """Cromer-Mann: sum of a exp(-b (sin(theta) / wavelength)^2) and c."""
    s2 = F.pow(F.sin(F.radians(two_theta_degrees) / 2) / wavelength, 2)
    out = F.lit(c)
    for x, y in zip(a, b, strict=True):
        out = out + x * F.exp(-y * s2)
    return out


def check_composition(composition: Column) -> Column:
    """A map of species to counts, none of which may be negative, no number, or all of them 0; else an error."""
    values = F.map_values(composition)
    good = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (v >= 0)) & F.exists(values, lambda v: v > 0)
    return F.when(good, composition).otherwise(F.raise_error(F.concat(F.lit("no composition: "), F.to_json(composition))))


def check_energy(energy: Column) -> Column:
    """A finite energy, else an error."""
    return F.when(finite(energy), energy).otherwise(F.raise_error(F.concat(F.lit("no finite energy: "), F.coalesce(energy.cast("string"), F.lit("null")))).cast("double"))


def number(text: Column) -> Column:
    """A number of a text, whole if it is written so: (whole, real), with nulls for what it isn't; exponents may be D."""
    clean = F.translate(F.trim(text), "dD", "ee")
    return F.struct(clean.try_cast("long").alias("whole"), clean.try_cast("double").alias("real"))


def pairs(text: Column) -> Column:
    """A map of a list such as Co=0.5,Ni=0.5; blanks don't count, and keys may not repeat."""
    return F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(","), F.lit("="))


def nested_pairs(text: Column) -> Column:
    """A map of maps of a list such as Co=Co:0.5,Ni:0.5;Li=Li:1: groups parted by semicolons, numbers as doubles."""
    groups = F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(";"), F.lit("="))
    return F.transform_values(groups, lambda k, v: F.transform_values(F.str_to_map(v, F.lit(","), F.lit(":")), lambda s, n: n.try_cast("double")))


def decoded(content: Column) -> Column:
    """Text of bytes in UTF-8 without the zeros that fill a field of fixed width."""
    return F.regexp_replace(content.cast("string"), "\u0000+$", "")


def encoded(text: Column, width: int) -> Column:
    """A text for a field of so many bytes; one that is too long is an error."""
    return F.when(F.octet_length(text) <= width, text).otherwise(F.raise_error(F.concat(F.lit(f"longer than {width} bytes: "), text)))


def file_name(text: Column) -> Column:
    """A name without a path and with an underscore for what file names had better not hold."""
    return F.regexp_replace(F.regexp_replace(text, "^.*/", ""), "[^A-Za-z0-9._-]+", "_")


def radius_of(radii, species: str, state: str = "", coordination: str = "", spin: str = ""):
    """Rows of a table of radii (species, state, coordination, spin, radius) of a species whose texts contain those given."""
    has = lambda c, v: F.contains(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(v))
    return radii.where((F.col("species") == species) & has("state", state) & has("coordination", coordination) & has("spin", spin))
