"""Reference energies, filters, training-set headers and sampling weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._order import running_total


def _reference(species: str, energies: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for s, e in energies.items():
        out = F.when(F.col(species) == s, F.lit(float(e))).otherwise(out)
    return out


def referenced_energy(structures: DataFrame, atoms: DataFrame, energies: dict[str, float], sid: str = "sid") -> DataFrame:
    """``structures`` with n_atoms and e_ref: (energy - sum of the atoms' reference energies) / n; unknown species count 0.

    Structures without atoms are left out.
    """
    sums = atoms.groupBy(sid).agg(F.count("*").alias("n_atoms"), F.sum(_reference("species", energies)).alias("__e"))
    return structures.join(sums, sid).withColumn("e_ref", (F.col("energy") - F.col("__e")) / F.col("n_atoms")).drop("__e")


def cohesive_energy(structures: DataFrame, atoms: DataFrame, energies: dict[str, float], sid: str = "sid") -> DataFrame:
    """``structures`` with n_atoms, and of a total energy: cohesive (less the atoms' reference energies), cohesive_per_atom and
    energy_per_atom. Structures without atoms are left out."""
    rows = referenced_energy(structures, atoms, energies, sid)
    return rows.withColumns({"cohesive": F.col("e_ref") * F.col("n_atoms"), "cohesive_per_atom": F.col("e_ref"), "energy_per_atom": F.col("energy") / F.col("n_atoms")}).drop("e_ref")


def total_energy(structures: DataFrame, atoms: DataFrame, energies: dict[str, float], cohesive: str = "cohesive", sid: str = "sid") -> DataFrame:
    """``structures`` with n_atoms and energy: a cohesive energy and the atoms' reference energies."""
    sums = atoms.groupBy(sid).agg(F.count("*").alias("n_atoms"), F.sum(_reference("species", energies)).alias("__e"))
    return structures.drop("energy").join(sums, sid).withColumn("energy", F.col(cohesive) + F.col("__e")).drop("__e")


def energy_filter(rows: DataFrame, max_energy: float) -> DataFrame:
    return rows.where(F.col("e_ref") <= max_energy)


def force_filter(structures: DataFrame, atoms: DataFrame, max_force: float, components: tuple[str, ...] = ("fx", "fy", "fz"), sid: str = "sid") -> DataFrame:
    """Structures none of whose force components exceeds the limit; those without forces stay."""
    largest = atoms.groupBy(sid).agg(F.max(F.greatest(*[F.abs(c) for c in components])).alias("__f"))
    return structures.join(largest, sid, "left").where(F.col("__f").isNull() | (F.col("__f") <= max_force)).drop("__f")


def trainset_header(rows: DataFrame) -> DataFrame:
    """One row: counts, smallest, largest and mean energy an atom, and shift and scale of its normalisation."""
    low, high = F.min("e_ref"), F.max("e_ref")
    flat = high - low == 0
    return rows.agg(F.count("*").alias("n_structures"), F.sum("n_atoms").alias("n_atoms"), low.alias("e_min"), high.alias("e_max"), F.avg("e_ref").alias("e_av"), F.when(flat, 0.0).otherwise((high + low) / 2).alias("shift"), F.when(flat, 1.0).otherwise(F.try_divide(F.lit(2.0), high - low)).alias("scale"))


def composition(atoms: DataFrame, species: list[str], sid: str = "sid") -> DataFrame:
    """(sid, n_<species>...): counts in the declared order, 0 for a species that is missing."""
    return atoms.groupBy(sid).agg(*[F.count_if(F.col("species") == s).alias(f"n_{s}") for s in species])


def composition_key(atoms: DataFrame, sid: str = "sid") -> DataFrame:
    """(sid, key): species and counts, sorted, as text; equal for equal compositions."""
    n = atoms.groupBy(sid, "species").agg(F.count("*").alias("n"))
    return n.groupBy(sid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("species", "n"))), lambda x: F.concat(x["species"], x["n"].cast("string"))), ",").alias("key"))


def energy_weights(rows: DataFrame, energy: str = "energy") -> DataFrame:
    """With ``weight``: 1 / (1 + (e - min) / (max - min)); 1 if all are equal."""
    ends = rows.agg(F.min(energy).alias("__lo"), F.max(energy).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    w = F.when(spread == 0, 1.0).otherwise(1 / (1 + F.try_divide(F.col(energy) - F.col("__lo"), spread)))
    return rows.join(F.broadcast(ends)).withColumn("weight", w).drop("__lo", "__hi")


def error_weights(rows: DataFrame, error: str = "error") -> DataFrame:
    """With ``weight``: errors of at least 1e-12 over their mean; 0 for one that isn't finite, 1 if all are 0."""
    from ..functions.scalars import finite

    e = F.when(finite(F.col(error)), F.greatest(F.col(error), F.lit(1e-12))).otherwise(0.0)
    mean = rows.agg(F.avg(e).alias("__m"))
    return rows.join(F.broadcast(mean)).withColumn("weight", F.when(F.col("__m") == 0, 1.0).otherwise(F.try_divide(e, F.col("__m")))).drop("__m")


def min_energy_per_composition(rows: DataFrame) -> DataFrame:
    """(key, sid, energy, n) of the lowest energy a composition; ties to the smaller sid."""
    return rows.groupBy("key").agg(F.min_by("sid", F.struct("energy", "sid")).alias("sid"), F.min("energy").alias("energy"), F.count("*").alias("n"))


def missing(required: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """Required keys of which there is no sample."""
    return required.select(key).distinct().join(found.select(key), key, "left_anti")


def least_squares_sums(compositions: DataFrame, species: list[str], energy: str = "energy") -> DataFrame:
    """(n_<species>..., n, se, see): what least squares needs of all structures of a composition."""
    names = [f"n_{s}" for s in species]
    return compositions.groupBy(*names).agg(F.count("*").alias("n"), F.sum(energy).alias("se"), F.sum(F.col(energy) * F.col(energy)).alias("see"))


def fit_reference_energies(compositions: DataFrame, species: list[str], energy: str = "energy", fixed: dict[str, float] | None = None) -> dict[str, float]:
    """Atomic energies by least squares, some of them fixed; a rank below the number of free species raises.

    Normal equations are summed in the cluster, so the driver gets one small matrix whatever the number of structures.
    """
    fixed = fixed or {}
    free = [s for s in species if s not in fixed]
    rest = F.col(energy)
    for s, e in fixed.items():
        rest = rest - F.col(f"n_{s}") * e
    cells = [F.sum((F.col(f"n_{a}") * F.col(f"n_{b}")).cast("double")).alias(f"m_{i}_{j}") for i, a in enumerate(free) for j, b in enumerate(free)]
    r = compositions.agg(*cells, *[F.sum(F.col(f"n_{a}") * rest).alias(f"v_{i}") for i, a in enumerate(free)]).first()
    m = np.array([[r[f"m_{i}_{j}"] or 0.0 for j in range(len(free))] for i in range(len(free))]).reshape(len(free), len(free))
    if free and np.linalg.matrix_rank(m) < len(free):
        raise ValueError("the compositions don't determine the energies of all species")
    found = np.linalg.solve(m, np.array([r[f"v_{i}"] for i in range(len(free))])) if free else []
    return fixed | {s: float(e) for s, e in zip(free, found, strict=True)}


def first_atom_offsets(counts: DataFrame, sid: str = "sid", n: str = "n_atoms") -> DataFrame:
    """With ``first_atom``: atoms of all structures of smaller sid. Sums by ranges of sid first, so no task sees all rows."""
    return running_total(counts, F.col(n), "first_atom", sid)


def reference_fit(compositions: DataFrame, species: list[str], energy: str = "energy", fixed: dict[str, float] | None = None) -> dict:
    """:func:`fit_reference_energies` with how it was found: energies, species, fixed, n_samples, n_compositions, rmse and
    rmse_per_atom of the residuals. Samples must have finite energies and at least one atom each, else an error."""
    from ..functions.scalars import finite

    size = sum((F.col(f"n_{s}") for s in species), F.lit(0))
    if compositions.where(~finite(F.col(energy)) | (size <= 0)).limit(1).count():
        raise ValueError("a sample has no finite energy or no atoms")
    found = fit_reference_energies(compositions, species, energy, fixed)
    rest = F.col(energy) - sum((F.col(f"n_{s}") * found[s] for s in species), F.lit(0.0))
    r = compositions.agg(F.count("*").alias("n"), F.count_distinct(*[f"n_{s}" for s in species]).alias("c"), F.sqrt(F.avg(rest * rest)).alias("r"), F.sqrt(F.avg(rest * rest / (size * size))).alias("a")).first()
    return {"method": "least squares", "energies": found, "species": list(species), "fixed": dict(fixed or {}), "n_samples": r["n"], "n_compositions": r["c"], "rmse": r["r"], "rmse_per_atom": r["a"]}


def decompose(composition: dict[str, float], basis: dict[str, dict[str, float]]) -> dict[str, float]:
    """Amounts of the compounds of a basis that make up a composition; the basis has as many as there are species, and they
    are independent, else an error."""
    species = sorted({s for c in basis.values() for s in c})
    if extra := set(composition) - set(species):
        raise ValueError(f"no compound of the basis has {sorted(extra)}")
    m = np.array([[c.get(s, 0.0) for c in basis.values()] for s in species], float)
    if m.shape[0] != m.shape[1] or abs(np.linalg.det(m)) < 1e-10:
        raise ValueError("the compounds are no basis of the species")
    return dict(zip(basis, np.linalg.solve(m, [composition.get(s, 0.0) for s in species]).tolist(), strict=True))


def compound_references(rows: DataFrame, compounds: dict[str, dict[str, int]], sid: str = "sid") -> dict:
    """Atomic energies from reference compounds: the lowest energy of each compound's samples, solved for its species.

    ``rows`` has (sid, key, energy) with keys of :func:`composition_key`; any multiple of a compound is a sample of it. A
    compound without a sample, or compounds that don't determine the species, raise. Also says which samples were taken.
    """
    from math import gcd

    def key(c: dict[str, int], k: int) -> str:
        return ",".join(f"{s}{n * k}" for s, n in sorted(c.items()))

    unit = {}
    for name, c in compounds.items():
        d = gcd(*c.values())
        unit[name] = {s: n // d for s, n in c.items()}
    parts = F.transform(F.split("key", ","), lambda x: F.struct(F.regexp_extract(x, "^(.*?)([0-9]+)$", 1).alias("s"), F.regexp_extract(x, "([0-9]+)$", 1).cast("long").alias("n")))
    least = lambda v: F.array_max(F.transform(F.sequence(F.lit(1), F.array_min(F.transform(v, lambda x: x["n"]))), lambda d: F.when(F.forall(v, lambda x: x["n"] % d == 0), d)))
    reduced = rows.withColumn("__p", parts).withColumn("__d", least(F.col("__p"))).withColumn("__u", F.array_join(F.transform("__p", lambda x: F.concat(x["s"], (x["n"] / F.col("__d")).cast("long").cast("string"))), ","))
    wanted = {key(c, 1): name for name, c in unit.items()}
    best = {r["__u"]: r for r in reduced.where(F.col("__u").isin(list(wanted))).groupBy("__u").agg(F.min_by(F.struct(sid, "energy", "__d"), F.struct(F.col("energy") / F.col("__d"), sid)).alias("b")).collect()}
    if lacking := sorted(name for k, name in wanted.items() if k not in best):
        raise ValueError(f"no sample of {', '.join(lacking)}")
    species = sorted({s for c in unit.values() for s in c})
    m = np.array([[c.get(s, 0) for s in species] for c in unit.values()], float)
    if np.linalg.matrix_rank(m) < len(species):
        raise ValueError("the compounds don't determine the energies of all species")
    chosen = {name: best[key(c, 1)]["b"] for name, c in unit.items()}
    e = np.array([chosen[n]["energy"] / chosen[n]["__d"] for n in unit])
    found = np.linalg.lstsq(m, e, rcond=None)[0]
    return {"method": "reference compounds", "energies": dict(zip(species, map(float, found), strict=True)), "samples": {n: b[sid] for n, b in chosen.items()}}


def split(rows: DataFrame, test_fraction: float, seed: int, key: str = "sid") -> DataFrame:
    """With ``is_test``: about the given share, by a hash of the key and the seed; the same in every run."""
    return rows.withColumn("is_test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(test_fraction * 1_000_000))


def sample(rows: DataFrame, k: int, seed: int, key: str = "sid") -> DataFrame:
    """k rows at random without replacement, by a hash of the key and the seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)
