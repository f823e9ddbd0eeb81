"""Chains of transformations that make structures from structures, and the fixed order of a conversion.

A stage is a function from atoms to atoms which may give none, one or many structures for each; the columns that number
them are its steps. In a chain, ``sid`` is a text: the source's, then the steps of each stage, so that every structure that
comes out is a key of its own, and the next stage works on all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from ..operators import generators, geometry, spatial, structures

_PART = "\x1f"


@dataclass
class Stage:
    """A transformation by name: ``apply`` takes atoms with the key ``sid``, ``steps`` are the columns that tell its structures
    apart (numbers, or x, y, z for axes)."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    steps: tuple[str, ...] = ()


def displacements(size: float) -> Stage:
    return Stage("displacements", lambda a: generators.displacements(a, size), ("moved", "axis"))


def isotropic(low: float, high: float, n: int) -> Stage:
    return Stage("isotropic", lambda a: generators.isotropic(a, low, high, n).drop("s"), ("step",))


def uniaxial(axis: str, low: float, high: float, n: int, keep_volume: bool = False) -> Stage:
    return Stage("uniaxial", lambda a: generators.uniaxial(a, axis, low, high, n, keep_volume).drop("s"), ("step",))


def shear(plane: str, low: float, high: float, n: int) -> Stage:
    return Stage("shear", lambda a: generators.shear(a, plane, low, high, n).drop("s"), ("step",))


def orthorhombic(low: float, high: float, n: int, axes: str = "xyz") -> Stage:
    return Stage("orthorhombic", lambda a: generators.orthorhombic(a, low, high, n, axes).drop("s"), ("step",))


def monoclinic(low: float, high: float, n: int, axes: str = "xyz") -> Stage:
    return Stage("monoclinic", lambda a: generators.monoclinic(a, low, high, n, axes).drop("s"), ("step",))


def random_displacements(rms: float, n: int, seed: int, orthogonal: bool = False) -> Stage:
    return Stage("random", lambda a: generators.random_displacements(a, rms, n, seed, orthogonal=orthogonal), ("copy",))


def supercell(na: int, nb: int, nc: int) -> Stage:
    return Stage("supercell", lambda a: generators.supercell(a, None, na, nb, nc).drop("ia", "ib", "ic"))


def cell_matrix(matrix: list[list[float]]) -> Stage:
    return Stage("cell", lambda a: geometry.transform_cell(a, matrix))


class Chain:
    """Stages one after the other; each structure that one gives goes through all that follow."""

    def __init__(self, *stages: Stage):
        self.stages = stages

    def __call__(self, atoms: DataFrame) -> DataFrame:
        """Atoms of all structures: sid (text), source (the sid they come from), path (the steps, an array of numbers from 0 in
        the order of the stages; the order of the structures), and the columns that the stages leave."""
        kind = dict(atoms.dtypes)["sid"]
        out = atoms.withColumn("sid", F.col("sid").cast("string"))
        for stage in self.stages:
            out = stage.apply(out)
            if stage.steps:
                number = lambda c, out=out: (F.array_position(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col(c)) - 1 if dict(out.dtypes)[c] == "string" else F.col(c)).cast("string")
                out = out.withColumn("sid", F.concat_ws(_PART, "sid", *[number(c) for c in stage.steps])).drop(*stage.steps)
        parts = F.split("sid", _PART)
        return out.withColumns({"source": parts[0].cast(kind), "path": F.transform(F.slice(parts, 2, 1000), lambda x: x.cast("int"))}).withColumn("sid", F.translate("sid", _PART, "/"))

    def count(self, atoms: DataFrame) -> DataFrame:
        """(source, n): structures that come of each."""
        return self(atoms).groupBy("source").agg(F.count_distinct("sid").alias("n"))


#: The order in which a conversion applies what is asked for.
ORDER = ("align_frames", "fix_atoms", "remove_atoms", "transform", "supercell", "standard_cell", "rotate", "shift", "scale", "cut", "vacuum", "wrap", "sort")


def convert(atoms: DataFrame, **options) -> DataFrame:
    """Atoms (sid, aid, species, x, y, z, and for periodic ones cell) changed by options, in the order of ORDER:

    align_frames (True; takes a column frame), fix_atoms and remove_atoms (numbers from 1), transform (a 3x3 matrix),
    supercell (three numbers), standard_cell (True), rotate ((axis, degrees)), shift (a vector, "origin" or "box"), scale (one
    or three factors), cut ((number from 1, radius)), vacuum (an amount), wrap (True), sort (True, or the species' order).
    """
    if unknown := set(options) - set(ORDER):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    keys = ("sid", "frame") if "frame" in atoms.columns else ("sid",)
    out = atoms

    def numbered(df: DataFrame, order: list) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn("__n", n).withColumn("aid", F.col("__n").cast(dict(atoms.dtypes)["aid"])).drop("__n")

    def apply(name: str, value, df: DataFrame) -> DataFrame:
        match name:
            case "align_frames":
                return geometry.align_frames(df)
            case "fix_atoms":
                return geometry.fix_atoms(df, value)
            case "remove_atoms":
                return numbered(df.where(~(F.col("aid") + 1).isin(list(value))), ["aid"])
            case "transform":
                return geometry.transform_cell(df, value, keys)
            case "supercell":
                grown = generators.supercell(df, None, *value).drop("ia", "ib", "ic")
                return numbered(grown, ["aid"])
            case "standard_cell":
                return geometry.standard_cell(df)
            case "rotate":
                return generators.rotate(df, S.rotation(*value))
            case "shift":
                return generators.translate(df, value, keys)
            case "scale":
                return generators.scaled(df, tuple(value) if isinstance(value, (tuple, list)) else (value,))
            case "cut":
                i, radius = int(value[0]) - 1, float(value[1])
                found = spatial.periodic_edges(df, radius, keys) if "cell" in df.columns else spatial.edges(df, radius, keys)
                return geometry.neighbour_cluster(df, found, i, radius, keys)
            case "vacuum":
                return geometry.add_vacuum(df, value, keys=keys)
            case "wrap":
                return generators.wrap_to_cell(df)
        order = structures.sort_atoms(df, value if isinstance(value, list) else None, keys)
        return numbered(order, ["place"]).drop("place")

    for name in ORDER:
        if options.get(name) not in (None, False):
            out = apply(name, options[name], out)
    return out
