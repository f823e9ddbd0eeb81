"""Training sets on disk: three Parquet tables in a folder, with structures numbered from 0.

``frames`` (sid, path, frame, cell, energy, n_atoms, has_forces), ``atoms`` (sid, aid, species, x, y, z, fx, fy, fz, and with features
fingerprint) and ``meta``, one row. A set is written beside its place and moved there when it is whole, so that a reader
never finds half of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators import energies, spatial, structures

_XYZ, _FORCES = ("x", "y", "z"), ("fx", "fy", "fz")


def kind(files: DataFrame) -> DataFrame:
    """(path, kind) of rows (path, content): hdf5 by its signature, ascii if the bytes are UTF-8, else binary."""
    signature = F.substring("content", 1, 8) == F.unhex(F.lit("894844460D0A1A0A"))
    return files.select("path", F.when(signature, "hdf5").when(F.is_valid_utf8(F.col("content").cast("string")), "ascii").otherwise("binary").alias("kind"))


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(path(target), True)
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def build(read_rows: DataFrame, references: dict[str, float] | None = None, max_energy: float | None = None, max_force: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of read frames in the order of path and frame, filtered and numbered; see the module. With reference
    energies frames have e_ref, and ``max_energy`` an atom and ``max_force`` a component leave out those above."""
    good = read_rows.where("error is null").select("path", "frame", "cell", "energy", "atoms")
    if max_force is not None:
        low = lambda x: F.greatest(*[F.abs(F.coalesce(x[c], F.lit(0.0))) for c in _FORCES]) <= max_force
        good = good.where(F.forall("atoms", low))
    if references is not None:
        known = F.create_map(*[F.lit(v) for pair in references.items() for v in pair])
        total = F.aggregate("atoms", F.lit(0.0), lambda s, x: s + F.coalesce(F.element_at(known, x["species"]), F.lit(0.0)))
        good = good.withColumn("e_ref", F.try_divide(F.col("energy") - total, F.size("atoms").cast("double")))
        if max_energy is not None:
            good = good.where(F.col("e_ref") <= max_energy)
    numbers = energies.first_atom_offsets(good.select(F.struct("path", "frame").alias("k"), F.lit(1).cast("long").alias("one")), "k", "one").select("k", F.col("first_atom").alias("sid"))
    rows = good.withColumn("k", F.struct("path", "frame")).join(numbers, "k").drop("k")
    forced = (F.size("atoms") > 0) & F.forall("atoms", lambda x: x["fx"].isNotNull() & x["fy"].isNotNull() & x["fz"].isNotNull())
    extra = ["e_ref"] if references is not None else []
    frames = rows.select("sid", "path", "frame", "cell", "energy", F.size("atoms").alias("n_atoms"), forced.alias("has_forces"), *extra)
    return frames, rows.select("sid", F.posexplode("atoms").alias("aid", "a")).select("sid", "aid", "a.*")


def with_features(frames: DataFrame, atoms: DataFrame, spins: dict[str, int], settings: tuple[float, int, float, int], min_cutoff: float = 0.0) -> DataFrame:
    """``atoms`` with ``fingerprint``: descriptors of (radial cutoff, order, angular cutoff, order), under periodic boundaries for
    frames with a cell."""
    own = atoms.join(frames.select("sid", "cell"), "sid")
    reach = max(settings[0], settings[2])
    columns = ["sid", "i", "j", "species_i", "species_j", "dx", "dy", "dz", "d"]
    free = spatial.edges(own.where("cell is null"), reach).select(*columns, *[F.lit(0).alias(o) for o in ("ox", "oy", "oz")])
    found = free.unionByName(spatial.periodic_edges(own.where("cell is not null"), reach).select(*columns, "ox", "oy", "oz"))
    made = spatial.descriptors(atoms.select("sid", "aid", "species"), found, *settings, spins, min_cutoff).select("sid", "aid", "fingerprint")
    return atoms.drop("fingerprint").join(made, ["sid", "aid"])


def save(frames: DataFrame, atoms: DataFrame, folder: str, name: str = "", species: list[str] | None = None, references: dict[str, float] | None = None) -> None:
    """A training set in a folder, whole or not at all; ``meta`` has name, species, reference energies, counts and the range of
    the frames' energies an atom (e_ref where they have it, else energy / n_atoms)."""
    spark, stage = frames.sparkSession, folder.rstrip("/") + ".part"
    frames.repartitionByRange("sid").sortWithinPartitions("sid").write.mode("overwrite").parquet(f"{stage}/frames")
    atoms.repartitionByRange("sid", "aid").sortWithinPartitions("sid", "aid").write.mode("overwrite").parquet(f"{stage}/atoms")
    written = spark.read.parquet(f"{stage}/frames")
    value = F.col("e_ref") if "e_ref" in written.columns else F.try_divide(F.col("energy"), F.col("n_atoms"))
    header = energies.trainset_header(written.withColumn("e_ref", value))
    names = species or [r["species"] for r in atoms.select("species").distinct().orderBy("species").collect()]
    meta = header.withColumns({"name": F.lit(name), "species": F.array(*map(F.lit, names)).cast("array<string>"), "references": F.array(*[F.lit(float((references or {}).get(s, 0.0))) for s in names]).cast("array<double>"), "n_with_forces": F.lit(written.where("has_forces").count())})
    meta.coalesce(1).write.mode("overwrite").parquet(f"{stage}/meta")
    _move(spark, stage, folder.rstrip("/"))


def featurise(read_rows: DataFrame, folder: str, spins: dict[str, int], settings: tuple[float, int, float, int], references: dict[str, float] | None = None, name: str = "", **limits) -> None:
    """Frames read, filtered, described and saved in one go."""
    frames, atoms = build(read_rows, references, **limits)
    structures.check_species(atoms, list(spins))
    save(frames, with_features(frames, atoms, spins, settings), folder, name, list(spins), references)


@dataclass
class TrainingSet:
    """A saved set. Numbers below 0 count from its end; what is chosen is a filter on ``sid``, by which files are sorted."""

    frames: DataFrame
    atoms: DataFrame
    meta: Row

    def __len__(self) -> int:
        return self.meta["n_structures"]

    def _number(self, k: int) -> int:
        if not -len(self) <= k < len(self):
            raise IndexError(f"structure {k} of {len(self)}")
        return k % len(self)

    def __getitem__(self, k: int | slice) -> tuple[DataFrame, DataFrame]:
        """(frames, atoms) of one structure or a slice of them."""
        if isinstance(k, slice):
            first, stop, step = k.indices(len(self))
            if step < 0:
                raise ValueError("slices go upwards")
            chosen = (F.col("sid") >= first) & (F.col("sid") < stop) & ((F.col("sid") - first) % step == 0)
        else:
            chosen = F.col("sid") == self._number(k)
        return self.frames.where(chosen), self.atoms.where(chosen)

    def __iter__(self) -> Iterator[tuple[Row, list[Row]]]:
        """Structures in their order, one after the other; rows come partition by partition, so the driver holds one of them."""
        return self.cursor()

    def cursor(self, start: int = 0) -> Iterator[tuple[Row, list[Row]]]:
        rows = structures.nest_frames(self.frames.where(F.col("sid") >= start), self.atoms.where(F.col("sid") >= start))
        for row in rows.orderBy("sid").toLocalIterator():
            yield row, list(row["atoms"] or [])


def load(spark: SparkSession, folder: str, coords: bool = True, forces: bool = True, features: bool = True) -> TrainingSet:
    """A saved set; places, forces and features are read only if they are wanted."""
    folder = folder.rstrip("/")
    atoms = spark.read.parquet(f"{folder}/atoms")
    atoms = atoms.drop(*([] if coords else _XYZ), *([] if forces else _FORCES), *([] if features else ["fingerprint"]))
    return TrainingSet(spark.read.parquet(f"{folder}/frames"), atoms, spark.read.parquet(f"{folder}/meta").first())


def species_statistics(atoms: DataFrame) -> DataFrame:
    """(species, dim, low, high, mean, std, square) of features of each species; square is the mean of their squares."""
    v = atoms.select("species", F.posexplode("fingerprint").alias("dim", "v"))
    return v.groupBy("species", "dim").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.col("v") * F.col("v")).alias("square"))
