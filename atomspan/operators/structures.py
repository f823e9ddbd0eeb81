"""Structures and frames as sets: choosing, naming, sorting, merging and comparing them.

Atoms are rows (keys..., aid, ...), frames rows (keys..., ...); whatever an index in a list would say is a key column here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("sid",)


def _numbered(atoms: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """aid counted from 0 in an order, as the type that it has."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return atoms.withColumn("__n", n).withColumn("aid", F.col("__n").cast(dict(atoms.dtypes)["aid"])).drop("__n")


# Choosing


def of_type(atoms: DataFrame, species: str) -> DataFrame:
    return atoms.where(F.col("species") == species)


def indices_by_type(atoms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, species, aids): sorted numbers of the atoms of each species of a structure."""
    return atoms.groupBy(*keys, "species").agg(F.array_sort(F.collect_list("aid")).alias("aids"))


def frame_at(frames: DataFrame, number: int = -1, keys: tuple[str, ...] = KEYS, frame: str = "frame") -> DataFrame:
    """One frame of each structure: counted from 0, or from the end if negative; the nearest where there are too few."""
    if number >= 0:
        chosen = F.least(F.lit(number), F.col("__hi"))
    else:
        chosen = F.greatest(F.col("__hi") + 1 + number, F.col("__lo"))
    ends = frames.groupBy(*keys).agg(F.min(frame).alias("__lo"), F.max(frame).alias("__hi"))
    return frames.join(ends, list(keys)).where(F.col(frame) == chosen).drop("__lo", "__hi")


def stride(frames: DataFrame, first: int = 0, last: int | None = None, skip: int = 1, frame: str = "frame") -> DataFrame:
    """Every ``skip``-th frame from ``first`` to ``last``, both counted from 0 and both included."""
    kept = frames.where((F.col(frame) >= first) & ((F.col(frame) - first) % skip == 0))
    return kept if last is None else kept.where(F.col(frame) <= last)


def amend_energy(frames: DataFrame, energy: float | Column, keys: tuple[str, ...] = KEYS, frame: str = "frame") -> DataFrame:
    """The energy of each structure's last frame replaced."""
    value = energy if isinstance(energy, Column) else F.lit(float(energy))
    last = frames.groupBy(*keys).agg(F.max(frame).alias("__hi"))
    return frames.join(last, list(keys)).withColumn("energy", F.when(F.col(frame) == F.col("__hi"), value).otherwise(F.col("energy"))).drop("__hi")


def amend_forces(atoms: DataFrame, forces: DataFrame, keys: tuple[str, ...] = ("sid", "frame")) -> DataFrame:
    """Forces fx, fy, fz replaced by those of another table with the atoms' keys; atoms that it lacks get null."""
    new = forces.select(*keys, "aid", "fx", "fy", "fz")
    return atoms.drop("fx", "fy", "fz").join(new, [*keys, "aid"], "left")


def with_forces(frames: DataFrame, atoms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``frames`` with ``has_forces``: whether all of a structure's atoms have forces, and it has atoms."""
    whole = atoms.groupBy(*keys).agg(F.min(F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("fz").isNotNull()).alias("has_forces"))
    return frames.drop("has_forces").join(whole, list(keys), "left").withColumn("has_forces", F.coalesce("has_forces", F.lit(False)))


def labelled(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``rows`` with ``labelled``: whether ``labels`` has a value for the key; a row for each matching label."""
    return rows.join(labels.select(key, F.col(label).alias("__l")), key, "left").withColumn("labelled", F.col("__l").isNotNull()).drop("__l")


def uses_forces(frames: DataFrame, weight: float, fraction: float = 1.0, sampled: DataFrame | None = None, key: str = "sid") -> DataFrame:
    """``frames`` with ``use_forces``: it has forces, they weigh something, and either all are taken or the frame is among
    the sampled keys."""
    if weight <= 0:
        return frames.withColumn("use_forces", F.lit(False))
    if fraction >= 1 or sampled is None:
        return frames.withColumn("use_forces", F.col("has_forces") if fraction >= 1 else F.lit(False))
    marked = frames.join(sampled.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return marked.withColumn("use_forces", F.col("has_forces") & F.coalesce("__in", F.lit(False))).drop("__in")


def check_species(atoms: DataFrame, species: list[str]) -> DataFrame:
    """``atoms``, of which none may be of a species that isn't declared: else an error that names the unknown ones, sorted."""
    unknown = [r["species"] for r in atoms.select("species").distinct().where(~F.col("species").isin(species) | F.col("species").isNull()).orderBy("species").limit(100).collect()]
    if unknown:
        raise ValueError(f"species that are not declared: {', '.join(map(str, unknown))}")
    return atoms


# Names


def identifier(df: DataFrame, candidates: list[str], number: str, frame: Column | str | None = None, always: bool = True) -> DataFrame:
    """``df`` with ``name``: the first candidate column that isn't null or empty, else structure_ and the number in six digits;
    then #frame= and the frame, always or for those other than 0."""
    base = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates], F.format_string("structure_%06d", F.col(number)))
    if frame is None:
        return df.withColumn("name", base)
    f = F.col(frame) if isinstance(frame, str) else frame
    suffix = F.concat(F.lit("#frame="), f.cast("string"))
    return df.withColumn("name", F.concat(base, suffix if always else F.when(F.coalesce(f, F.lit(0)) != 0, suffix).otherwise(F.lit(""))))


def repeated_names(df: DataFrame, name: str = "name") -> DataFrame:
    """(name, n) of names that are there more than once."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


# Sets


def append_frames(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = KEYS, frame: str = "frame") -> DataFrame:
    """Frames of the second after those of the first, structure by structure. Both must agree on each structure that both have
    in the column ``species`` (an array of the atoms' types), if there, and in being periodic; else an error."""
    ends = first.groupBy(*keys).agg(F.max(frame).alias("__hi"))
    start = second.groupBy(*keys).agg(F.min(frame).alias("__lo"))
    same = [c for c in ("species", "pbc") if c in first.columns and c in second.columns]
    if same:
        a = first.groupBy(*keys).agg(*[F.first(c).alias(c) for c in same])
        b = second.groupBy(*keys).agg(*[F.first(c).alias(f"__{c}") for c in same])
        differ = a.join(b, list(keys)).where(" or ".join(f"not ({c} <=> __{c})" for c in same))
        if bad := differ.select(*keys).limit(5).collect():
            raise ValueError(f"structures differ in atoms or periodicity: {[tuple(r) for r in bad]}")
    moved = second.join(start, list(keys)).join(ends, list(keys), "left")
    number = (F.col(frame) - F.col("__lo") + F.coalesce(F.col("__hi") + 1, F.lit(0))).cast(dict(first.dtypes)[frame])
    return first.unionByName(moved.withColumn(frame, number).drop("__lo", "__hi"), allowMissingColumns=True)


def add_frame(frames: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS, frame: str = "frame") -> DataFrame:
    """One more frame for structures: rows of ``new`` without a frame number, which they get."""
    return append_frames(frames, new.withColumn(frame, F.lit(0).cast(dict(frames.dtypes)[frame])), keys, frame)


def merge(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("sid", "frame"), offset: int | None = None) -> DataFrame:
    """Atoms of both, frame by frame: those of the second are numbered after the first's, or from ``offset`` on. The cell is
    the first's; energies and forces of the parts are left out. Where both have a structure (the first key), they must
    have the same number of frames, else an error."""
    plain = lambda df: df.drop("energy", "fx", "fy", "fz")
    a, b = plain(first), plain(second)
    if len(keys) > 1:
        count = lambda df, n: df.select(*keys).distinct().groupBy(keys[0]).agg(F.count("*").alias(n))
        if bad := count(a, "n").join(count(b, "m"), keys[0]).where("n != m").limit(5).collect():
            raise ValueError(f"numbers of frames differ: {[r[0] for r in bad]}")
    cell = ["cell"] if "cell" in a.columns else []
    ends = a.groupBy(*keys).agg(F.max("aid").alias("__hi"), *[F.first(c).alias(c) for c in cell])
    moved = b.drop("cell").join(ends, list(keys), "left")
    shift = F.coalesce(F.col("__hi") + 1, F.lit(0)) if offset is None else F.lit(offset)
    return a.unionByName(moved.withColumn("aid", (F.col("aid") + shift).cast(dict(a.dtypes)["aid"])).drop("__hi"), allowMissingColumns=True)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several tables, such as energies of several files; columns that one lacks are null in its rows."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def remove_atoms(atoms: DataFrame, numbers: list[int], keys: tuple[str, ...] = KEYS, start: int = 0) -> DataFrame:
    """Atoms without those of the given numbers (aid), the others counted anew from ``start`` as ``new_aid``."""
    left = atoms.where(~F.col("aid").isin(list(numbers)))
    return left.withColumn("new_aid", F.row_number().over(Window.partitionBy(*keys).orderBy("aid")) - 1 + start)


def sort_atoms(atoms: DataFrame, vocabulary: list[str] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """With ``place``, from 1: by species (in the order of the vocabulary, or of their names), then z downwards, then aid. Rows
    move whole, with their forces."""
    kind = F.col("species") if vocabulary is None else F.array_position(F.array(*map(F.lit, vocabulary)), F.col("species"))
    return atoms.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(kind, F.desc("z"), "aid")))


def sort_by_coordinate(atoms: DataFrame, coordinate: str = "z", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Atoms numbered by species, then a coordinate."""
    return _numbered(atoms, keys, ["species", coordinate, "aid"])


def equal_structures(first: DataFrame, second: DataFrame, columns: tuple[str, ...] = ("aid", "species", "x", "y", "z", "cell"), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, equal): whether both tables have exactly the same atoms for a key, which one of them may lack."""
    same = [c for c in columns if c in first.columns and c in second.columns]
    row = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)
    digest = lambda df, name: df.select(*keys, row.alias("h")).groupBy(*keys, "h").agg(F.count("*").alias(name))
    both = digest(first, "n").join(digest(second, "m"), [*keys, "h"], "full")
    return both.groupBy(*keys).agg(F.min(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("equal"))


def same_types(members: DataFrame, member: str = "member") -> DataFrame:
    """(member, species, same): each member's sorted set of species, and whether it is that of the first member."""
    sets = members.groupBy(member).agg(F.array_sort(F.collect_set("species")).alias("species"))
    return sets.withColumn("same", F.col("species") == sets.agg(F.min_by("species", member)).scalar())


def flatten_subset(*levels: DataFrame) -> DataFrame:
    """(idx, source): of subsets of subsets, each a table (idx, of) from a number in the subset to one in what it is of, the
    numbers in the outermost set."""
    out = levels[-1].select("idx", F.col("of").alias("source"))
    for level in reversed(levels[:-1]):
        out = out.join(level.select(F.col("idx").alias("__i"), F.col("of").alias("__s")), F.col("source") == F.col("__i")).select("idx", F.col("__s").alias("source"))
    return out


# Joins by position and by path


def zip_frames(first: DataFrame, *others: DataFrame, keys: tuple[str, ...] = ("sid", "frame")) -> DataFrame:
    """A trajectory's frames with what other tables say of the same frames; frames that one of them lacks keep nulls."""
    for other in others:
        first = first.join(other, [k for k in keys if k in other.columns], "left")
    return first


def merge_log(frames: DataFrame, log: DataFrame, step: str = "step", on: tuple[str, ...] = ()) -> DataFrame:
    """Frames with the energy that a log gives for exactly their time step; null where it gives none."""
    own = log.select(*on, step, F.col("energy").alias("__e")).dropDuplicates([*on, step])
    return frames.drop("energy").join(own, [*on, step], "left").withColumnRenamed("__e", "energy")


def compare(predictions: DataFrame, references: DataFrame, key: str = "sid", predicted: str = "energy", reference: str = "energy", n_atoms: str = "n_atoms") -> DataFrame:
    """(key, reference, predicted, n_atoms, difference, per_atom) of the structures that both have."""
    a = references.select(key, F.col(reference).alias("reference"), F.col(n_atoms).alias("n_atoms"))
    both = a.join(predictions.select(key, F.col(predicted).alias("predicted")), key)
    diff = F.col("predicted") - F.col("reference")
    return both.select(key, "reference", "predicted", "n_atoms", diff.alias("difference"), F.try_divide(diff, F.col("n_atoms")).alias("per_atom"))


def check_members(predictions: DataFrame, member: str = "member", key: str = "sid") -> DataFrame:
    """``predictions`` of several members, which must be of the same structures; else an error that names the first
    structures that some member lacks or has more often."""
    n = predictions.select(member).distinct().count()
    uneven = predictions.groupBy(key, member).agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("members"), F.max("n").alias("most")).where((F.col("members") != n) | (F.col("most") > 1))
    if bad := uneven.orderBy(key).limit(5).collect():
        raise ValueError(f"members differ in structures: {[r[0] for r in bad]}")
    return predictions


def payload(entries: DataFrame, cache: DataFrame, key: str = "entry_idx") -> DataFrame:
    """Entries with what a table of cached features or derivatives holds for them; ``cached`` says whether it does."""
    return entries.join(cache.withColumn("__c", F.lit(True)), key, "left").withColumn("cached", F.coalesce("__c", F.lit(False))).drop("__c")


# Statistics


def dataset_statistics(frames: DataFrame, atoms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row: n_structures, n_atoms, n_with_forces (by ``has_forces``, where frames have it), mean_atoms, species (sorted)."""
    forced = F.count_if("has_forces") if "has_forces" in frames.columns else F.lit(0).cast("long")
    a = frames.agg(F.count("*").alias("n_structures"), forced.alias("n_with_forces"))
    b = atoms.agg(F.count("*").alias("n_atoms"), F.array_sort(F.collect_set("species")).alias("species"))
    both = a.join(F.broadcast(b))  # two rows
    return both.select("n_structures", "n_atoms", "n_with_forces", F.try_divide(F.col("n_atoms"), F.col("n_structures")).alias("mean_atoms"), "species")


def composition_of(species: Column) -> Column:
    """Counts of an array of species as a map, in the order of their names."""
    names = F.array_sort(F.array_distinct(species))
    return F.map_from_arrays(names, F.transform(names, lambda s: F.size(F.filter(species, lambda x: x == s))))


def samples(frames: DataFrame, atoms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, composition, energy) of each frame that has an energy."""
    n = atoms.groupBy(*keys, "species").agg(F.count("*").cast("int").alias("n"))
    counts = n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "n")))).alias("composition"))
    return frames.where(F.col("energy").isNotNull()).select(*keys, "energy").join(counts, list(keys)).select(*keys, "composition", "energy")


def longest_descriptor(atoms: DataFrame, column: str = "fingerprint") -> DataFrame:
    """One row: n_features, the most that an atom has."""
    return atoms.agg(F.max(F.size(column)).alias("n_features"))


def collate(counts: DataFrame, batch: Column | str, key: str = "sid", n: str = "n_atoms") -> DataFrame:
    """``counts`` with ``offset``: the atoms of the structures before it (by key) in its batch, by which its atoms' and edges'
    numbers are shifted. A batch is small by its nature; sums go by batch."""
    b = F.col(batch) if isinstance(batch, str) else batch
    rows = counts.withColumn("__b", b)
    w = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0))).drop("__b")


def csr(found: DataFrame, atoms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, i, first, n): where each atom's edges begin in its structure's edges sorted by atom, and how many it has."""
    n = atoms.select(*keys, F.col("aid").alias("i")).join(found.groupBy(*keys, "i").agg(F.count("*").alias("n")), [*keys, "i"], "left").fillna(0, ["n"])
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).select(*keys, "i", "first", "n")


def flatten_frames(frames: DataFrame, columns: tuple[str, ...] = ("species", "x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms): frames with an array ``atoms`` of structs as two tables, keyed by all other columns' sid and frame."""
    keys = [c for c in ("sid", "frame") if c in frames.columns]
    atoms = frames.select(*keys, *(["cell"] if "cell" in frames.columns else []), F.posexplode("atoms").alias("aid", "a")).select(*keys, "aid", "a.*", *(["cell"] if "cell" in frames.columns else []))
    return frames.withColumn("n_atoms", F.size("atoms")).drop("atoms"), atoms


def nest_frames(frames: DataFrame, atoms: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Frames with their atoms as an array of structs in the order of aid; the inverse of :func:`flatten_frames`."""
    rest = [c for c in atoms.columns if c not in (*keys, "cell")]
    lists = atoms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("aid", *[c for c in rest if c != "aid"]))).alias("atoms"))
    return frames.join(lists, list(keys), "left")
