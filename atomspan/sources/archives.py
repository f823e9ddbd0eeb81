"""Where structures come from: files, archives, records, and whatever of these one is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import formats


def members(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, archive, member, idx) of the files in tar archives, packed or not, whose names end in one of the suffixes;
    path is archive::member, with @member=idx where an archive has a name twice. An archive is read in one task."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    for k, info in enumerate(tar):
                        if info.isfile() and (not suffixes or info.name.endswith(tuple(suffixes))):
                            yield pd.DataFrame([(path, info.name, k, tar.extractfile(info).read())], columns=["archive", "member", "idx", "content"])

    rows = files.mapInPandas(run, "archive string, member string, idx int, content binary")
    twice = F.count("*").over(Window.partitionBy("archive", "member")) > 1
    base = F.concat("archive", F.lit("::"), "member")
    return rows.withColumn("path", F.when(twice, F.concat(base, F.lit("@member="), "idx")).otherwise(base)).select("path", "content", "archive", "member", "idx")


def read_archives(spark: SparkSession, paths: str | list[str], form: str | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Frames of the files in tar archives (see :data:`.formats.SCHEMA`); the format by each member's name."""
    found = members(spark, paths, suffixes)
    return formats.parse(found.select(F.col("path"), "content"), form) if form else _by_member(found)


def _by_member(found: DataFrame) -> DataFrame:
    """Parsed by the member's name; rows keep the full path."""
    rows = formats.parse(found.select(F.concat("path", F.lit("\x1f/"), F.regexp_replace("member", "^.*/", "")).alias("path"), "content"))
    return rows.withColumn("path", F.split("path", "\x1f")[0])


def load(spark: SparkSession, ids: list[str], loader: Callable[[str], list[formats.Frame]]) -> DataFrame:
    """Frames that a function of one's own gives for source ids, run in tasks; an id that fails is a row with ``error``."""
    rows = spark.createDataFrame([(i,) for i in ids], "path string").repartition(max(1, min(len(ids), spark.sparkContext.defaultParallelism)))

    def run(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    out += formats.as_rows(path, loader(path))
                except Exception as e:  # whatever a loader raises is about its source
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}", None))
            yield formats.as_pandas(out)

    return rows.mapInPandas(run, formats.SCHEMA)


def records(spark: SparkSession, frames: list[formats.Frame]) -> DataFrame:
    """Frames given as dicts (see :mod:`.formats`; ``name`` is optional), as rows: path is the name, or structure_ and the number in
    six digits. Dicts of one name are its frames, in their order."""
    rows, seen = [], {}
    for k, f in enumerate(frames):
        if not {"cell", "energy", "atoms"} <= set(f):
            raise ValueError(f"record {k} lacks one of cell, energy, atoms")
        name = f.get("name") or f"structure_{k:06d}"
        atoms = [tuple(a) + (None,) * (7 - len(a)) for a in f["atoms"]]
        (row,) = formats.as_rows(name, [formats._frame(atoms, f["cell"], f["energy"])])
        rows.append((row[0], seen.get(name, 0), *row[2:]))
        seen[name] = seen.get(name, 0) + 1
    return spark.createDataFrame(rows, formats.SCHEMA)


def structures(spark: SparkSession, source, form: str | None = None) -> DataFrame:
    """Frames of a source: a table of frames as it is, a path or several, tar archives by their names, or records. A list must
    be of one kind."""
    if isinstance(source, DataFrame):
        if missing := {"path", "frame", "cell", "energy", "atoms"} - set(source.columns):
            raise ValueError(f"a table of frames lacks {sorted(missing)}")
        return source
    if isinstance(source, dict):
        source = [source]
    many = [source] if isinstance(source, str) else list(source)
    if not many or len({type(x) for x in many}) != 1 or not isinstance(many[0], (str, dict)):
        raise ValueError("a source is a table, paths or records, and not several of them")
    if isinstance(many[0], dict):
        return records(spark, many)
    packed = [p for p in many if p.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz"))]
    plain = [p for p in many if p not in packed]
    parts = ([read_archives(spark, packed, form)] if packed else []) + ([formats.read(spark, plain, form)] if plain else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def named(frames: DataFrame, name: str = "name") -> DataFrame:
    """Frames with ``name``: that which they have, or their path where it is null or empty."""
    own = F.nullif(F.col(name), F.lit("")) if name in frames.columns else F.lit(None).cast("string")
    return frames.withColumn(name, F.coalesce(own, F.col("path")))
