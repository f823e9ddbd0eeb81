"""The command line: ``python -m atomspan.cli TOOL ...``.

A tool is a function of a session and its arguments that is registered with the options it takes; a package of one's own can
register more by a module that is named in the environment variable ATOMSPAN_TOOLS (several by commas).
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import SparkSession, functions as F

TOOLS: dict[str, tuple[Callable, Callable]] = {}


def tool(name: str, options: Callable[[argparse.ArgumentParser], None]):
    """Registers a function of (session, arguments) that prints what it finds."""
    return lambda f: TOOLS.setdefault(name, (f, options))[0]


@lru_cache(1)
def discovered() -> dict[str, tuple[Callable, Callable]]:
    """All tools, with those of the modules that the environment names; looked for once."""
    for module in filter(None, os.environ.get("ATOMSPAN_TOOLS", "").split(",")):
        importlib.import_module(module.strip())
    return TOOLS


def _sources(p: argparse.ArgumentParser) -> None:
    p.add_argument("paths", nargs="+")
    p.add_argument("--format", help="of the files; by their names if not given")


@tool("formats", lambda p: None)
def formats_tool(spark, args) -> None:
    from .sources import formats

    for name, readable, writable in formats.formats():
        print(f"{name:14} {'read' if readable else '':6} {'write' if writable else ''}".rstrip())


@tool("info", _sources)
def info_tool(spark, args) -> None:
    from .sources import archives

    rows = archives.structures(spark, args.paths, args.format)
    out = rows.groupBy("path").agg(F.count("frame").alias("frames"), F.max(F.size("atoms")).alias("atoms"), F.max(F.col("cell").isNotNull()).alias("periodic"), F.max("error").alias("error"))
    for r in out.orderBy("path").toLocalIterator():
        print(f"{r['path']}: {r['error']}" if r["error"] else f"{r['path']}: {r['frames']} frames, {r['atoms']} atoms, {'periodic' if r['periodic'] else 'isolated'}")


def _conversion(p: argparse.ArgumentParser) -> None:
    _sources(p)
    p.add_argument("--to", required=True, help="format to write")
    p.add_argument("--out", required=True, help="folder to write to")
    p.add_argument("--frame", type=int, help="only this one of each structure, from the end if negative")
    numbers = lambda kind: lambda text: [kind(x) for x in text.split(",")]
    p.add_argument("--fix", type=numbers(int), help="numbers of atoms, from 1")
    p.add_argument("--remove", type=numbers(int), help="numbers of atoms, from 1")
    p.add_argument("--transform", type=numbers(float), help="nine numbers of a matrix, row by row")
    p.add_argument("--supercell", type=numbers(int), help="three numbers")
    p.add_argument("--rotate", type=numbers(float), help="an axis and degrees: four numbers")
    p.add_argument("--shift", help="origin, box, or three numbers")
    p.add_argument("--scale", type=numbers(float), help="one number or three")
    p.add_argument("--cut", type=numbers(float), help="an atom's number and a radius")
    p.add_argument("--vacuum", type=float)
    for flag in ("align", "standard-cell", "wrap", "sort"):
        p.add_argument(f"--{flag}", action="store_true")


@tool("convert", _conversion)
def convert_tool(spark, args) -> None:
    from .operators import structures
    from .plans import chain
    from .sources import archives, formats

    rows = archives.structures(spark, args.paths, args.format).where("error is null")
    if args.frame is not None:
        rows = structures.frame_at(rows, args.frame, ("path",))
    options = {"align_frames": args.align, "fix_atoms": args.fix, "remove_atoms": args.remove, "supercell": args.supercell, "standard_cell": args.standard_cell, "scale": args.scale, "cut": args.cut, "vacuum": args.vacuum, "wrap": args.wrap, "sort": args.sort}
    options["transform"] = [args.transform[k : k + 3] for k in (0, 3, 6)] if args.transform else None
    options["rotate"] = (tuple(args.rotate[:3]), args.rotate[3]) if args.rotate else None
    options["shift"] = args.shift if args.shift in (None, "origin", "box") else tuple(map(float, args.shift.split(",")))
    wanted = {k: v for k, v in options.items() if v not in (None, False)}
    if wanted:
        kept = rows.select("path", "frame", "energy", "step")
        periodic = rows.where("cell is not null")
        done = None
        for part in (periodic, rows.where("cell is null").drop("cell")):
            cell = ["cell"] if "cell" in part.columns else []
            own = {k: v for k, v in wanted.items() if cell or k not in ("align_frames", "transform", "supercell", "standard_cell", "wrap")}
            atoms = part.select(F.col("path").alias("sid"), "frame", *cell, F.posexplode("atoms").alias("aid", "a")).select("sid", "frame", "aid", "a.*", *cell)
            out = chain.convert(atoms, **own)
            labels = [c for c in ("fx", "fy", "fz") if c in out.columns]
            force = [F.col(c) if c in labels else F.lit(None).cast("double").alias(c) for c in ("fx", "fy", "fz")]
            box = F.col("cell") if "cell" in out.columns else F.lit(None).cast("array<array<double>>").alias("cell")
            nested = out.select("sid", "frame", "aid", "species", "x", "y", "z", *force, box).groupBy("sid", "frame").agg(F.first("cell").alias("cell"), F.transform(F.array_sort(F.collect_list(F.struct("aid", "species", "x", "y", "z", "fx", "fy", "fz"))), lambda x: x.dropFields("aid")).alias("atoms"))
            done = nested if done is None else done.unionByName(nested)
        same = not set(wanted) - {"align_frames", "fix_atoms", "rotate", "shift", "wrap", "sort", "standard_cell"}
        rows = done.withColumnRenamed("sid", "path").join(kept if same else kept.withColumn("energy", F.lit(None).cast("double")), ["path", "frame"]).withColumn("error", F.lit(None).cast("string"))
    formats.write(rows, args.out, args.to)


def _featuring(p: argparse.ArgumentParser) -> None:
    _sources(p)
    p.add_argument("--out", required=True)
    p.add_argument("--species", required=True, help="in the order of their typespins, by commas")
    p.add_argument("--radial", default="6.0,5", help="cutoff and order")
    p.add_argument("--angular", default="4.0,3", help="cutoff and order")
    p.add_argument("--references", default="{}", help="JSON of species and energies")


@tool("featurise", _featuring)
def featurise_tool(spark, args) -> None:
    from .functions.scalars import typespins
    from .sources import archives, datasets

    species = args.species.split(",")
    radial, angular = (x.split(",") for x in (args.radial, args.angular))
    settings = (float(radial[0]), int(radial[1]), float(angular[0]), int(angular[1]))
    datasets.featurise(archives.structures(spark, args.paths, args.format), args.out, dict(zip(species, typespins(len(species)), strict=True)), settings, {s: 0.0 for s in species} | json.loads(args.references))
    print(json.dumps({"structures": len(datasets.load(spark, args.out))}))


@tool("references", _sources)
def references_tool(spark, args) -> None:
    from .operators import energies
    from .sources import archives

    rows = archives.structures(spark, args.paths, args.format).where("energy is not null").withColumn("sid", F.struct("path", "frame"))
    atoms = rows.select("sid", F.explode("atoms").alias("a")).select("sid", "a.species")
    species = [r["species"] for r in atoms.select("species").distinct().orderBy("species").collect()]
    print(json.dumps(energies.reference_fit(energies.composition(atoms, species).join(rows.select("sid", "energy"), "sid"), species)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="atomspan")
    commands = parser.add_subparsers(dest="tool", required=True)
    for name, (_, options) in sorted(discovered().items()):
        options(commands.add_parser(name))
    args = parser.parse_args(argv)
    discovered()[args.tool][0](spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
