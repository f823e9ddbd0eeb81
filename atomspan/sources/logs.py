"""Training logs and tables of energies, read as text with column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def train_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, epoch, mae_train, rmse_train, mae_test, rmse_test) of the epoch lines of training logs."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("v")).where(F.col("v").rlike("^[0-9].*<$"))
    w = F.split("v", r"\s+")
    numbers = F.filter(F.slice(w, 2, F.size(w)), lambda x: x.rlike(r"^[-+0-9.][-+0-9.eE]*$"))
    return lines.select("path", w[0].cast("int").alias("epoch"), *[F.get(numbers, F.lit(k)).cast("double").alias(n) for k, n in enumerate(("mae_train", "rmse_train", "mae_test", "rmse_test"))])


def energy_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table of numbers in columns that white space parts; lines that begin with no number are left out, the path is last.

    Without ``columns`` they are named by the first line of the first file (without #, Cost Func as one name), and the path is
    of the name that the header gives its last column.
    """
    last = "path"
    if columns is None:
        head = spark.read.text(path).where(F.trim("value") != "").first()
        names = (head["value"] if head else "").replace("Cost Func", "Cost-Func").replace("#", "").split()
        columns, last = names[:-1], names[-1] if names else "path"
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where(F.col("v").rlike(r"^[-+0-9.]"))
    w = F.split("v", r"\s+")
    return lines.select(*[F.get(w, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(columns)], F.element_at(w, -1).alias(last))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, cohesive, total): energies of each structure in prediction logs."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("t"))
    numbers = lambda name: F.transform(F.regexp_extract_all("t", F.lit(name + r"\s*:\s*([-+0-9.eE]+)"), F.lit(1)), lambda x: x.cast("double"))
    both = F.arrays_zip(numbers("Cohesive energy").alias("cohesive"), numbers("Total energy").alias("total"))
    return text.select("path", F.posexplode(both).alias("nth", "e")).select("path", "nth", "e.*")


def atom_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, aid, species, x, y, z, fx, fy, fz, e_atom): atoms of each structure in prediction logs.

    An atom's line has its species, place, and if they were predicted its force and energy; a line of fewer than seven
    numbers and names has no force, and a line without an energy has NaN.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"Cohesive energy\s*:").alias("parts"))
    each = text.select("path", F.posexplode(F.expr("slice(parts, 1, size(parts) - 1)")).alias("nth", "t"))
    real = r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?"
    lines = F.regexp_extract_all("t", F.lit(rf"(?m)^[ \t]*[A-Z][a-z]?(?:[ \t]+{real}){{3,}}[ \t]*$"), F.lit(0))
    w = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.get(w, F.lit(k)).try_cast("double")
    forced = F.size(w) >= 7
    rows = each.select("path", "nth", F.posexplode(lines).alias("aid", "line"))
    energy = F.when(F.size(w) == 8, at(7)).when(F.size(w) == 5, at(4)).otherwise(F.lit(float("nan")))
    return rows.select("path", "nth", "aid", w[0].alias("species"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), *[F.when(forced, at(4 + k)).alias(c) for k, c in enumerate(("fx", "fy", "fz"))], energy.alias("e_atom"))


def training_set(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, structure, energy, atoms) of text training sets.

    After the header (name, normalised, scale, shift, species and their energies, counts, range of energies) each structure has
    its path, counts, energy, and for each atom species number, place, force, number of features, and features.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("t"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for where, text in zip(pdf["path"], pdf["t"], strict=True):
                lines = [x.strip() for x in text.splitlines()]
                kinds = int(lines[4].split()[0])
                species = " ".join(lines[5:]).split()[:kinds]
                # The header ends with the line that holds three energies before the first structure's path.
                head = next(i for i in range(5, len(lines)) if len(lines[i].split()) == 3 and i + 2 < len(lines) and len(lines[i + 2].split()) == 2) + 1
                i, k = head, 0
                while i + 2 < len(lines) and lines[i]:
                    n = int(lines[i + 1].split()[0])
                    atoms, j = [], i + 3
                    for _ in range(n):
                        kind, xyz, force, _, features = lines[j : j + 5]
                        atoms.append({"species": species[int(kind) - 1], "x": float(xyz.split()[0]), "y": float(xyz.split()[1]), "z": float(xyz.split()[2]), "fx": float(force.split()[0]), "fy": float(force.split()[1]), "fz": float(force.split()[2]), "fingerprint": [float(v) for v in features.split()]})
                        j += 5
                    out.append((where, k, lines[i], float(lines[i + 2]), atoms))
                    i, k = j, k + 1
            yield pd.DataFrame(out, columns=["path", "nth", "structure", "energy", "atoms"])

    return rows.mapInPandas(run, "path string, nth int, structure string, energy double, atoms array<struct<species:string,x:double,y:double,z:double,fx:double,fy:double,fz:double,fingerprint:array<double>>>")
