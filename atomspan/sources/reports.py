"""What is written for people and other programs: tables of energies, histories, committees, potentials, input decks."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.network import Layers

# Codes of activations in text potentials.
ACTIVATION_CODES = {"linear": 0, "tanh": 1, "sigmoid": 2, "mtanh": 3, "twist": 4}


def energy_lines(compared: DataFrame, counts: DataFrame, species: list[str], key: str = "sid", path: str = "path") -> DataFrame:
    """(key, line): a line of each structure of :func:`~..operators.structures.compare` (with ``path``): reference and predicted
    energy, atoms, both an atom, difference, cost (its square an atom), atoms of each species, path. ``counts`` has n_<species>."""
    rows = compared.join(counts, key)
    number = lambda c: F.format_string("%14.6E", c.cast("double"))
    each = [F.col("reference"), F.col("predicted")]
    an_atom = [F.try_divide(c, F.col("n_atoms")) for c in each]
    parts = [*map(number, each), F.format_string("%6d", F.col("n_atoms")), *map(number, an_atom), number(F.col("per_atom")), number(F.col("per_atom") * F.col("per_atom")), *[F.format_string("%5d", F.col(f"n_{s}")) for s in species], F.col(path)]
    return rows.select(key, F.concat_ws(" ", *parts).alias("line"))


def energy_header(species: list[str]) -> str:
    return " ".join(["Ref(eV)", "ANN(eV)", "#atoms", "Ref(eV/atom)", "ANN(eV/atom)", "Ref-ANN(eV/atom)", "Cost-Func", *species, "Path-of-input-file"])


def save_energies(compared: DataFrame, counts: DataFrame, species: list[str], folder: str, key: str = "sid") -> None:
    """The lines under a header, in the order of the key, as text files; the header is the first file's first line."""
    lines = energy_lines(compared, counts, species, key)
    head = compared.sparkSession.createDataFrame([(0, energy_header(species))], "o int, line string").select("o", F.lit(None).cast(dict(lines.dtypes)[key]).alias("k"), "line")
    both = head.unionByName(lines.select(F.lit(1).alias("o"), F.col(key).alias("k"), "line"))
    both.repartitionByRange("o", "k").sortWithinPartitions("o", "k").select("line").write.mode("overwrite").text(folder)


def error_curves(epochs: DataFrame, metrics: tuple[str, ...], epoch: str = "epoch") -> DataFrame:
    """(epoch, metric, value): what a picture of training errors shows, finite values only."""
    long = epochs.select(epoch, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("e")).select(epoch, "e.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def correlation(compared: DataFrame) -> DataFrame:
    """One row of :func:`~..operators.structures.compare`: n, rmse and mae an atom, slope, intercept and r2 of predicted over
    reference energies an atom; what a picture of their correlation says."""
    x, y, e = F.try_divide(F.col("reference"), F.col("n_atoms")), F.try_divide(F.col("predicted"), F.col("n_atoms")), F.col("per_atom")
    return compared.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def save_history(history: DataFrame, folder: str) -> None:
    """A history's rows as JSON lines and as CSV with a header, in two folders."""
    rows = history.orderBy("epoch")
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/history.json")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/history.csv")


def append_fingerprints(fingerprints: DataFrame, folder: str, vector: str = "fingerprint", n: int | None = None) -> None:
    """Fingerprints appended as CSV: a column for each component, those of the longest unless n is given."""
    n = n or fingerprints.agg(F.max(F.size(vector))).first()[0] or 0
    rest = [c for c in fingerprints.columns if c != vector]
    fingerprints.select(*rest, *[F.get(vector, F.lit(k)).alias(f"f{k}") for k in range(n)]).write.mode("append").csv(folder)


def committee_metadata(members: DataFrame, **settings) -> DataFrame:
    """One row ``json``: the settings and each member's row, in the order of ``member``."""
    rows = F.array_sort(F.collect_list(F.struct("member", *[c for c in members.columns if c != "member"])))
    known = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())])) if settings else F.lit("{}")
    return members.agg(F.to_json(rows).alias("m")).select(F.concat(F.lit('{"settings":'), known, F.lit(',"members":'), "m", F.lit("}")).alias("json"))


def msd_report(curve: DataFrame, dt: float = 1.0, value: str = "msd") -> DataFrame:
    """(lag, line): time and mean squared displacement in columns."""
    return curve.select("lag", F.format_string("%12.4f %16.8f", (F.col("lag") * dt).cast("double"), F.col(value).cast("double")).alias("line")).orderBy("lag")


def potential(species: str, layers: Layers, neighbours: list[str], settings: dict, stats: list[dict] | None = None, meta: dict | None = None) -> str:
    """A species' potential as text in sections: its network (nodes, activation codes, then weights and biases layer by layer), the
    set-up of its descriptors, statistics of its features (rows with dim, low, high, mean, square), and its training set."""
    nodes = [layers[0][0].shape[0], *[len(b) for _, b, _ in layers]]
    values = np.concatenate([np.concatenate([w.T.ravel(), b]) for w, b, _ in layers])
    wrap = lambda v: [" ".join("%24.17E" % x for x in v[i : i + 4]) for i in range(0, len(v), 4)]
    lines = ["[network]", str(len(nodes)), str(max(nodes)), str(len(values)), " ".join(map(str, nodes)), " ".join(str(ACTIVATION_CODES[a]) for _, _, a in layers), *wrap(values.tolist())]
    lines += ["[setup]", species, " ".join(neighbours), json.dumps(settings, sort_keys=True)]
    lines.append("[statistics]")
    lines += ["%d %24.17E %24.17E %24.17E %24.17E" % (s["dim"], s["low"], s["high"], s["mean"], s["square"]) for s in sorted(stats or [], key=lambda s: s["dim"])]
    lines += ["[trainset]", json.dumps(meta or {}, sort_keys=True)]
    return "\n".join(lines) + "\n"


def read_potential(text: str) -> tuple[str, Layers, list[str], dict, list[dict], dict]:
    """What :func:`potential` wrote."""
    parts = dict(zip(("network", "setup", "statistics", "trainset"), (p.strip("\n").split("\n") for p in text.split("[network]\n", 1)[1].replace("[setup]\n", "\x1f").replace("[statistics]\n", "\x1f").replace("[trainset]\n", "\x1f").split("\x1f")), strict=True))
    net = parts["network"]
    nodes, codes = list(map(int, net[3].split())), list(map(int, net[4].split()))
    names = {v: k for k, v in ACTIVATION_CODES.items()}
    values = np.array(" ".join(net[5:]).split(), float)
    layers, i = [], 0
    for a, b, code in zip(nodes[:-1], nodes[1:], codes, strict=True):
        layers.append((values[i : i + a * b].reshape(b, a).T.copy(), values[i + a * b : i + a * b + b].copy(), names[code]))
        i += a * b + b
    stats = [dict(zip(("dim", "low", "high", "mean", "square"), (int(w[0]), *map(float, w[1:])), strict=True)) for w in map(str.split, parts["statistics"]) if w]
    return parts["setup"][0], layers, parts["setup"][1].split(), json.loads(parts["setup"][2]), stats, json.loads(parts["trainset"][0])


def manifest(settings: dict, species: list[str]) -> tuple[str, str]:
    """Canonical JSON of a descriptor's settings and its SHA-256: equal for descriptors whose features are the same."""
    text = json.dumps({"settings": settings, "species": species}, sort_keys=True, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest()


def restore_manifest(text: str, signature: str | None = None) -> tuple[dict, list[str]]:
    """Settings and species of a manifest, whose signature must be the given one."""
    if signature is not None and hashlib.sha256(text.encode()).hexdigest() != signature:
        raise ValueError("the manifest isn't the one that was signed")
    found = json.loads(text)
    return found["settings"], found["species"]


def generate_deck(output: str, species: dict[str, float], setups: dict[str, str], files: list[str], timing: bool = False) -> str:
    """Input for making a training set from structure files: output, species with reference energies, set-up files, paths."""
    lines = [f"OUTPUT {output}", "", "TYPES", str(len(species)), *[f"{s} {e!r}" for s, e in species.items()], "", *(["TIMING", ""] if timing else []), "SETUPS", *[f"{s} {p}" for s, p in setups.items()], "", "FILES", str(len(files)), *files]
    return "\n".join(lines) + "\n"


def train_deck(trainset: str, networks: dict[str, tuple[str, list[tuple[int, str]]]], test_percent: float, iterations: int, method: str, settings: dict | None = None, max_energy: float | None = None) -> str:
    """Input for training: the set, share of test structures, iterations, a method with its settings, and of each species the
    file and hidden layers."""
    line = " ".join([method, *[f"{k}={v}" for k, v in (settings or {}).items()]])
    nets = [f"{s} {path} {len(hidden)} " + " ".join(f"{n}:{a}" for n, a in hidden) for s, (path, hidden) in networks.items()]
    limit = [f"MAXENERGY {max_energy!r}"] if max_energy is not None else []
    return "\n".join([f"TRAININGSET {trainset}", f"TESTPERCENT {test_percent:g}", f"ITERATIONS {iterations}", *limit, "", "METHOD", line, "", "NETWORKS", *nets]) + "\n"


def predict_deck(networks: dict[str, str], files: list[str], forces: bool = False) -> str:
    """Input for predictions: species with their networks, paths, and whether forces are wanted."""
    lines = ["TYPES", str(len(networks)), *networks, "", "NETWORKS", *[f"{s} {p}" for s, p in networks.items()], "", *(["FORCES", ""] if forces else []), "FILES", str(len(files)), *files]
    return "\n".join(lines) + "\n"


def metrics_line(n: int, euclid: float, cosine: float, pearson: float, log_det: float | None = None) -> str:
    """A set's diversity in one line."""
    parts = [f"n = {n}", f"euclidean {euclid:.3f}", f"cosine {cosine:.3f}", f"pearson {pearson:.3f}"]
    return ", ".join(parts + ([f"log-det {log_det:.3f}"] if log_det is not None else []))


def mean_and_deviation(mean: float, deviation: float) -> str:
    return f"{mean:.6g} ± {deviation:.6g}"
