"""Training of atomic networks: losses, optimisers, samplers and epochs.

A training table has a row for each structure: sid, energy, n_atoms, species (array), fingerprints (array of arrays), and for
forces also fx, fy, fz (arrays over atoms) and the descriptor gradients as sparse arrays gi, gf, ga, gx, gy, gz
(:func:`training_table`). Parameters are small and live on the driver; a step sends them out, tasks hand back sums of
losses and gradients of a fixed size, and the driver moves on. What a step takes of the table is a batch by a hash of the key.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .network import Layers

Model = dict[str, Layers]
#: Activations: value, first derivative and second derivative by the value.
_SMOOTH = {
    "linear": (lambda x: x, lambda y: np.ones_like(y), lambda y: np.zeros_like(y)),
    "tanh": (np.tanh, lambda y: 1 - y * y, lambda y: -2 * y * (1 - y * y)),
    "sigmoid": (lambda x: 1 / (1 + np.exp(-x)), lambda y: y * (1 - y), lambda y: y * (1 - y) * (1 - 2 * y)),
}


def build(species: list[str], n_features: int, hidden: list[tuple[int, str]], seed: int = 0) -> Model:
    """A network for each species: hidden layers of (nodes, activation), then one linear output; weights at random with the
    variance 1 / inputs, biases 0."""
    for _, a in hidden:
        if a not in _SMOOTH:
            raise ValueError(f"unknown activation {a}")
    rng = np.random.default_rng(seed)
    sizes = [n_features, *[n for n, _ in hidden], 1]
    kinds = [*[a for _, a in hidden], "linear"]
    return {s: [(rng.normal(0, 1 / math.sqrt(max(1, a)), (a, b)), np.zeros(b), kind) for a, b, kind in zip(sizes[:-1], sizes[1:], kinds, strict=True)] for s in species}


def flatten(model: Model) -> np.ndarray:
    """All parameters in one vector, by species, layer, weights and bias."""
    return np.concatenate([np.concatenate([w.ravel(), b]) for s in sorted(model) for w, b, _ in model[s]])


def restore(model: Model, vector: np.ndarray) -> Model:
    """A model of the same shape with the parameters of a vector."""
    out, i = {}, 0
    for s in sorted(model):
        out[s] = []
        for w, b, a in model[s]:
            new = vector[i : i + w.size].reshape(w.shape).copy()
            out[s].append((new, vector[i + w.size : i + w.size + b.size].copy(), a))
            i += w.size + b.size
    return out


# Normalisation


def normalise_features(rows: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, dim, v): components of the long form less the mean, over the deviation or 1e-12 if that is larger; ``stats``
    has (dim, mean, std), a row for each feature."""
    return rows.join(F.broadcast(stats.select("dim", F.col("mean").alias("__m"), F.col("std").alias("__s"))), "dim").select(*keys, "dim", ((F.col("v") - F.col("__m")) / F.greatest(F.col("__s"), F.lit(1e-12))).alias("v"))


def denormalise_energy(energy: Column, n_atoms: Column, scaling: float = 1.0, shift: float = 0.0) -> Column:
    """Energy of a structure from a network's: over the scaling, with the shift for each atom."""
    return energy / scaling + shift * n_atoms


def denormalise_atom(energy: Column, reference: Column | float = 0.0, scaling: float = 1.0, shift: float = 0.0) -> Column:
    """Energy of an atom, so that atoms add up to their structure's energy."""
    return energy / scaling + shift + reference


# Losses of predictions that are there


def energy_loss(predicted: DataFrame, scaling: float = 1.0, shift: float = 0.0) -> DataFrame:
    """(n, loss) of (energy: by the network, n_atoms, reference): root mean square of the error an atom."""
    error = (denormalise_energy(F.col("energy"), F.col("n_atoms"), scaling, shift) - F.col("reference")) / F.col("n_atoms")
    return predicted.agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("loss"))


def force_loss(forces: DataFrame) -> DataFrame:
    """(n, loss) of (fx, fy, fz, rx, ry, rz): root mean square over all components; atoms without a reference are left out."""
    square = sum(((F.col(f"f{c}") - F.col(f"r{c}")) * (F.col(f"f{c}") - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0))
    return forces.where("rx is not null and ry is not null and rz is not null").agg((3 * F.count("*")).alias("n"), F.sqrt(F.avg(square) / 3).alias("loss"))


def combined_loss(energy: float, force: float, alpha: float) -> float:
    """(1 - alpha) of the energy's loss and alpha of the forces'."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    return (1 - alpha) * energy + alpha * force


def error_scores(draws: DataFrame, key: str = "sid", error: str = "error") -> DataFrame:
    """(key, n, score): mean error of each structure over the times that it was drawn."""
    return draws.groupBy(key).agg(F.count("*").alias("n"), F.avg(error).alias("score"))


def epoch_metrics(errors: DataFrame, epoch: str | list[str], batch: str, error: str) -> DataFrame:
    """(epoch, rmse, mae, rmse_all): the unweighted means over batches of their root mean square and mean absolute errors, as
    training reports them; and the root mean square over all rows."""
    keys = [epoch] if isinstance(epoch, str) else list(epoch)
    e = F.col(error)
    each = errors.where(e.isNotNull()).groupBy(*keys, batch).agg(F.sqrt(F.avg(e * e)).alias("r"), F.avg(F.abs(e)).alias("m"), F.sum(e * e).alias("s"), F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.avg("r").alias("rmse"), F.avg("m").alias("mae"), F.sqrt(F.try_divide(F.sum("s"), F.sum("n"))).alias("rmse_all"))


# Samplers


def subset_size(n: int, fraction: float, least: int = 1) -> int:
    """How many of n a fraction is: whole ones, ``least`` at least, n at most."""
    return min(n, max(int(n * fraction), least))


def sample_fraction(rows: DataFrame, fraction: float, seed: int, key: str = "sid") -> DataFrame:
    """ceil(n * fraction) rows at random without replacement, by a hash of the key and the seed."""
    k = math.ceil(rows.count() * fraction)
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def draw(rows: DataFrame, n: int, seed: int, weight: str = "weight", key: str = "sid") -> DataFrame:
    """n rows with replacement, each with a chance by its weight, as ``draws`` times each; rows never drawn are left out.

    Rows fall into buckets of about 50,000 by a hash of their key. Numbers for the buckets are drawn by their sums, then
    rows within each, so a task holds a bucket. Null and negative weights count as 0; if all are 0 nothing is drawn.
    """
    w = F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    buckets = max(1, rows.count() // 50_000)
    own = rows.withColumns({"__w": w, "__b": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    sums = {r["__b"]: r["s"] for r in own.groupBy("__b").agg(F.sum("__w").alias("s")).collect()}
    total = sum(sums.values())
    if not total:
        return own.limit(0).withColumn("draws", F.lit(0).cast("long")).drop("__w", "__b")
    names = sorted(sums)
    counts = dict(zip(names, np.random.default_rng(seed).multinomial(n, [sums[b] / total for b in names]).tolist(), strict=True))
    chosen = own.where(F.col("__w") > 0)

    def run(pdf):
        pdf = pdf.sort_values(key)
        b = int(pdf["__b"].iloc[0])
        p = pdf["__w"].to_numpy(float)
        pdf = pdf.assign(draws=np.random.default_rng([seed, b]).multinomial(counts[b], p / p.sum()))
        return pdf[pdf["draws"] > 0]

    from pyspark.sql import types

    schema = types.StructType([*chosen.schema.fields, types.StructField("draws", types.LongType())])
    return chosen.groupBy("__b").applyInPandas(run, schema).drop("__w", "__b")


def sampler(policy: str, rows: DataFrame, n: int, seed: int, errors: DataFrame | None = None, key: str = "sid") -> DataFrame:
    """``rows`` with ``draws``, by a policy: uniform (each once, whatever n), energy_weighted, or error_weighted, which takes
    (key, error) and is uniform where there are no errors yet."""
    from .energies import energy_weights, error_weights

    if policy == "uniform" or (policy == "error_weighted" and errors is None):
        return rows.withColumn("draws", F.lit(1).cast("long"))
    if policy == "energy_weighted":
        return draw(energy_weights(rows), n, seed, "weight", key).drop("weight")
    if policy == "error_weighted":
        return draw(error_weights(rows.join(errors.select(key, "error"), key, "left")), n, seed, "weight", key).drop("weight", "error")
    raise ValueError(f"unknown sampling policy {policy}")


# Epochs


@dataclass
class Sgd:
    rate: float = 0.01
    momentum: float = 0.0
    velocity: np.ndarray | None = None

    def step(self, x: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.velocity = gradient if self.velocity is None else self.momentum * self.velocity + gradient
        return x - self.rate * self.velocity


@dataclass
class Adam:
    rate: float = 1e-3
    decay: tuple[float, float] = (0.9, 0.999)
    small: float = 1e-8
    t: int = 0
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def step(self, x: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.first is None:
            self.first, self.second = np.zeros_like(x), np.zeros_like(x)
        self.t += 1
        a, b = self.decay
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient * gradient
        return x - self.rate * (self.first / (1 - a**self.t)) / (np.sqrt(self.second / (1 - b**self.t)) + self.small)


def optimiser(name: str, **settings) -> Sgd | Adam:
    """By name, adam or sgd; any other name is an error."""
    kinds = {"adam": Adam, "sgd": Sgd}
    if name.lower() not in kinds:
        raise ValueError(f"unknown optimiser {name}")
    return kinds[name.lower()](**settings)


@dataclass
class Plateau:
    """Lowers a rate by a factor when a metric hasn't been better for more than ``patience`` epochs."""

    patience: int = 10
    factor: float = 0.5
    least: float = 1e-8
    best: float = math.inf
    waited: int = 0

    def rate(self, metric: float, rate: float) -> float:
        if metric < self.best:
            self.best, self.waited = metric, 0
            return rate
        self.waited += 1
        if self.waited <= self.patience:
            return rate
        self.waited = 0
        return max(self.least, rate * self.factor)


def resamples(epoch: int, start: int, every: int) -> bool:
    """Whether the force sample is drawn anew: every so many epochs from the run's first; never if ``every`` is 0."""
    return every > 0 and (epoch - start) % every == 0


def first_epoch(state: dict | None, name: str = "") -> int:
    """The epoch to go on with: after the one a checkpoint holds, or that its file name ends with; 0 without either."""
    if state and state.get("epoch") is not None:
        return int(state["epoch"]) + 1
    found = re.findall(r"(\d+)", name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return int(found[-1]) + 1 if found else 0


def last_checkpoints(files: DataFrame, k: int, name: str = "name") -> DataFrame:
    """``files`` with ``keep``: whether a checkpoint is among the last k by name."""
    last = files.select(name).distinct().orderBy(F.desc(name)).limit(k).withColumn("keep", F.lit(True))
    return files.join(F.broadcast(last), name, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def to_json(model: Model, **state) -> str:
    """A checkpoint: the networks, and whatever else of plain values."""
    return json.dumps({"networks": {s: [{"weights": w.tolist(), "bias": b.tolist(), "activation": a} for w, b, a in layers] for s, layers in model.items()}, **state})


def from_json(text: str) -> tuple[Model, dict]:
    """The networks and the rest of a checkpoint."""
    state = json.loads(text)
    networks = {s: [(np.array(x["weights"], float), np.array(x["bias"], float), x["activation"]) for x in layers] for s, layers in state.pop("networks").items()}
    return networks, state


def training_table(frames: DataFrame, atoms: DataFrame, grads: DataFrame | None = None, key: str = "sid") -> DataFrame:
    """Training rows (see the module) of frames (key, energy), atoms (key, aid, species, fingerprint, and with forces fx, fy,
    fz) and descriptor gradients of :func:`~.network.gradients`. Structures without atoms are left out."""
    forced = grads is not None
    one = F.struct("aid", "species", "fingerprint", *(["fx", "fy", "fz"] if forced else []))
    lists = atoms.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("a"))
    pick = lambda c: F.transform("a", lambda x: x[c])
    rows = frames.select(key, "energy").join(lists, key)
    columns = [key, "energy", F.size("a").alias("n_atoms"), pick("species").alias("species"), pick("fingerprint").alias("fingerprints")]
    if not forced:
        return rows.select(*columns)
    place = lambda c: F.array_position(pick("aid"), c) - 1
    sparse = grads.groupBy(key).agg(F.collect_list(F.struct("i", "f", "atom", "gx", "gy", "gz")).alias("g"))
    part = lambda c: F.transform(F.coalesce("g", F.array()), lambda x: x[c])
    index = lambda c: F.transform(part(c), lambda v: place(v).cast("int"))
    return rows.join(sparse, key, "left").select(*columns, *[pick(c).alias(c) for c in ("fx", "fy", "fz")], index("i").alias("gi"), part("f").alias("gf"), index("atom").alias("ga"), *[part(c).alias(c) for c in ("gx", "gy", "gz")])


def _through(layers: Layers, x: np.ndarray, tangent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Outputs of a network and their derivative along a tangent of the inputs, with what the way back needs."""
    y, dy, kept = x, tangent, []
    for w, b, a in layers:
        f, first, second = _SMOOTH[a]
        out = f(y @ w + b)
        dz = dy @ w
        slope = first(out)
        kept.append((y, dy, dz, slope, second(out), w))
        y, dy = out, slope * dz
    return y[:, 0], dy[:, 0], kept


def _back(kept: list, by_output: np.ndarray, by_tangent: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients by all parameters, layer by layer, and by the inputs, of sums of outputs and of their tangents."""
    u, v = by_output[:, None], by_tangent[:, None]
    grads = []
    for y, dy, dz, slope, bend, w in reversed(kept):
        z, t = u * slope + v * dz * bend, v * slope
        grads.append(np.concatenate([(y.T @ z + dy.T @ t).ravel(), z.sum(0)]))
        u, v = z @ w.T, t @ w.T
    return grads[::-1], u


def structure_losses(model: Model, row: dict, scaling: float = 1.0, shift: float = 0.0, forces: bool = False) -> tuple[float, float, int, np.ndarray, np.ndarray]:
    """Of one structure: squared error of the energy an atom, squared error of forces and number of components, and both
    gradients by all parameters."""
    names = sorted(model)
    species = np.array(row["species"], object)
    x = np.array([list(v) for v in row["fingerprints"]], float).reshape(len(species), -1)
    groups = {s: np.flatnonzero(species == s) for s in names}
    if sum(map(len, groups.values())) != len(species):
        raise ValueError(f"no network for species {sorted(set(species) - set(names))}")
    n = len(species)
    none = np.zeros_like(x)
    runs = {s: _through(model[s], x[at], none[at]) for s, at in groups.items()}
    error = (sum(r[0].sum() for r in runs.values()) / scaling + shift * n - row["energy"]) / n
    by_energy = np.concatenate([np.concatenate(_back(runs[s][2], np.full(len(at), 2 * error / n / scaling), np.zeros(len(at)))[0]) for s, at in groups.items()])
    if not forces or row.get("fx") is None or any(v is None or v != v for v in row["fx"]):
        return error * error, 0.0, 0, by_energy, np.zeros_like(by_energy)
    slopes = np.zeros_like(x)
    for s, at in groups.items():
        slopes[at] = _back(runs[s][2], np.ones(len(at)), np.zeros(len(at)))[1]
    gi, gf, ga = (np.array(row[c], int) for c in ("gi", "gf", "ga"))
    g = np.stack([np.array(row[c], float) for c in ("gx", "gy", "gz")], axis=1)
    found = np.zeros((n, 3))
    np.add.at(found, ga, -slopes[gi, gf][:, None] * g / scaling)
    off = found - np.stack([np.array(row[c], float) for c in ("fx", "fy", "fz")], axis=1)
    # The error's derivative is that of the energies along a tangent of the features.
    tangent = np.zeros_like(x)
    np.add.at(tangent, (gi, gf), (2 * off[ga] * -g / scaling).sum(1))
    by_force = []
    for s, at in groups.items():
        kept = _through(model[s], x[at], tangent[at])[2]
        by_force.append(np.concatenate(_back(kept, np.zeros(len(at)), np.ones(len(at)))[0]))
    return error * error, float((off * off).sum()), off.size, by_energy, np.concatenate(by_force)


def batch_losses(rows: DataFrame, model: Model, scaling: float = 1.0, shift: float = 0.0, alpha: float = 0.0) -> tuple[float, float, float, np.ndarray]:
    """Of a batch: energy loss, force loss (NaN without forces), their combination and its gradient. Sums are made in tasks;
    a task hands back one row. A row counts ``draws`` times where that column is there."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    forced = alpha > 0

    def run(batches):
        total, by_e, by_f = np.zeros(4), 0.0, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                k = row.get("draws") or 1
                e, f, n, ge, gf = structure_losses(sent.value, row, scaling, shift, forced)
                total += k * np.array([1, e, n, f])
                by_e, by_f = by_e + k * ge, by_f + k * gf
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([by_e.tolist()]), pa.array([by_f.tolist()])], names=["total", "e", "f"])

    parts = rows.mapInArrow(run, "total array<double>, e array<double>, f array<double>").collect()  # a row a task, of a fixed size
    if not parts:
        return math.nan, math.nan, math.nan, np.zeros(len(flatten(model)))
    n, e, m, f = np.sum([p["total"] for p in parts], axis=0)
    energy, force = math.sqrt(e / n), math.sqrt(f / m) if m else math.nan
    grad = (1 - alpha) * np.sum([p["e"] for p in parts], axis=0) / (2 * n * max(energy, 1e-300))
    if forced and m:
        grad = grad + alpha * np.sum([p["f"] for p in parts], axis=0) / (2 * m * max(force, 1e-300))
    return energy, force, combined_loss(energy, force if m else 0.0, alpha), grad


@dataclass
class Settings:
    epochs: int = 10
    batches: int = 1
    alpha: float = 0.0
    scaling: float = 1.0
    shift: float = 0.0
    seed: int = 0
    key: str = "sid"
    policy: str = "uniform"
    force_fraction: float = 1.0
    resample_every: int = 0
    plateau: Plateau | None = None
    start: int = 0
    history: list = field(default_factory=list)


def run_epoch(rows: DataFrame, model: Model, opt: Sgd | Adam, settings: Settings, epoch: int) -> tuple[Model, dict]:
    """One epoch over all batches; with the unweighted means of the batches' losses."""
    x, energies, forces = flatten(model), [], []
    batch = F.pmod(F.xxhash64(F.col(settings.key), F.lit(settings.seed + epoch)), F.lit(settings.batches))
    for b in range(settings.batches):
        e, f, _, grad = batch_losses(rows.where(batch == b) if settings.batches > 1 else rows, restore(model, x), settings.scaling, settings.shift, settings.alpha)
        if math.isnan(e):
            continue
        x = opt.step(x, grad)
        energies.append(e)
        forces.append(f)
    mean = lambda v: float(np.mean(v)) if v else math.nan
    return restore(model, x), {"epoch": epoch, "learning_rate": opt.rate, "train_energy_rmse": mean(energies), "train_force_rmse": mean([f for f in forces if not math.isnan(f)])}


def train(rows: DataFrame, model: Model, opt: Sgd | Adam, settings: Settings, test: DataFrame | None = None, after: Callable[[Model, dict], None] | None = None) -> tuple[Model, list[dict]]:
    """A model trained for ``settings.epochs`` epochs from ``settings.start``, and its history; ``after`` is called with the model
    and the metrics of each epoch, to store checkpoints say.

    Structures are drawn by the policy once an epoch; forces of a sample count, which is drawn anew in its intervals. The test
    loss, or without test rows the training loss, drives the plateau.
    """
    history: list[dict] = list(settings.history)
    n = rows.count()
    forced = rows
    for epoch in range(settings.start, settings.start + settings.epochs):
        if settings.alpha > 0 and settings.force_fraction < 1 and (epoch == settings.start or resamples(epoch, settings.start, settings.resample_every)):
            hit = F.pmod(F.xxhash64(F.col(settings.key), F.lit(7919 * (settings.seed + 1) + epoch)), F.lit(1 << 30)) < int(settings.force_fraction * (1 << 30))
            forced = rows.withColumn("fx", F.when(hit, F.col("fx")))
        drawn = sampler(settings.policy, forced, n, settings.seed + epoch, key=settings.key) if settings.policy != "uniform" else forced
        model, metrics = run_epoch(drawn, model, opt, settings, epoch)
        if test is not None:
            metrics["test_energy_rmse"], metrics["test_force_rmse"], _, _ = batch_losses(test, model, settings.scaling, settings.shift, settings.alpha)
        history.append(metrics)
        if settings.plateau is not None:
            opt.rate = settings.plateau.rate(metrics.get("test_energy_rmse", metrics["train_energy_rmse"]), opt.rate)
        if after is not None:
            after(model, metrics)
    return model, history


def history_frame(spark, history: dict[str, list] | list[dict]) -> DataFrame:
    """(epoch, a column for each metric) of a history, as a dict of lists over epochs or a list of rows; a metric that an epoch
    lacks is NaN."""
    if isinstance(history, dict):
        size = max((len(v) for v in history.values()), default=0)
        history = [{"epoch": k} | {m: v[k] for m, v in history.items() if k < len(v)} for k in range(size)]
    names = [*dict.fromkeys(m for row in history for m in row if m != "epoch")]
    data = [(int(r.get("epoch", k)), *[float("nan") if r.get(m) is None else float(r[m]) for m in names]) for k, r in enumerate(history)]
    return spark.createDataFrame(data, "epoch int" + "".join(f", `{m}` double" for m in names))


def status(runs: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "rmse_test", stop: str = "stopped", wanted: int | None = None) -> DataFrame:
    """(run, epochs, best_epoch, best, state) of epoch rows of several runs: stopped if a row says so, completed if the wanted
    epoch is reached, else running."""
    out = runs.groupBy(run).agg(F.max(epoch).alias("epochs"), F.min_by(epoch, F.struct(value, epoch)).alias("best_epoch"), F.min(value).alias("best"), F.max(F.coalesce(F.col(stop), F.lit(False)) if stop in runs.columns else F.lit(False)).alias("__s"))
    done = F.col("epochs") >= wanted if wanted is not None else F.lit(False)
    return out.withColumn("state", F.when(F.col("__s"), "stopped").when(done, "completed").otherwise("running")).drop("__s")


def best_epochs(epochs: DataFrame, n: int, value: str = "rmse_test", epoch: str = "epoch", run: str = "run") -> DataFrame:
    """The n epochs with the lowest value; among equals earlier ones first, and then those of smaller runs, where ``epochs`` has
    a column for them."""
    order = [value, epoch, *([run] if run in epochs.columns else [])]
    return epochs.where(F.col(value).isNotNull() & ~F.isnan(value)).orderBy(*order).limit(n)


def training_stats(epochs: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "rmse") -> DataFrame:
    """(run, n, final, best, best_epoch) like :func:`~.trajectory.epoch_summary`, but a NaN in a run makes its smallest value
    NaN, at the first epoch that has one, and its last value may be NaN."""
    bad = F.isnan(value)
    w = epochs.groupBy(run).agg(F.count("*").alias("n"), F.max_by(value, epoch).alias("final"), F.max(bad.cast("int")).alias("__bad"), F.min(F.when(~bad, F.col(value))).alias("__min"), F.min(F.when(bad, F.col(epoch))).alias("__at"), F.min_by(epoch, F.struct(value, epoch)).alias("__arg"))
    return w.select(run, "n", "final", F.when(F.col("__bad") == 1, F.lit(float("nan"))).otherwise(F.col("__min")).alias("best"), F.when(F.col("__bad") == 1, F.col("__at")).otherwise(F.col("__arg")).alias("best_epoch"))


def running_best(epochs: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "rmse") -> DataFrame:
    """With ``best``: the smallest value of a run so far."""
    return epochs.withColumn("best", F.min(value).over(Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)))
