"""Atomic networks on descriptors, and forces from descriptor gradients.

A model is, for each species, a list of layers (weights, bias, activation): energy = sum over atoms of its network's
output. Gradients of descriptors are long tables (keys, i, f, atom, gx, gy, gz), so forces are a join and a sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types

from ..functions.scalars import chebyshev, chebyshev_derivative, cosine_cutoff, cosine_cutoff_derivative, rescale
from ._whole import in_structures, portions
from .spatial import SMALL, _spin, descriptors, edges

Layers = list[tuple[np.ndarray, np.ndarray, str]]
_ACTIVATIONS = {"linear": (lambda x: x, lambda y: np.ones_like(y)), "tanh": (np.tanh, lambda y: 1 - y * y), "sigmoid": (lambda x: 1 / (1 + np.exp(-x)), lambda y: y * (1 - y))}


def forward(layers: Layers, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of a network with one output, and their gradients by the inputs."""
    outs = [x]
    for w, b, a in layers:
        outs.append(_ACTIVATIONS[a][0](outs[-1] @ w + b))
    back = np.ones((len(x), 1))
    for (w, _, a), y in zip(reversed(layers), reversed(outs[1:]), strict=True):
        back = (back * _ACTIVATIONS[a][1](y)) @ w.T
    return outs[-1][:, 0], back


def atom_energies(atoms: DataFrame, model: dict[str, Layers], fingerprint: str = "fingerprint") -> DataFrame:
    """``atoms`` with e_atom and de_dg, in Arrow batches; a species without a network raises."""
    sent = atoms.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            e, g = np.zeros(len(pdf)), [None] * len(pdf)
            for s in pdf["species"].unique():
                at = np.flatnonzero((pdf["species"] == s).to_numpy())
                out, grad = forward(sent.value[s], np.array(pdf[fingerprint].iloc[at].tolist()))
                e[at] = out
                for k, row in zip(at, grad, strict=True):
                    g[k] = row
            yield pdf.assign(e_atom=e, de_dg=g)

    schema = types.StructType(list(atoms.schema.fields))
    return atoms.mapInPandas(run, schema.add("e_atom", "double").add("de_dg", types.ArrayType(types.DoubleType())))


def energies(atoms: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, energy, n_atoms) from atoms with e_atom."""
    return atoms.groupBy(*keys).agg(F.sum("e_atom").alias("energy"), F.count("*").alias("n_atoms"))


def _pairs(found: DataFrame, rad_cutoff: float, rad_order: int, ang_order: int, spins: dict[str, int], min_cutoff: float) -> tuple[DataFrame, list]:
    """Edges within the radial cutoff, and (feature, derivative by the distance) of the radial features."""
    n_r, n_a = rad_order + 1, ang_order + 1
    near = found.where((F.col("d") > min_cutoff) & (F.col("d") <= rad_cutoff))
    x = rescale(F.col("d"), min_cutoff, rad_cutoff)
    parts = []
    for n in range(n_r):
        slope = chebyshev_derivative(n, x) * (2 / (rad_cutoff - min_cutoff)) * cosine_cutoff(F.col("d"), rad_cutoff) + chebyshev(n, x) * cosine_cutoff_derivative(F.col("d"), rad_cutoff)
        parts.append((n, slope))
        if len(spins) > 1:
            parts.append((n_r + n_a + n, slope * _spin("species_j", spins)))
    return near, parts


def _triplets(found: DataFrame, rad_order: int, ang_cutoff: float, ang_order: int, spins: dict[str, int], min_cutoff: float, keys: tuple[str, ...]) -> tuple[DataFrame, list]:
    """Pairs of edges of an atom as unit vectors a, b, distances d1, d2 and cosine c; and (feature, derivatives by the cosine and by
    both distances) of the angular features."""
    n_r, n_a = rad_order + 1, ang_order + 1
    image = [c for c in ("ox", "oy", "oz") if c in found.columns]
    ranked = found.where((F.col("d") > min_cutoff) & (F.col("d") <= ang_cutoff)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "i").orderBy("j", *image)))
    a = ranked.select(*keys, "i", "j", F.col("species_j").alias("sj"), F.col("rank").alias("ra"), F.col("d").alias("d1"), *[(F.col(c) / F.col("d")).alias(f"a{c[1]}") for c in ("dx", "dy", "dz")])
    b = ranked.select(*keys, "i", F.col("j").alias("k"), F.col("species_j").alias("sk"), F.col("rank").alias("rb"), F.col("d").alias("d2"), *[(F.col(c) / F.col("d")).alias(f"b{c[1]}") for c in ("dx", "dy", "dz")])
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")))
    tri = a.join(b, [*keys, "i"]).where("ra < rb").withColumn("c", cos)
    f1, f2 = cosine_cutoff(F.col("d1"), ang_cutoff), cosine_cutoff(F.col("d2"), ang_cutoff)
    parts = []
    for n in range(n_a):
        t, dt = chebyshev(n, F.col("c")), chebyshev_derivative(n, F.col("c"))
        turn, one, other = dt * f1 * f2, t * cosine_cutoff_derivative(F.col("d1"), ang_cutoff) * f2, t * f1 * cosine_cutoff_derivative(F.col("d2"), ang_cutoff)
        parts.append((n_r + n, turn, one, other))
        if len(spins) > 1:
            w = _spin("sj", spins) * _spin("sk", spins)
            parts.append((2 * n_r + n_a + n, turn * w, one * w, other * w))
    return tri, parts


def _pulls() -> tuple[list, list]:
    """Derivatives by the places of j and k from the columns p (by the cosine), q and r (by the distances)."""
    by_j = [F.col("p") * (F.col(f"b{k}") - F.col("c") * F.col(f"a{k}")) / F.col("d1") + F.col("q") * F.col(f"a{k}") for k in "xyz"]
    by_k = [F.col("p") * (F.col(f"a{k}") - F.col("c") * F.col(f"b{k}")) / F.col("d2") + F.col("r") * F.col(f"b{k}") for k in "xyz"]
    return by_j, by_k


def gradients(found: DataFrame, rad_cutoff: float, rad_order: int, ang_cutoff: float, ang_order: int, spins: dict[str, int], min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, i, f, atom, gx, gy, gz): derivatives of atom i's feature f by the place of an atom.

    Features are in the order of :func:`atomspan.operators.spatial.descriptors`. Images of an atom count as the atom. The
    table is long; where only forces are wanted, :func:`contracted_forces` makes none.
    """
    near, parts = _pairs(found, rad_cutoff, rad_order, ang_order, spins, min_cutoff)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), s.alias("s")) for f, s in parts])).alias("e")
    pair = near.select(*keys, "i", "j", *[(F.col(c) / F.col("d")).alias(c) for c in ("dx", "dy", "dz")], each).select(*keys, "i", "j", "dx", "dy", "dz", "e.*")
    flow = lambda df, atom, vec: df.select(*keys, "i", "f", F.col(atom).alias("atom"), *[v.alias(g) for v, g in zip(vec, ("gx", "gy", "gz"), strict=True)])
    u = [F.col("s") * F.col(c) for c in ("dx", "dy", "dz")]
    out = flow(pair, "j", u).unionByName(flow(pair, "i", [-v for v in u]))
    tri, parts = _triplets(found, rad_order, ang_cutoff, ang_order, spins, min_cutoff, keys)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), p.alias("p"), q.alias("q"), r.alias("r")) for f, p, q, r in parts])).alias("e")
    tri = tri.select("*", each).select("*", "e.*")
    by_j, by_k = _pulls()
    out = out.unionByName(flow(tri, "j", by_j)).unionByName(flow(tri, "k", by_k)).unionByName(flow(tri, "i", [-p - q for p, q in zip(by_j, by_k, strict=True)]))
    return out.groupBy(*keys, "i", "f", "atom").agg(*[F.sum(g).alias(g) for g in ("gx", "gy", "gz")])


def contracted_forces(atoms: DataFrame, found: DataFrame, rad_cutoff: float, rad_order: int, ang_cutoff: float, ang_order: int, spins: dict[str, int], min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, aid, fx, fy, fz) as :func:`forces` of :func:`gradients`, without a row for each feature: an atom's de_dg meets its edges
    and pairs of edges, where all its features' derivatives are summed, and only forces are shuffled."""
    slopes = atoms.select(*keys, F.col("aid").alias("i"), "de_dg")
    total = lambda values: sum((F.get("de_dg", F.lit(f)) * v for f, v in values), F.lit(0.0))
    near, parts = _pairs(found, rad_cutoff, rad_order, ang_order, spins, min_cutoff)
    pair = near.join(slopes, [*keys, "i"]).withColumn("s", total(parts) / F.col("d"))
    tri, parts = _triplets(found, rad_order, ang_cutoff, ang_order, spins, min_cutoff, keys)
    tri = tri.join(slopes, [*keys, "i"]).withColumns({c: total([(x[0], x[k]) for x in parts]) for k, c in ((1, "p"), (2, "q"), (3, "r"))})
    u = [F.col("s") * F.col(c) for c in ("dx", "dy", "dz")]
    by_j, by_k = _pulls()
    pull = lambda atom, vec, sign: F.struct(F.col(atom).alias("aid"), *[(sign * v).alias(c) for v, c in zip(vec, ("fx", "fy", "fz"), strict=True)])
    two = pair.select(*keys, F.explode(F.array(pull("j", u, -1.0), pull("i", u, 1.0))).alias("e")).select(*keys, "e.*")
    three = tri.select(*keys, F.explode(F.array(pull("j", by_j, -1.0), pull("k", by_k, -1.0), pull("i", [p + q for p, q in zip(by_j, by_k, strict=True)], 1.0))).alias("e")).select(*keys, "e.*")
    sums = two.unionByName(three).groupBy(*keys, "aid").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "fz")])
    return atoms.select(*keys, "aid").join(sums, [*keys, "aid"], "left").fillna(0.0, ["fx", "fy", "fz"])


def forces(atoms: DataFrame, grads: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, aid, fx, fy, fz): minus the sum of dE/dG dG/dr; ``atoms`` has de_dg. Atoms that nothing depends on have 0."""
    slopes = atoms.select(*keys, F.col("aid").alias("i"), F.posexplode("de_dg").alias("f", "s"))
    sums = grads.join(slopes, [*keys, "i", "f"]).groupBy(*keys, F.col("atom").alias("aid")).agg(*[(-F.sum(F.col("s") * F.col(g))).alias(o) for g, o in (("gx", "fx"), ("gy", "fy"), ("gz", "fz"))])
    return atoms.select(*keys, "aid").join(sums, [*keys, "aid"], "left").fillna(0.0, ["fx", "fy", "fz"])


#: Triples of atoms that a task of :func:`structure_forces` looks at a time, about.
TRIPLES = 1 << 19


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _basis(order: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev polynomials up to an order and their derivatives, as :mod:`~..functions.scalars` has them."""
    n, held = np.arange(order + 1)[:, None], np.clip(x, -1, 1)
    turn = n * np.arccos(held)
    return np.cos(turn), n * np.sin(turn) / np.sqrt(np.maximum(1 - held * held, 1e-10))


def _cutoff(d: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cosine cutoff and its derivative."""
    turn = math.pi * d / radius
    return np.where(d < radius, 0.5 * (np.cos(turn) + 1), 0.0), np.where(d < radius, -0.5 * math.pi / radius * np.sin(turn), 0.0)


def dense_forces(starts: np.ndarray, aid: np.ndarray, species: np.ndarray, place: np.ndarray, model: dict[str, Layers], spins: dict[str, int], settings: tuple[float, int, float, int], min_cutoff: float = 0.0) -> np.ndarray:
    """Forces (atoms, 3) of structures one after the other by all pairs and triples of their atoms: descriptors, the networks'
    slopes and the contraction of :func:`contracted_forces`, as arrays."""
    rad_cutoff, rad_order, ang_cutoff, ang_order = settings
    size, total = np.repeat(np.diff(starts), np.diff(starts)), len(aid)
    i = np.repeat(np.arange(total), size)
    j = np.repeat(np.repeat(starts[:-1], np.diff(starts)), size) + _runs(size)
    u = place[j] - place[i]
    d = np.sqrt(u[:, 0] * u[:, 0] + u[:, 1] * u[:, 1] + u[:, 2] * u[:, 2])
    near = (aid[i] != aid[j]) & (d > min_cutoff) & (d <= max(rad_cutoff, ang_cutoff))
    i, j, d, u = i[near], j[near], d[near], u[near] / d[near][:, None]
    if len(spins) > 1:
        unknown = sorted({str(s) for s in set(species[j]) - set(spins)})
        if unknown:
            raise ValueError(f"no typespin for species {unknown}")
        spin = np.array([float(spins.get(s, 0)) for s in species])
        weights = lambda *ends: [None, np.prod([spin[e] for e in ends], axis=0)]
    else:
        weights = lambda *ends: [None]
    by = lambda at, rows: np.stack([np.bincount(at, r, total) for r in rows], 1).astype(float)  # noqa: E731  (without rows it counts)

    def summed(at, values, weight):
        return [by(at, values if w is None else values * w) for w in weight]

    r = d <= rad_cutoff
    ri, rj, rd, ru = i[r], j[r], d[r], u[r]
    t, dt = _basis(rad_order, (2 * rd - min_cutoff - rad_cutoff) / (rad_cutoff - min_cutoff))
    f, df = _cutoff(rd, rad_cutoff)
    radial, slope, rw = summed(ri, t * f, weights(rj)), dt * (2 / (rad_cutoff - min_cutoff)) * f + t * df, weights(rj)

    a = d <= ang_cutoff
    ai, aj, ad, au = i[a], j[a], d[a], u[a]
    of = np.bincount(ai, minlength=total)
    later = np.repeat(of, of) - _runs(of) - 1  # neighbours of the atom that come after this one
    p = np.repeat(np.arange(len(ai)), later)
    q = p + 1 + _runs(later)
    c = np.clip((au[p] * au[q]).sum(1), -1, 1)
    ct, cdt = _basis(ang_order, c)
    (f1, g1), (f2, g2) = _cutoff(ad[p], ang_cutoff), _cutoff(ad[q], ang_cutoff)
    aw = weights(aj[p], aj[q])
    angular = summed(ai[p], ct * f1 * f2, aw)

    features = np.concatenate([x for pair in zip(radial, angular, strict=True) for x in pair], 1)
    pull, n_r, n_a = np.zeros_like(features), rad_order + 1, ang_order + 1
    for s in set(species):
        at = np.flatnonzero(species == s)
        pull[at] = forward(model[s], features[at])[1]

    one, (turn, by_p, by_q) = np.zeros(len(ri)), np.zeros((3, len(p)))
    for k, (w, v) in enumerate(zip(rw, aw, strict=True)):
        own = pull[:, k * (n_r + n_a) : (k + 1) * (n_r + n_a)]
        sums = (own[ri, :n_r].T * slope).sum(0)
        one += sums if w is None else sums * w
        g = own[ai[p], n_r:].T if v is None else own[ai[p], n_r:].T * v
        plain = (g * ct).sum(0)
        turn += (g * cdt).sum(0) * f1 * f2
        by_p += plain * g1 * f2
        by_q += plain * f1 * g2
    two, ap, aq = one[:, None] * ru, au[p], au[q]
    on_j = (turn / ad[p])[:, None] * (aq - c[:, None] * ap) + by_p[:, None] * ap
    on_k = (turn / ad[q])[:, None] * (ap - c[:, None] * aq) + by_q[:, None] * aq
    force = by(ri, two.T) - by(rj, two.T) + by(ai[p], (on_j + on_k).T)
    return force - by(aj[p], on_j.T) - by(aj[q], on_k.T)


def structure_forces(atoms: DataFrame, model: dict[str, Layers], spins: dict[str, int], settings: tuple[float, int, float, int], min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, aid, fx, fy, fz) from places, without periodic boundaries: as :func:`contracted_forces` of :func:`~.spatial.edges`
    and :func:`~.spatial.descriptors`.

    Atoms are shuffled once, by structure. Structures of up to SMALL atoms are worked on whole, many at a time, so their edges, of
    which there are many more than atoms, never leave a task; larger ones, if there are any, go by joins of edges. Atoms that
    come dealt by ``keys`` are not dealt again. Atoms of one number are no neighbours.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = atoms.select(*keys, "aid", "species", "x", "y", "z")
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SMALL)
    small = rows.withColumn("__n", n).where(F.col("__n") <= SMALL).drop("__n")
    schema = types.StructType([*rows.select(*keys, "aid").schema.fields, *[types.StructField(c, types.DoubleType()) for c in ("fx", "fy", "fz")]])
    sent, m = atoms.sparkSession.sparkContext.broadcast(model), len(keys)

    def run(batch, starts):
        for a, b in portions(np.diff(starts).astype(float) ** 3, TRIPLES):
            own = batch.slice(starts[a], starts[b] - starts[a])
            column = lambda k: own.column(m + k).to_numpy(zero_copy_only=False)
            place = np.stack([column(k).astype(float) for k in (2, 3, 4)], 1)
            force = dense_forces(starts[a : b + 1] - starts[a], column(0), column(1), place, sent.value, spins, settings, min_cutoff)
            yield pa.RecordBatch.from_arrays([*own.columns[: m + 1], *[pa.array(np.ascontiguousarray(f)) for f in force.T]], names=schema.names)

    out = in_structures(small, keys, ("aid", "species", "x", "y", "z"), run, schema)
    if large.isEmpty():
        return out
    some = rows.withColumn("__n", n).where(F.col("__n") > SMALL).drop("__n")
    found = edges(some, max(settings[0], settings[2]), keys)
    full = atom_energies(descriptors(some, found, *settings, spins, min_cutoff, keys), model)
    return out.unionByName(contracted_forces(full, found, *settings, spins, min_cutoff, keys))


def predict(atoms: DataFrame, found: DataFrame, model: dict[str, Layers], spins: dict[str, int], settings: tuple[float, int, float, int], references: dict[str, float] | None = None, scaling: float = 1.0, shift: float = 0.0, min_cutoff: float = 0.0, keys: tuple[str, ...] = ("sid",)) -> tuple[DataFrame, DataFrame]:
    """(structures, atoms) of places and their edges: energies (total and cohesive), forces and energies of atoms, which add up to
    the total. Networks give energies times ``scaling`` less a shift; reference energies are by species, 0 if not given."""
    from .training import denormalise_atom

    rows = atom_energies(descriptors(atoms, found, *settings, spins, min_cutoff, keys), model)
    known = F.lit(0.0)
    for s, e in (references or {}).items():
        known = F.when(F.col("species") == s, F.lit(float(e))).otherwise(known)
    own = rows.withColumn("__c", denormalise_atom(F.col("e_atom"), 0.0, scaling, shift)).withColumn("__e", F.col("__c") + known)
    structures = own.groupBy(*keys).agg(F.sum("__e").alias("energy"), F.sum("__c").alias("cohesive"), F.count("*").alias("n_atoms"))
    pulled = contracted_forces(rows, found, *settings, spins, min_cutoff, keys)
    pulled = pulled.withColumns({c: F.col(c) / scaling for c in ("fx", "fy", "fz")})
    return structures, own.select(*keys, "aid", "species", F.col("__e").alias("e_atom")).join(pulled, [*keys, "aid"])
