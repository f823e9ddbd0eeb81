"""Queries of structures as sets, cells, surroundings, training and texts, registered beside those of :mod:`.registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diversity, energies, ensemble, generators, geometry, network, spatial, structures as sets, training
from . import chain
from .registry import _ATOMS, _F2, _FC, _KEYS, _PAIRS, _POINTS, _SPIN, _STRUCTURES, _TRI, _X, CUTOFF, REFERENCE, SPINS, _r, atoms, celled, edges, keyed, points, predictions, query, rounded, structures, table, vectors

_CELLED = "CAST(x AS DOUBLE) / 50 AS u, y / 10 AS v, z / 10 AS w"
_WRAP = "({0} - floor({0}) - CASE WHEN {0} - floor({0}) >= 1 - 2.220446049250313e-11 THEN 1 ELSE 0 END)"


def _skewed(spark, d):
    """Atoms in cells that differ by structure."""
    grown = F.lit(50.0) + F.col("sid") % 3
    rows = [[grown, F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(10.0), F.lit(0.0)], [F.lit(0.5), F.lit(0.7), F.lit(10.0)]]
    return atoms(spark, d).withColumn("cell", F.array(*[F.array(*r) for r in rows]))


# Cells and places


@query(f"""WITH a AS ({_ATOMS}), w AS (SELECT sid, aid, x * 1.1 - 55 * floor(x / 50) AS x, y - 10 * floor(y / 10) AS y0, z - 10 * floor(z / 10) AS z FROM a),
w2 AS (SELECT sid, aid, x, CASE WHEN y0 >= 10 - 1e-9 THEN y0 - 10 ELSE y0 END AS y, z FROM w),
o AS (SELECT i.v AS ox, j.v AS oy, k.v AS oz FROM (SELECT unnest(range(-1, 2)) AS v) i, (SELECT unnest(range(-1, 2)) AS v) j, (SELECT unnest(range(-1, 2)) AS v) k)
SELECT sid, i, count(*) AS n, {_r('sum(d)')} AS total FROM (SELECT p.sid, p.aid AS i, sqrt(pow(q.x + 55*ox - p.x, 2) + pow(q.y + 10*oy - p.y, 2) + pow(q.z + 10*oz - p.z, 2)) AS d
FROM w2 p JOIN w2 q ON p.sid = q.sid JOIN o ON p.aid <> q.aid OR ox <> 0 OR oy <> 0 OR oz <> 0) WHERE d <= 6.37 GROUP BY sid, i""")
def strained_neighbours(spark, d):
    """Neighbours under the boundaries of a strained cell."""
    strained = generators.uniaxial(celled(spark, d), "x", 1.1, 1.2, 2).where("step = 0")
    return rounded(spatial.periodic_edges(strained, 6.37).groupBy("sid", "i").agg(F.count("*").alias("n"), F.sum("d").alias("total")))


@query(f"WITH a AS ({_ATOMS}) SELECT sid, aid, step, {_r('x * s')} AS x, {_r('50 * s')} AS a, {_r('1000 * s * s * s * 5')} AS volume FROM a, (SELECT CAST(k AS INTEGER) AS step, CAST(0.9 + 0.1 * k AS DOUBLE) AS s FROM (SELECT unnest(range(3)) AS k))")
def scaled_cells(spark, d):
    made = generators.isotropic(celled(spark, d), 0.9, 1.1, 3)
    return rounded(made.select("sid", "aid", "step", "x", F.col("cell")[0][0].alias("a"), geometry.volume_of().alias("volume")))


@query(f"WITH a AS ({_ATOMS}) SELECT DISTINCT sid, {_r('(50.0 + sid % 3)')} AS a, {_r('sqrt(101.0)')} AS b, {_r('sqrt(0.25 + 0.49 + 100)')} AS c, {_r('degrees(acos((0.5 + 7) / (sqrt(101.0) * sqrt(100.74))))')} AS alpha, {_r('degrees(acos(1 / sqrt(101.0)))')} AS gamma, {_r('(50.0 + sid % 3) * 10')} AS ab, {_r('(50.0 + sid % 3) * 100')} AS volume FROM a")
def lattice(spark, d):
    rows = geometry.lattice(_skewed(spark, d).select("sid", "cell").distinct())
    return rounded(rows.select("sid", "a", "b", "c", "alpha", "gamma", "ab", geometry.volume_of().alias("volume")))


@query(f"WITH a AS ({_ATOMS}), f AS (SELECT sid, aid, z / 10 AS w, (y - 0.7 * z / 10) / 10 AS v, x, 50.0 + sid % 3 AS l FROM a), g AS (SELECT sid, aid, (x - v - 0.5 * w) / l AS u, v, w FROM f) SELECT sid, aid, {_r('u', 6)} AS u, {_r('v', 6)} AS v, {_r('w', 6)} AS w FROM g")
def fractional(spark, d):
    return rounded(geometry.fractional(_skewed(spark, d)).select("sid", "aid", "u", "v", "w"), 6)


@query(f"WITH a AS (SELECT sid, aid, {_CELLED} FROM ({_ATOMS})) SELECT sid, count(*) AS n, {_r('sum(' + _WRAP.format('u') + ')', 6)} AS u, {_r('sum(' + _WRAP.format('(v - u)') + ')', 6)} AS v, {_r('50 * sum(u * 0 + 1)')} AS length FROM a GROUP BY sid")
def transformed_cell(spark, d):
    """The basis a + b, b, c: as many atoms, whose second coordinate loses the first."""
    new = geometry.fractional(geometry.transform_cell(celled(spark, d), [[1, 1, 0], [0, 1, 0], [0, 0, 1]]))
    inside = new.withColumns({c: S.wrap(F.round(F.col(c), 9)) for c in "uv"})
    return rounded(rounded(inside.groupBy("sid").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"), F.sum(F.col("cell")[0][0]).alias("length")), 6, "u", "v"), 4, "length")


@query(f"WITH a AS ({_ATOMS}) SELECT sid, 4 * count(*) AS n, {_r('4 * sum(z)', 3)} AS z, {_r('100.0')} AS a, {_r('20.0')} AS b FROM a GROUP BY sid")
def repeated_cell(spark, d):
    """Twice along two vectors, by a matrix."""
    new = geometry.transform_cell(celled(spark, d), [[2, 0, 0], [0, 2, 0], [0, 0, 1]])
    return rounded(new.groupBy("sid").agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("z"), F.max(F.col("cell")[0][0]).alias("a"), F.max(F.col("cell")[1][1]).alias("b")), 4)


@query(f"WITH a AS ({_ATOMS}), m AS (SELECT sid, avg(x) AS mx, avg(y) AS my, max(x) - min(x) + 5 AS lx, max(y) - min(y) + 5 AS ly FROM a GROUP BY sid) SELECT a.sid, aid, {_r('x - mx + lx / 2')} AS x, {_r('y - my + ly / 2')} AS y, {_r('lx')} AS a FROM a JOIN m ON a.sid = m.sid")
def boxed(spark, d):
    return rounded(geometry.add_vacuum(atoms(spark, d), 5.0).select("sid", "aid", "x", "y", F.col("cell")[0][0].alias("a")))


@query(f"WITH a AS ({_ATOMS}), m AS (SELECT sid, avg(x) AS mx, avg(z) AS mz FROM a GROUP BY sid) SELECT a.sid, aid, {_r('x - mx + 25')} AS x, {_r('z - mz + 5')} AS z FROM a JOIN m ON a.sid = m.sid")
def centred_in_box(spark, d):
    return rounded(generators.translate(celled(spark, d), "box").select("sid", "aid", "x", "z"))


@query(f"WITH a AS ({_ATOMS}) SELECT p.sid, CAST(k AS INTEGER) AS ox, {_r('sqrt(pow(q.x - p.x + 50 * k, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2))')} AS d FROM a p JOIN a q ON p.sid = q.sid AND p.aid = 1 AND q.aid = 2, (SELECT unnest(range(-3, 4)) AS k) WHERE sqrt(pow(q.x - p.x + 50 * k, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)) <= 60")
def image_distances(spark, d):
    found = geometry.image_distances(celled(spark, d), 1, 2, 60.0, pbc=(True, False, False))
    return rounded(found.select("sid", F.col("ox").cast("int").alias("ox"), "d"))


# Surroundings


@query(f"WITH {_PAIRS} SELECT sid, i, count(*) AS n, {_r('min(d)')} AS nearest, {_r('sum(dx + dy + dz)')} AS along FROM e GROUP BY sid, i")
def neighbour_lists(spark, d):
    lists = geometry.neighbour_lists(edges(spark, d))
    along = F.aggregate("neighbours", F.lit(0.0), lambda s, e: s + e["dx"] + e["dy"] + e["dz"])
    return rounded(lists.select("sid", "i", "n", F.col("neighbours")[0]["d"].alias("nearest"), along.alias("along")))


@query(f"WITH {_PAIRS}, g AS (SELECT sid, aid, min(x) AS x FROM a GROUP BY sid, aid) SELECT g.sid, g.aid AS i, CAST(count(e.j) AS INTEGER) AS n, {_r('coalesce(sum(g.x + e.dx), 0)')} AS x FROM g LEFT JOIN e ON g.sid = e.sid AND g.aid = e.i GROUP BY g.sid, g.aid")
def environments(spark, d):
    # The stand-in has atoms of one number.
    own = atoms(spark, d).groupBy("sid", "aid").agg(*[F.min(c).alias(c) for c in ("species", "x", "y", "z")])
    found = geometry.environments(own, edges(spark, d))
    return rounded(found.select("sid", "i", F.size("neighbours").alias("n"), F.aggregate("neighbours", F.lit(0.0), lambda s, e: s + e["x"]).alias("x")))


@query(f"WITH {_PAIRS}, c AS (SELECT sid, x, 0 AS k FROM a WHERE aid = 1 UNION ALL SELECT e.sid, a.x + e.dx, 1 FROM e JOIN a ON a.sid = e.sid AND a.aid = 1 WHERE e.i = 1 AND d <= 10) SELECT sid, CAST(count(*) AS BIGINT) AS n, {_r('sum(x)')} AS x FROM c GROUP BY sid")
def neighbour_cluster(spark, d):
    cut = geometry.neighbour_cluster(atoms(spark, d), edges(spark, d), 1, 10.0)
    return rounded(cut.groupBy("sid").agg(F.count("*").alias("n"), F.sum("x").alias("x")))


@query(f"WITH {_PAIRS}, g AS (SELECT DISTINCT sid, aid FROM a), n AS (SELECT g.sid, g.aid AS i, count(e.j) AS n FROM g LEFT JOIN e ON g.sid = e.sid AND g.aid = e.i GROUP BY g.sid, g.aid) SELECT sid, i, CAST(coalesce(sum(n) OVER (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM n")
def csr(spark, d):
    return sets.csr(edges(spark, d), atoms(spark, d).select("sid", "aid").distinct())


@query(f"WITH {_PAIRS}, c AS (SELECT sid % 50 AS run, sid, count(*) FILTER (species = 'A') AS nc, count(*) FILTER (species = 'N') AS nn FROM a GROUP BY sid), h AS (SELECT sid % 50 AS run, sid, CAST(floor(d / 2) AS BIGINT) AS bin, count(*) AS n FROM e WHERE si = 'A' AND sj = 'N' GROUP BY ALL), t AS (SELECT h.run, bin, sum(h.n * 1.0 / nullif(nc, 0)) AS n FROM h JOIN c ON h.sid = c.sid GROUP BY h.run, bin), g AS (SELECT run, count(*) AS frames, arg_max(nn, sid) / 5000.0 AS density FROM c GROUP BY run) SELECT t.run AS run, bin, {_r('n / frames / (CASE WHEN density = 0 THEN NULL ELSE density END * 4 / 3 * pi() * 8 * (pow(bin + 1, 3) - pow(bin, 3)))', 6)} AS g FROM t JOIN g ON t.run = g.run")
def rdf_frames(spark, d):
    """Of runs whose frames are structures, from one species to another."""
    framed = lambda df: df.withColumns({"run": F.col("sid") % 50, "frame": F.col("sid")})
    got = spatial.rdf_frames(framed(edges(spark, d)), framed(celled(spark, d)), 2.0, ("run", "frame"), "A", "N")
    return rounded(got.select("run", "bin", "g"), 6)


_DESCRIPTOR = [("r", "r", f"sum(cos({n} * acos({_X})) * ({_FC}))") for n in range(4)] + [("t", "a", f"sum(cos({n} * acos(c)) * {_F2})") for n in range(3)]
_DESCRIPTOR += [("r", "rw", f"sum(cos({n} * acos({_X})) * ({_FC}) * ({_SPIN.format('sj')}))") for n in range(4)] + [("t", "aw", f"sum(cos({n} * acos(c)) * {_F2} * ({_SPIN.format('sj')}) * ({_SPIN.format('sk')}))") for n in range(3)]
_PARTS = " UNION ALL ".join(f"SELECT sid, i, {k} AS f, {e} AS v FROM {'e WHERE d > 0 AND d <= 12' if t == 'r' else 't'} GROUP BY sid, i" for k, (t, _, e) in enumerate(_DESCRIPTOR))


@query(f"WITH {_PAIRS}, {_TRI}, p AS ({_PARTS}), g AS (SELECT DISTINCT sid, aid FROM a) SELECT g.sid, g.aid, CAST(k.f AS INTEGER) AS f, {_r('coalesce(p.v, 0)', 5)} AS v FROM g CROSS JOIN (SELECT unnest(range(14)) AS f) k LEFT JOIN p ON p.sid = g.sid AND p.i = g.aid AND p.f = k.f")
def descriptor_table(spark, d):
    """Every component of every atom's descriptor."""
    a = atoms(spark, d)
    full = spatial.descriptors(a.dropDuplicates(["sid", "aid"]), spatial.edges(a, CUTOFF), 12.0, 3, 8.0, 2, SPINS)
    return rounded(full.select("sid", "aid", F.posexplode("fingerprint").alias("f", "v")), 5)


# Sets and joins


@query(f"WITH p AS ({_POINTS}) SELECT pid, frame, {_r('x')} AS x FROM p WHERE frame = (SELECT max(frame) FROM p q WHERE q.pid = p.pid)")
def last_frame(spark, d):
    return rounded(sets.frame_at(points(spark, d), -1, ("pid",)))


@query(f"WITH p AS ({_POINTS}) SELECT pid, frame, {_r('x')} AS x FROM p WHERE frame >= 3 AND frame <= 40 AND (frame - 3) % 5 = 0")
def strided_frames(spark, d):
    return rounded(sets.stride(points(spark, d), 3, 40, 5))


@query(f"WITH p AS ({_POINTS}), n AS (SELECT pid, max(frame) AS hi FROM p GROUP BY pid), f AS (SELECT pid, frame, x FROM p UNION ALL SELECT p.pid, CAST(p.frame - 1 + n.hi + 1 AS INTEGER), p.x FROM p JOIN n ON p.pid = n.pid WHERE p.frame <= 3) SELECT pid, frame, {_r('x')} AS x FROM f")
def appended_frames(spark, d):
    p = points(spark, d)
    return rounded(sets.append_frames(p, p.where("frame <= 3"), ("pid",)))


@query(f"WITH p AS ({_POINTS}) SELECT pid, frame, {_r('CASE WHEN frame = max(frame) OVER (PARTITION BY pid) THEN -1 ELSE x END')} AS energy FROM p")
def amended_energy(spark, d):
    return rounded(sets.amend_energy(points(spark, d).withColumnRenamed("x", "energy"), -1.0, ("pid",)).select("pid", "frame", "energy"))


@query(f"WITH a AS ({_ATOMS}), s AS (SELECT count(*) AS n FROM orders) SELECT (SELECT n FROM s) AS n_structures, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_with_forces, count(*) AS n_atoms, {_r('count(*) * 1.0 / (SELECT n FROM s)', 6)} AS mean_atoms, array_to_string(list_sort(list(DISTINCT species)), ',') AS species FROM a")
def dataset_statistics(spark, d):
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_orderstatus") == "F").alias("has_forces"))
    out = sets.dataset_statistics(frames, atoms(spark, d)).withColumn("species", F.array_join("species", ","))
    return rounded(out.select("n_structures", "n_with_forces", "n_atoms", "mean_atoms", "species"), 6)


@query(f"WITH a AS ({_ATOMS}) SELECT sid, species, string_agg(CAST(aid AS VARCHAR), ',' ORDER BY aid) AS aids FROM a GROUP BY sid, species")
def indices_by_type(spark, d):
    found = sets.indices_by_type(atoms(spark, d))
    return found.select("sid", "species", F.array_join(F.transform("aids", lambda x: x.cast("string")), ",").alias("aids"))


@query("SELECT o_orderkey AS sid, coalesce(min(CASE WHEN l_linenumber <= 5 THEN 1 ELSE 0 END) = 1, false) AS has_forces FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def with_forces(spark, d):
    forced = atoms(spark, d).withColumns({c: F.when(F.col("aid") <= 5, 0.0) for c in ("fx", "fy", "fz")})
    return sets.with_forces(structures(spark, d), forced).select("sid", "has_forces")


@query("SELECT o_orderkey AS sid, o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AS use_forces FROM orders")
def uses_forces(spark, d):
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_orderstatus") == "F").alias("has_forces"), "o_orderpriority")
    return sets.uses_forces(frames, 0.5, 0.5, frames.where("o_orderpriority like '1%'")).select("sid", "use_forces")


@query(f"WITH {_STRUCTURES}, p AS (SELECT sid, energy + sid % 7 AS predicted FROM s) SELECT s.sid, {_r('s.energy')} AS reference, {_r('p.predicted')} AS predicted, s.n_atoms, {_r('p.predicted - s.energy')} AS difference, {_r('(p.predicted - s.energy) / s.n_atoms')} AS per_atom FROM s JOIN p ON s.sid = p.sid")
def compared_energies(spark, d):
    ref = energies.referenced_energy(structures(spark, d), atoms(spark, d), REFERENCE)
    return rounded(sets.compare(ref.select("sid", (F.col("energy") + F.col("sid") % 7).alias("energy")), ref))


@query(f"WITH {_STRUCTURES} SELECT sid, {_r('energy - (energy - e_ref * n_atoms) ', 3)} AS cohesive, {_r('e_ref', 6)} AS cohesive_per_atom, {_r('energy / n_atoms', 6)} AS energy_per_atom FROM s")
def cohesive_energy(spark, d):
    rows = energies.cohesive_energy(structures(spark, d), atoms(spark, d), REFERENCE)
    return rounded(rounded(rows.select("sid", "cohesive", "cohesive_per_atom", "energy_per_atom"), 3, "cohesive"), 6, "cohesive_per_atom", "energy_per_atom")


@query("SELECT e.event_id, CAST(n.n_nationkey + n.n_regionkey AS DOUBLE) AS energy FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id")
def merged_log(spark, d):
    """Frames with the energy of their step, where the log has it."""
    frames = table(spark, d, "events").select("event_id", F.col("user_id").alias("step"))
    log = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("step"), (F.col("n_nationkey") + F.col("n_regionkey")).cast("double").alias("energy"))
    return sets.merge_log(frames, log).select("event_id", "energy")


@query("SELECT o_orderkey AS entry_idx, l.n IS NOT NULL AS cached, l.n AS payload FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def cached_payload(spark, d):
    cache = atoms(spark, d).groupBy(F.col("sid").alias("entry_idx")).agg(F.count("*").alias("payload"))
    return sets.payload(structures(spark, d).select(F.col("sid").alias("entry_idx")), cache).select("entry_idx", "cached", "payload")


@query("SELECT l_orderkey AS sid, l_orderkey % 16 AS batch, count(*) AS n_atoms, CAST(coalesce(sum(count(*)) OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lineitem GROUP BY l_orderkey")
def collated(spark, d):
    counts = atoms(spark, d).groupBy("sid").agg(F.count("*").alias("n_atoms")).withColumn("batch", F.col("sid") % 16)
    return sets.collate(counts, "batch").select("sid", "batch", "n_atoms", "offset")


@query(f"WITH a AS ({_ATOMS}) SELECT sid, max(CASE WHEN species = 'R' AND aid = 1 THEN 1 ELSE 0 END) = 0 AS equal FROM a GROUP BY sid")
def equal_structures(spark, d):
    a = atoms(spark, d)
    return sets.equal_structures(a, a.withColumn("x", F.when((F.col("species") == "R") & (F.col("aid") == 1), F.col("x") + 1e-9).otherwise(F.col("x"))))


@query("SELECT doc_id, coalesce(nullif(source, ''), 'structure_' || lpad(CAST(doc_id AS VARCHAR), 6, '0')) || CASE WHEN doc_id % 3 <> 0 THEN '#frame=' || doc_id % 3 ELSE '' END AS name FROM documents")
def identifier_of_frames(spark, d):
    return sets.identifier(table(spark, d, "documents"), ["source"], "doc_id", F.col("doc_id") % 3, always=False).select("doc_id", "name")


@query("SELECT CAST(l_suppkey % 4 AS INTEGER) AS member, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS species, true AS same FROM lineitem GROUP BY 1")
def member_types(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("member"), F.col("l_returnflag").alias("species"))
    return sets.same_types(rows).withColumn("species", F.array_join("species", ","))


@query("SELECT CAST(k AS BIGINT) AS idx, CAST(4 * k + 3 AS BIGINT) AS source FROM (SELECT unnest(range(0, 100)) AS k)")
def nested_subsets(spark, d):
    """Of every second of all, those of odd number."""
    outer = spark.range(200).select(F.col("id").alias("idx"), (2 * F.col("id") + 1).alias("of"))
    inner = spark.range(100).select(F.col("id").alias("idx"), (2 * F.col("id") + 1).alias("of"))
    return sets.flatten_subset(outer, inner)


# Committees, fingerprints, training


@query(f"SELECT l_partkey AS sid, l_linenumber AS aid, {_r('avg(l_quantity)')} AS fx, {_r('stddev_pop(l_quantity)')} AS fx_std, {_r('stddev_pop(l_tax)')} AS fz_std FROM lineitem GROUP BY l_partkey, l_linenumber")
def force_std(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sid"), F.col("l_linenumber").alias("aid"), F.col("l_quantity").cast("double").alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz"))
    return rounded(ensemble.force_std(rows).select("sid", "aid", "fx", "fx_std", "fz_std"))


@query(f"WITH l AS (SELECT vec_id % 100 AS sid, label % 3 AS species, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT sid, species, dim, avg(v) AS m1, var_pop(v) AS m2 FROM l WHERE species < 2 GROUP BY ALL), g AS (SELECT s.sid, k.species, dd.dim FROM (SELECT DISTINCT sid FROM l) s, (SELECT unnest(range(2)) AS species) k, (SELECT DISTINCT dim FROM l) dd), f AS (SELECT g.sid, g.species * 128 + g.dim AS place, coalesce(m1, 0) AS v FROM g LEFT JOIN m ON g.sid = m.sid AND g.species = m.species AND g.dim = m.dim UNION ALL SELECT g.sid, g.species * 128 + 64 + g.dim, coalesce(m2, 0) FROM g LEFT JOIN m ON g.sid = m.sid AND g.species = m.species AND g.dim = m.dim) SELECT sid, CAST(place AS INTEGER) AS place, {_r('v', 6)} AS v FROM f")
def moment_fingerprint(spark, d):
    rows = vectors(spark, d).select((F.col("vec_id") % 100).alias("sid"), (F.col("label") % 3).cast("string").alias("species"), F.col("embedding").alias("fingerprint"))
    return rounded(diversity.moment_fingerprint(rows, ["0", "1"], 2).select("sid", F.posexplode("fingerprint").alias("place", "v")), 6)


@query(f"SELECT count(*) AS n, {_r('sqrt(avg(pow((l_extendedprice / 2 + 3 * l_quantity - l_extendedprice) / l_quantity, 2)))', 3)} AS loss FROM lineitem")
def energy_loss(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("energy"), F.col("l_quantity").alias("n_atoms"), F.col("l_extendedprice").alias("reference"))
    return rounded(training.energy_loss(rows, scaling=2.0, shift=3.0), 3)


@query(f"SELECT 3 * count(*) AS n, {_r('sqrt(avg(pow(l_quantity - 1, 2) + pow(l_discount - 2, 2) + pow(l_tax - 3, 2)) / 3)', 5)} AS loss FROM lineitem WHERE l_linenumber <= 3")
def force_loss(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz"), F.when(F.col("l_linenumber") <= 3, 1.0).alias("rx"), F.lit(2.0).alias("ry"), F.lit(3.0).alias("rz"))
    return rounded(training.force_loss(rows), 5)


@query(f"SELECT l_orderkey AS sid, count(*) AS n, {_r('avg(l_discount)', 6)} AS score FROM lineitem GROUP BY l_orderkey")
def error_scores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_discount").alias("error"))
    return rounded(training.error_scores(rows), 6)


@query(f"WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT dim, avg(v) AS m, sqrt(var_pop(v) + 1e-12) AS sd FROM l GROUP BY dim) SELECT vec_id, CAST(l.dim AS INTEGER) AS dim, {_r('(v - m) / greatest(sd, 1e-12)', 5)} AS v FROM l JOIN s ON l.dim = s.dim")
def normalised_features(spark, d):
    long = diversity.long_form(vectors(spark, d), ("vec_id",), "embedding")
    return rounded(training.normalise_features(long, diversity.feature_stats(long), ("vec_id",)), 5)


@query("SELECT CAST(5000 AS BIGINT) AS draws, true AS known")
def weighted_draws(spark, d):
    """Draws with replacement by energy: as many as asked for, of rows that are there."""
    rows = structures(spark, d)
    drawn = training.sampler("energy_weighted", rows, 5000, 3)
    return drawn.join(rows.select("sid"), "sid", "left_semi").agg(F.sum("draws").alias("draws"), (F.min("draws") > 0).alias("known"))


@query("SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) AS n, CAST(ceil(count(*) * 0.1) AS BIGINT) AS different FROM orders")
def sampled_fraction(spark, d):
    return training.sample_fraction(structures(spark, d), 0.1, 5).agg(F.count("*").alias("n"), F.count_distinct("sid").alias("different"))


@query(f"WITH p AS ({_POINTS}) SELECT pid AS run, CAST(max(frame) AS INTEGER) AS epochs, arg_min(frame, (x, frame)) AS best_epoch, {_r('min(x)')} AS best, CASE WHEN pid % 7 = 0 THEN 'stopped' WHEN max(frame) >= 50 THEN 'completed' ELSE 'running' END AS state FROM p GROUP BY pid")
def run_status(spark, d):
    runs = points(spark, d).toDF("run", "epoch", "rmse_test").withColumn("stopped", (F.col("run") % 7 == 0) & (F.col("epoch") == 1))
    return rounded(training.status(runs, wanted=50))


@query(f"WITH p AS ({_POINTS}) SELECT pid AS run, frame AS epoch, {_r('x')} AS rmse_test FROM p ORDER BY x, frame, pid LIMIT 5")
def best_epochs(spark, d):
    return rounded(training.best_epochs(points(spark, d).toDF("run", "epoch", "rmse_test"), 5))


@query(f"WITH p AS (SELECT pid, frame, CASE WHEN pid % 4 = 0 AND frame IN (3, 5) THEN CAST('NaN' AS DOUBLE) ELSE x END AS x FROM ({_POINTS})) SELECT pid AS run, count(*) AS n, {_r('arg_max(x, frame)')} AS final, CASE WHEN pid % 4 = 0 AND count(*) >= 3 THEN CAST('NaN' AS DOUBLE) ELSE {_r('min(x)')} END AS best, CASE WHEN pid % 4 = 0 AND count(*) >= 3 THEN 3 ELSE arg_min(frame, (x, frame)) END AS best_epoch FROM p GROUP BY pid")
def training_stats(spark, d):
    bad = (F.col("pid") % 4 == 0) & F.col("frame").isin(3, 5)
    p = points(spark, d).withColumn("x", F.when(bad, float("nan")).otherwise(F.col("x"))).toDF("run", "epoch", "rmse")
    return training.training_stats(p).withColumns({c: F.when(F.isnan(c), F.col(c)).otherwise(F.round(c, 4) + 0.0) for c in ("final", "best")})


_SUMS = "".join(f", sum(n{a} * n{b}) AS s{a}{b}" for i, a in enumerate("anr") for b in "anr"[i:]) + "".join(f", sum(n{a} * e) AS t{a}" for a in "anr")


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_M = [["saa", "san", "sar"], ["san", "snn", "snr"], ["sar", "snr", "srr"]]
_CRAMER = [_det([[("t" + "anr"[i] if j == k else _M[i][j]) for j in range(3)] for i in range(3)]) for k in range(3)]


@query(f"WITH a AS ({_ATOMS}), c AS (SELECT sid, CAST(count(*) FILTER (species = 'A') AS DOUBLE) AS na, CAST(count(*) FILTER (species = 'N') AS DOUBLE) AS nn, CAST(count(*) FILTER (species = 'R') AS DOUBLE) AS nr FROM a GROUP BY sid), m AS (SELECT 1 AS one{_SUMS} FROM (SELECT na, nn, nr, o_totalprice AS e FROM c JOIN orders ON sid = o_orderkey)) " + " UNION ALL ".join(f"SELECT '{s}' AS species, {_r(f'{e} / {_det(_M)}', 2)} AS energy FROM m" for s, e in zip("ANR", _CRAMER, strict=True)))
def reference_energies_solved(spark, d):
    """Atomic energies by least squares, against the normal equations solved by determinants."""
    c = energies.composition(atoms(spark, d), ["A", "N", "R"]).join(structures(spark, d), "sid")
    fit = energies.reference_fit(c, ["A", "N", "R"])
    return rounded(spark.createDataFrame(sorted(fit["energies"].items()), "species string, energy double"), 2)


@query(f"WITH {_KEYS}, q AS (SELECT s.sid, key, CAST(regexp_extract(key, '([0-9]+)$', 1) AS BIGINT) AS n, left(key, 1) AS one FROM s JOIN k USING (sid) WHERE key NOT LIKE '%,%') SELECT q.one AS species, {_r('min(o_totalprice / n)')} AS energy FROM q JOIN orders ON o_orderkey = q.sid GROUP BY q.one")
def compound_references(spark, d):
    """Energies of the elements from their cheapest samples, of any size."""
    found = energies.compound_references(keyed(spark, d), {s: {s: 1} for s in "ANR"})
    return rounded(spark.createDataFrame(sorted(found["energies"].items()), "species string, energy double"))


# Chains, texts


@query(f"WITH a AS ({_ATOMS}) SELECT sid AS source, CAST(3 * 2 AS BIGINT) AS structures, CAST(6 * 2 * count(*) AS BIGINT) AS atoms, {_r('max(x) * 1.1 * 1.05 + 50 * 1.1 * 1.05', 3)} AS far FROM a GROUP BY sid")
def chained(spark, d):
    """Three scales, two strains of each, each twice along its first vector."""
    made = chain.Chain(chain.isotropic(0.9, 1.1, 3), chain.uniaxial("x", 1.0, 1.05, 2), chain.supercell(2, 1, 1))(celled(spark, d))
    return rounded(made.groupBy("source").agg(F.count_distinct("sid").alias("structures"), F.count("*").alias("atoms"), F.max("x").alias("far")), 3)


@query(f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY species) - 1 AS place FROM ({_ATOMS}) WHERE aid NOT IN (1, 3)), m AS (SELECT sid, avg(x) AS mx FROM a GROUP BY sid) SELECT a.sid, species, CAST(min(place) AS INTEGER) AS first, CAST(max(place) AS INTEGER) AS last, {_r('sum(2 * (x - mx))')} AS x, {_r('max(2 * (x - mx))')} AS far FROM a JOIN m ON a.sid = m.sid GROUP BY a.sid, species")
def converted(spark, d):
    """Without two atoms, centred, twice as large, sorted by species."""
    out = chain.convert(atoms(spark, d).select("sid", "aid", "species", "x", "y", "z"), remove_atoms=[2, 4], shift="origin", scale=(2.0,), sort=True)
    return rounded(out.groupBy("sid", "species").agg(F.min("aid").cast("int").alias("first"), F.max("aid").cast("int").alias("last"), F.sum("x").alias("x"), F.max("x").alias("far")))


@query(f"WITH a AS ({_ATOMS}) SELECT sid, species, CAST(count(*) AS INTEGER) AS count FROM a GROUP BY sid, species")
def formula_counts(spark, d):
    """Formulas made of the atoms, and read again."""
    n = atoms(spark, d).groupBy("sid", "species").agg(F.count("*").alias("n"))
    text = n.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("species", "n"))), lambda x: F.concat(x["species"], F.when(x["n"] > 1, x["n"].cast("string")).otherwise(""))), "").alias("formula"))
    return text.select("sid", F.explode(S.rows_of_formula(F.col("formula"))).alias("e")).select("sid", "e.species", "e.count")


@query("SELECT l_orderkey AS sid, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) AS v FROM lineitem GROUP BY l_orderkey")
def expanded_ranges(spark, d):
    text = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sid")).agg(F.concat(F.min("l_linenumber").cast("string"), F.lit(" : "), F.max("l_linenumber").cast("string")).alias("t"))
    return text.select("sid", F.explode(S.range_list(F.col("t"))).alias("v")).withColumn("v", F.col("v").cast("long"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS whole, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS real FROM events")
def numbers_of_texts(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", S.number(k)["whole"].alias("whole"), S.number(F.concat(k, F.lit("D-2")))["real"].alias("real"))


@query("SELECT l_orderkey AS sid, l_linenumber AS aid, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_tax AS DOUBLE) AS tax FROM lineitem")
def pairs_of_texts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_linenumber").alias("aid"), F.concat(F.lit("Q = "), F.col("l_quantity").cast("string"), F.lit(" , T="), F.col("l_tax").cast("string")).alias("t"))
    return rows.select("sid", "aid", S.pairs(F.col("t"))["Q"].cast("double").alias("quantity"), S.pairs(F.col("t"))["T"].cast("double").alias("tax"))


@query("SELECT user_id, arg_max(event_id, ts) IS NOT NULL AS whole FROM events GROUP BY user_id")
def checked_energies(spark, d):
    """Energies that pass their validation."""
    good = table(spark, d, "events").where("value is not null").select("user_id", S.check_energy(F.col("value")).alias("e"))
    return good.groupBy("user_id").agg((F.count("e") > 0).alias("whole"))


@query(f"SELECT l_partkey AS sid, CAST(count(*) AS BIGINT) AS n, {_r('avg(l_extendedprice / l_quantity)')} AS mean FROM lineitem GROUP BY l_partkey")
def united_members(spark, d):
    rows = predictions(spark, d)
    whole = sets.union_all(*[rows.where(F.col("member") == k).drop(*(["fx"] if k else [])) for k in range(4)])
    return rounded(whole.groupBy("sid").agg(F.count("*").alias("n"), F.avg("energy").alias("mean")))


@query()
def predicted(spark, d):
    """Energies and forces of networks in one call."""
    from .registry import _networks

    a = atoms(spark, d).dropDuplicates(["sid", "aid"])
    whole, _ = network.predict(a, spatial.edges(a, CUTOFF), _networks(10), SPINS, (8.0, 2, 8.0, 1), REFERENCE, 2.0, 0.1, 0.01)
    return whole
