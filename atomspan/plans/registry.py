"""All registered queries on the test tables, with the SQL that checks them.

Stand-ins: orders are structures (energy: total price), line items their atoms (species: return flag; x, y, z: quantity,
100 * discount, 100 * tax), suppliers modulo 4 a committee's members, events trajectories and training runs, embeddings
fingerprints. Floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import diversity, energies, ensemble, generators, geometry, spatial, structures as sets, training, trajectory

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Stand-in values.
REFERENCE = {"A": 100.0, "N": 200.0, "R": 300.0}
SPINS = {"A": -1, "N": 0, "R": 1}
CUTOFF, CELL = 12.0, [[50.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 10.0]]

_ATOMS = "SELECT l_orderkey AS sid, l_linenumber AS aid, l_returnflag AS species, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem"
_PAIRS = f"""a AS ({_ATOMS}), e AS (SELECT * FROM (SELECT p.sid, p.aid AS i, q.aid AS j, p.species AS si, q.species AS sj, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz,
 sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z)) AS d FROM a p JOIN a q ON p.sid = q.sid AND p.aid <> q.aid) WHERE d <= 12)"""
_POINTS = "SELECT user_id AS pid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame, value AS x FROM events WHERE value IS NOT NULL"
_STRUCTURES = f"""a AS ({_ATOMS}), s AS (SELECT o_orderkey AS sid, o_totalprice AS energy, n AS n_atoms, (o_totalprice - e) / n AS e_ref
 FROM orders JOIN (SELECT sid, count(*) AS n, sum(CASE species WHEN 'A' THEN 100.0 WHEN 'N' THEN 200.0 WHEN 'R' THEN 300.0 ELSE 0.0 END) AS e FROM a GROUP BY sid) ON o_orderkey = sid)"""
_LONG = "SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
_KEYS = f"""{_STRUCTURES}, k AS (SELECT sid, string_agg(species || n, ',' ORDER BY species) AS key FROM (SELECT sid, species, count(*) AS n FROM a GROUP BY sid, species) GROUP BY sid)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def atoms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_linenumber").alias("aid"), F.col("l_returnflag").alias("species"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


def structures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_totalprice").alias("energy"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("sid"), (F.col("l_suppkey") % 4).cast("int").alias("member"), F.try_divide("l_extendedprice", "l_quantity").alias("energy"), *[F.col(c).cast("double").alias(n) for c, n in (("l_quantity", "fx"), ("l_discount", "fy"), ("l_tax", "fz"))])


def celled(spark: SparkSession, d: str) -> DataFrame:
    """Atoms with CELL as their column ``cell``."""
    return atoms(spark, d).withColumn("cell", F.array(*[F.array(*map(F.lit, row)) for row in CELL]))


def points(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("pid"), F.row_number().over(w).alias("frame"), F.col("value").alias("x"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return spatial.edges(atoms(spark, d), CUTOFF)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding")


def keyed(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    return energies.referenced_energy(structures(spark, d), a, REFERENCE).join(energies.composition_key(a), "sid")


def rounded(df: DataFrame, n: int = 4, *columns: str) -> DataFrame:
    """The named columns, or all of type double, rounded; -0 becomes 0."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, n) + 0.0 for c in names})


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(e: str, n: int = 4) -> str:
    return f"round({e}, {n}) + 0.0"


# Committees


@query(f"SELECT l_partkey AS sid, count(*) AS n, {_r('min(l_extendedprice/l_quantity)', 9)} AS e_min, {_r('max(l_extendedprice/l_quantity)', 9)} AS e_max, {_r('avg(l_extendedprice/l_quantity)')} AS e_mean, {_r('stddev_pop(l_extendedprice/l_quantity)')} AS e_std FROM lineitem GROUP BY l_partkey")
def ensemble_stats(spark, d):
    return rounded(rounded(ensemble.ensemble_stats(predictions(spark, d)), 9, "e_min", "e_max"), 4, "e_mean", "e_std")


@query(f"SELECT l_partkey AS sid, {_r('max(CASE WHEN l_suppkey % 4 = 0 THEN l_extendedprice/l_quantity END)', 9)} AS energy, {_r('stddev_pop(l_extendedprice/l_quantity)')} AS e_std FROM lineitem GROUP BY l_partkey")
def ensemble_reference(spark, d):
    return rounded(rounded(ensemble.ensemble_reference(predictions(spark, d), 0), 9, "energy"), 4, "e_std")


@query(f"SELECT sid, {_r('e_std')} AS e_std FROM (SELECT l_partkey AS sid, stddev_pop(l_extendedprice/l_quantity) AS e_std FROM lineitem GROUP BY l_partkey) ORDER BY round(e_std, 4) DESC, sid LIMIT 10")
def top_uncertain(spark, d):
    stats = ensemble.ensemble_stats(predictions(spark, d)).select("sid", "e_std")
    return ensemble.top_uncertain(rounded(stats), 10)


@query(f"SELECT l_partkey AS sid, l_linenumber AS aid, {_r('(stddev_pop(l_quantity) + stddev_pop(l_discount) + stddev_pop(l_tax)) / 3')} AS u FROM lineitem GROUP BY l_partkey, l_linenumber")
def force_uncertainty(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sid"), F.col("l_linenumber").alias("aid"), F.col("l_quantity").cast("double").alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz"))
    return rounded(ensemble.force_uncertainty(rows))


@query(f"WITH u AS (SELECT l_partkey AS sid, (stddev_pop(l_quantity) + stddev_pop(l_discount) + stddev_pop(l_tax)) / 3 AS u FROM lineitem GROUP BY l_partkey, l_linenumber) SELECT sid, {_r('max(u)')} AS u_max, {_r('avg(u)')} AS u_mean FROM u GROUP BY sid")
def structure_uncertainty(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sid"), F.col("l_linenumber").alias("aid"), F.col("l_quantity").cast("double").alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz"))
    return rounded(ensemble.structure_uncertainty(ensemble.force_uncertainty(rows)))


@query(f"WITH r AS (SELECT user_id, max(value) AS a, min(value) AS b FROM events GROUP BY user_id) SELECT metric, count(*) AS n, {_r('avg(v)')} AS mean, {_r('stddev_pop(v)')} AS std, {_r('min(v)')} AS low, {_r('max(v)')} AS high FROM (SELECT 'a' AS metric, a AS v FROM r UNION ALL SELECT 'b', b FROM r) WHERE v IS NOT NULL AND isfinite(v) GROUP BY metric")
def committee_member_stats(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("a"), F.min("value").alias("b"))
    return rounded(ensemble.member_stats(runs, ("a", "b")))


# Compositions, energies, filters


@query(f"SELECT sid, count(*) FILTER (species = 'A') AS \"n_A\", count(*) FILTER (species = 'N') AS \"n_N\", count(*) FILTER (species = 'R') AS \"n_R\" FROM ({_ATOMS}) GROUP BY sid")
def composition_pivot(spark, d):
    return energies.composition(atoms(spark, d), ["A", "N", "R"])


@query(f"WITH {_KEYS} SELECT key, count(*) AS n FROM k GROUP BY key")
def composition_key_count(spark, d):
    return energies.composition_key(atoms(spark, d)).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH {_STRUCTURES} SELECT sid, {_r('energy', 6)} AS energy, n_atoms, {_r('e_ref', 6)} AS e_ref FROM s")
def referenced_energy(spark, d):
    return rounded(energies.referenced_energy(structures(spark, d), atoms(spark, d), REFERENCE), 6)


@query(f"WITH {_STRUCTURES} SELECT sid, {_r('e_ref', 6)} AS e_ref FROM s WHERE e_ref <= 20000")
def energy_filter(spark, d):
    return rounded(energies.energy_filter(energies.referenced_energy(structures(spark, d), atoms(spark, d), REFERENCE), 20000.0).select("sid", "e_ref"), 6)


@query("SELECT o_orderkey AS sid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(greatest(abs(l_quantity), abs(l_discount), abs(l_tax))) > 40)")
def force_filter(spark, d):
    forces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_quantity").cast("double").alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz"))
    return energies.force_filter(structures(spark, d), forces, 40.0).select("sid")


@query(f"WITH {_STRUCTURES} SELECT count(*) AS n_structures, CAST(sum(n_atoms) AS BIGINT) AS n_atoms, {_r('min(e_ref)', 6)} AS e_min, {_r('max(e_ref)', 6)} AS e_max, {_r('avg(e_ref)', 5)} AS e_av, {_r('(max(e_ref) + min(e_ref)) / 2', 7)} AS shift, {_r('2 / (max(e_ref) - min(e_ref))', 9)} AS scale FROM s")
def trainset_header(spark, d):
    return rounded(rounded(rounded(rounded(energies.trainset_header(energies.referenced_energy(structures(spark, d), atoms(spark, d), REFERENCE)), 9, "scale", "shift"), 6, "e_min", "e_max"), 5, "e_av"), 7, "shift")


@query(f"SELECT o_orderkey AS sid, {_r('1 / (1 + (o_totalprice - lo) / (hi - lo))', 6)} AS weight FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def energy_weights(spark, d):
    return rounded(energies.energy_weights(structures(spark, d)).select("sid", "weight"), 6)


@query(f"SELECT o_orderkey AS sid, {_r('greatest(o_totalprice, 1e-12) / m', 6)} AS weight FROM orders, (SELECT avg(greatest(o_totalprice, 1e-12)) AS m FROM orders)")
def error_weights(spark, d):
    return rounded(energies.error_weights(structures(spark, d).withColumnRenamed("energy", "error")).select("sid", "weight"), 6)


@query(f"WITH {_KEYS} SELECT key, arg_min(s.sid, (energy, s.sid)) AS sid, {_r('min(energy)')} AS energy, count(*) AS n FROM s JOIN k USING (sid) GROUP BY key")
def min_energy_per_composition(spark, d):
    return rounded(energies.min_energy_per_composition(keyed(spark, d)))


@query(f"WITH {_KEYS} SELECT key FROM (SELECT 'A' || i || ',N' || j AS key FROM range(1, 8) x(i), range(1, 8) y(j)) WHERE key NOT IN (SELECT key FROM k)")
def missing_references(spark, d):
    want = spark.range(1, 8).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("j")).select(F.concat(F.lit("A"), "i", F.lit(",N"), "j").alias("key"))
    return energies.missing(want, energies.composition_key(atoms(spark, d)))


@query(f"WITH a AS ({_ATOMS}), c AS (SELECT sid, count(*) FILTER (species = 'A') AS na, count(*) FILTER (species = 'N') AS nn, count(*) FILTER (species = 'R') AS nr FROM a GROUP BY sid) SELECT na AS \"n_A\", nn AS \"n_N\", nr AS \"n_R\", count(*) AS n, {_r('sum(o_totalprice)', 2)} AS se, {_r('sum(o_totalprice * o_totalprice) / 1e6', 2)} AS see FROM c JOIN orders ON sid = o_orderkey GROUP BY na, nn, nr")
def composition_least_squares(spark, d):
    c = energies.composition(atoms(spark, d), ["A", "N", "R"]).join(structures(spark, d), "sid")
    return rounded(energies.least_squares_sums(c, ["A", "N", "R"]).withColumn("see", F.col("see") / 1e6), 2)


@query("SELECT l_orderkey AS sid, count(*) AS n_atoms, CAST(coalesce(sum(count(*)) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_atom FROM lineitem GROUP BY l_orderkey")
def first_atom_offsets(spark, d):
    return energies.first_atom_offsets(atoms(spark, d).groupBy("sid").agg(F.count("*").alias("n_atoms")))


@query()
def reference_energies(spark, d):
    c = energies.composition(atoms(spark, d), ["A", "N", "R"]).join(structures(spark, d), "sid")
    return spark.createDataFrame(sorted(energies.fit_reference_energies(c, ["A", "N", "R"]).items()), "species string, energy double")


# Neighbours and descriptors


@query(f"WITH {_PAIRS} SELECT sid, i, j, {_r('d', 6)} AS d FROM e")
def neighbor_edges(spark, d):
    return rounded(edges(spark, d).select("sid", "i", "j", "d"), 6)


@query(f"WITH {_PAIRS} SELECT a.sid, a.aid AS i, coalesce(n, 0) AS n FROM a LEFT JOIN (SELECT sid, i, count(*) AS n FROM e GROUP BY sid, i) c ON a.sid = c.sid AND a.aid = c.i")
def neighbor_counts(spark, d):
    return spatial.neighbor_counts(atoms(spark, d), edges(spark, d))


@query(f"WITH {_PAIRS} SELECT sid, i, j, {_r('d', 6)} AS d FROM e WHERE d <= CASE WHEN least(si, sj) = 'A' AND greatest(si, sj) = 'N' THEN 5 WHEN si = 'R' AND sj = 'R' THEN 7 ELSE 10 END")
def pair_cutoff(spark, d):
    return rounded(spatial.pair_cutoff(edges(spark, d), {("N", "A"): 5.0, ("R", "R"): 7.0}, 10.0).select("sid", "i", "j", "d"), 6)


@query(f"""WITH a AS ({_ATOMS}), w AS (SELECT sid, aid, x - 50 * floor(x / 50) AS x, y - 10 * floor(y / 10) AS y, z - 10 * floor(z / 10) AS z FROM a),
w2 AS (SELECT sid, aid, x, CASE WHEN y >= 10 - 1e-9 THEN y - 10 ELSE y END AS y, z FROM w),
o AS (SELECT i.v AS ox, j.v AS oy, k.v AS oz FROM (SELECT unnest(range(-1, 2)) AS v) i, (SELECT unnest(range(-1, 2)) AS v) j, (SELECT unnest(range(-1, 2)) AS v) k)
SELECT sid, i, count(*) AS n, {_r('sum(d)')} AS total FROM (SELECT p.sid, p.aid AS i, q.aid AS j, ox, oy, oz, sqrt(pow(q.x + 50*ox - p.x, 2) + pow(q.y + 10*oy - p.y, 2) + pow(q.z + 10*oz - p.z, 2)) AS d
FROM w2 p JOIN w2 q ON p.sid = q.sid JOIN o ON p.aid <> q.aid OR ox <> 0 OR oy <> 0 OR oz <> 0) WHERE d <= 6.35 GROUP BY sid, i""")
def periodic_edges(spark, d):
    found = spatial.periodic_edges(atoms(spark, d), 6.35, cell=CELL)
    return rounded(found.groupBy("sid", "i").agg(F.count("*").alias("n"), F.sum("d").alias("total")))


@query(f"WITH {_PAIRS}, m AS (SELECT *, min(d) OVER (PARTITION BY sid, i) AS lo FROM e) SELECT sid, i, j, {_r('d', 6)} AS d FROM m WHERE d <= lo + 0.5")
def nearest_shell(spark, d):
    return rounded(spatial.nearest_shell(edges(spark, d), 0.5).select("sid", "i", "j", "d"), 6)


@query(f"WITH {_PAIRS} SELECT sid, i, {_r('min(d)', 6)} AS d FROM e GROUP BY sid, i")
def bond_length(spark, d):
    return rounded(spatial.bond_length(edges(spark, d)), 6)


@query(f"WITH {_PAIRS} SELECT sid, i, CAST(count(*) FILTER (d <= 6) AS BIGINT) AS cn FROM e GROUP BY sid, i")
def coordination_hard(spark, d):
    return spatial.coordination(edges(spark, d), 6.0)


@query(f"WITH {_PAIRS} SELECT sid, i, {_r('sum(1 / (1 + pow(d / 6, 6)))', 6)} AS cn FROM e GROUP BY sid, i")
def coordination_smooth(spark, d):
    return rounded(spatial.coordination(edges(spark, d), 6.0, smooth=True), 6)


@query(f"WITH {_PAIRS} SELECT CAST(floor(d / 0.75) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1")
def rdf_histogram(spark, d):
    return spatial.rdf_histogram(edges(spark, d), 0.75)


@query(f"WITH {_PAIRS}, h AS (SELECT CAST(floor(d / 0.75) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1) SELECT bin, {_r('(bin + 0.5) * 0.75')} AS r, {_r('n / 1000 / (0.01 * 4 / 3 * pi() * pow(0.75, 3) * (pow(bin + 1, 3) - pow(bin, 3)))')} AS g FROM h")
def rdf_normalized(spark, d):
    return rounded(spatial.rdf(edges(spark, d), 0.75, 1000, 0.01))


_X, _FC = "least(1.0, greatest(-1.0, (2 * d - 12) / 12))", "CASE WHEN d < 12 THEN 0.5 * (cos(pi() * d / 12) + 1) ELSE 0 END"
_SPIN = "CASE {} WHEN 'A' THEN -1.0 WHEN 'N' THEN 0.0 WHEN 'R' THEN 1.0 END"


@query(f"WITH {_PAIRS} SELECT sid, i, " + ", ".join(f"{_r(f'sum(cos({n} * acos({_X})) * ({_FC}))', 5)} AS r{n}, {_r(f'sum(cos({n} * acos({_X})) * ({_FC}) * ({_SPIN.format("sj")}))', 5)} AS rw{n}" for n in range(4)) + " FROM e WHERE d > 0 AND d <= 12 GROUP BY sid, i")
def chebyshev_radial(spark, d):
    return rounded(spatial.radial_sums(edges(spark, d), 12.0, 3, SPINS), 5)


_TRI = f"""n AS (SELECT *, row_number() OVER (PARTITION BY sid, i ORDER BY j) AS rk FROM e WHERE d > 0 AND d <= 8),
t AS (SELECT p.sid, p.i, p.j, q.j AS k, p.sj AS sj, q.sj AS sk, p.d AS d1, q.d AS d2, least(1.0, greatest(-1.0, (p.dx*q.dx + p.dy*q.dy + p.dz*q.dz) / (p.d * q.d))) AS c FROM n p JOIN n q ON p.sid = q.sid AND p.i = q.i AND p.rk < q.rk)"""
_F2 = "(CASE WHEN d1 < 8 THEN 0.5 * (cos(pi() * d1 / 8) + 1) ELSE 0 END) * (CASE WHEN d2 < 8 THEN 0.5 * (cos(pi() * d2 / 8) + 1) ELSE 0 END)"


@query(f"WITH {_PAIRS}, {_TRI} SELECT sid, i, " + ", ".join(f"{_r(f'sum(cos({n} * acos(c)) * {_F2})', 5)} AS a{n}, {_r(f'sum(cos({n} * acos(c)) * {_F2} * ({_SPIN.format("sj")}) * ({_SPIN.format("sk")}))', 5)} AS aw{n}" for n in range(3)) + " FROM t GROUP BY sid, i")
def chebyshev_angular(spark, d):
    return rounded(spatial.angular_sums(edges(spark, d), 8.0, 2, SPINS), 5)


@query(f"WITH {_PAIRS}, {_TRI} SELECT sid, i, j, k, {_r('c', 5)} AS cos_theta FROM t")
def triplets(spark, d):
    return rounded(spatial.triplets(edges(spark, d), 8.0).select("sid", "i", "j", "k", "cos_theta"), 5)


@query()
def descriptors(spark, d):
    return spatial.descriptors(atoms(spark, d), edges(spark, d), 12.0, 3, 8.0, 2, SPINS)


# Trajectories and training runs


@query(f"WITH p AS ({_POINTS}) SELECT b.frame - a.frame AS lag, {_r('avg((b.x - a.x) * (b.x - a.x))')} AS msd FROM p a JOIN p b ON a.pid = b.pid AND b.frame BETWEEN a.frame + 1 AND a.frame + 10 GROUP BY 1 UNION ALL SELECT 0, 0.0")
def msd_lags(spark, d):
    return rounded(trajectory.msd(points(spark, d), 10))


@query(f"WITH p AS ({_POINTS}), s AS (SELECT b.frame - a.frame AS lag, a.frame, sum(b.x - a.x) AS dx FROM p a JOIN p b ON a.pid = b.pid AND b.frame BETWEEN a.frame + 1 AND a.frame + 10 GROUP BY 1, 2) SELECT lag, {_r('avg(dx * dx)', 2)} AS tsd FROM s GROUP BY lag")
def total_sd(spark, d):
    return rounded(trajectory.total_squared_displacement(points(spark, d), 10), 2)


@query(f"WITH p AS ({_POINTS}), m AS (SELECT b.frame - a.frame AS lag, avg((b.x - a.x) * (b.x - a.x)) AS msd FROM p a JOIN p b ON a.pid = b.pid AND b.frame BETWEEN a.frame + 1 AND a.frame + 10 GROUP BY 1 UNION ALL SELECT 0, 0.0) SELECT {_r('regr_slope(msd, lag * 0.5) * 1e-4 / 2', 8)} AS d FROM m")
def diffusivity(spark, d):
    return rounded(trajectory.diffusivity(trajectory.msd(points(spark, d), 10), 0.5, 1), 8)


@query(f"WITH p AS ({_POINTS}), n AS (SELECT *, round_even((x - lag(x) OVER (PARTITION BY pid ORDER BY frame)) / 100, 0) AS k FROM p) SELECT pid, frame, {_r('x - 100 * sum(coalesce(k, 0)) OVER (PARTITION BY pid ORDER BY frame)')} AS x FROM n")
def unwrap_frames(spark, d):
    return rounded(trajectory.unwrap(points(spark, d), 100.0))


@query(f"WITH p AS ({_POINTS}) SELECT pid AS run, count(*) AS n, {_r('arg_max(x, frame)')} AS final, {_r('min(x)')} AS best, arg_min(frame, (x, frame)) AS best_epoch FROM p WHERE isfinite(x) GROUP BY pid")
def epoch_summary(spark, d):
    return rounded(trajectory.epoch_summary(points(spark, d).toDF("run", "epoch", "rmse")))


@query(f"WITH p AS ({_POINTS}), b AS (SELECT *, min(x) OVER (PARTITION BY pid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) SELECT pid AS run, frame AS epoch, {_r('x')} AS rmse, m IS NULL OR x < m AS is_best FROM b")
def best_so_far(spark, d):
    return rounded(trajectory.best_so_far(points(spark, d).toDF("run", "epoch", "rmse")))


# Vector sets


@query(f"WITH l AS ({_LONG}) SELECT CAST(dim AS INTEGER) AS dim, {_r('avg(v)', 6)} AS mean, {_r('sqrt(var_pop(v) + 1e-12)', 6)} AS std, {_r('min(v)', 6)} AS low, {_r('max(v)', 6)} AS high FROM l GROUP BY dim")
def feature_stats(spark, d):
    return rounded(diversity.feature_stats(diversity.long_form(vectors(spark, d), ("vec_id",), "embedding")), 6)


_MOMENTS = f"l AS ({_LONG}), m AS (SELECT label, dim, avg(v) AS m1 FROM l GROUP BY label, dim), mm AS (SELECT l.label, l.dim, m1, avg(pow(v - m1, 2)) AS m2, avg(pow(v - m1, 3)) AS m3 FROM l JOIN m ON l.label = m.label AND l.dim = m.dim GROUP BY l.label, l.dim, m1)"


@query(f"WITH {_MOMENTS} SELECT label, CAST(dim AS INTEGER) AS dim, {_r('m1', 6)} AS m1, {_r('m2', 6)} AS m2, {_r('m3', 6)} AS m3 FROM mm")
def inner_moments(spark, d):
    return rounded(diversity.moments(diversity.long_form(vectors(spark, d), ("vec_id", "label"), "embedding"), ("label", "dim"), 3), 6)


@query(f"WITH {_MOMENTS}, u AS (SELECT label, dim, 1 AS inner_, m1 AS v FROM mm UNION ALL SELECT label, dim, 2, m2 FROM mm), g AS (SELECT dim, inner_, avg(v) AS a FROM u GROUP BY dim, inner_) SELECT CAST(0 AS INTEGER) AS sid, CAST(u.dim AS INTEGER) AS dim, CAST(u.inner_ AS INTEGER) AS \"inner\", {_r('a', 6)} AS m1, {_r('avg(pow(v - a, 2))', 6)} AS m2 FROM u JOIN g ON u.dim = g.dim AND u.inner_ = g.inner_ GROUP BY u.dim, u.inner_, a")
def global_fingerprint(spark, d):
    rows = vectors(spark, d).select(F.lit(0).alias("sid"), F.col("label").alias("species"), F.col("embedding").alias("fingerprint"))
    return rounded(diversity.global_fingerprint(rows, 2, 2), 6)


@query(f"WITH l AS ({_LONG}), s AS (SELECT dim, avg(v) AS m, stddev_samp(v) AS sd FROM l GROUP BY dim) SELECT vec_id, CAST(l.dim AS INTEGER) AS dim, {_r('(v - m) / CASE WHEN sd < 1e-10 THEN 1 ELSE sd END', 5)} AS v FROM l JOIN s ON l.dim = s.dim")
def standardize(spark, d):
    return rounded(diversity.standardize(diversity.long_form(vectors(spark, d), ("vec_id",), "embedding"), ("vec_id",)), 5)


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT (SELECT count(*) FROM v) AS n, {_r('avg(list_cosine_similarity(a.e, b.e))', 6)} AS mean_cosine FROM v a JOIN v b ON a.vec_id < b.vec_id")
def cosine_mean(spark, d):
    return rounded(diversity.mean_cosine(vectors(spark, d), "embedding"), 6)


@query(f"WITH c AS (SELECT label AS vec_id, [avg(embedding[1]), avg(embedding[2]), avg(embedding[3]), avg(embedding[4])] AS e FROM embeddings GROUP BY label) SELECT a.vec_id AS a, b.vec_id AS b, {_r('list_distance(a.e, b.e)', 5)} AS euclid, {_r('list_cosine_similarity(a.e, b.e)', 5)} AS cosine FROM c a JOIN c b ON a.vec_id < b.vec_id")
def pair_metrics(spark, d):
    means = vectors(spark, d).groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[k]) for k in range(4)]).alias("e"))
    return rounded(diversity.pair_metrics(means, "label", "e").drop("pearson"), 5)


@query(f"WITH l AS ({_LONG}), m AS (SELECT label, dim, avg(v) AS v FROM l GROUP BY label, dim) SELECT a.label AS a, b.label AS b, {_r('sqrt(sum(pow(a.v - b.v, 2)))', 5)} AS euclid, {_r('sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))', 5)} AS cosine, {_r('corr(a.v, b.v)', 5)} AS pearson FROM m a JOIN m b ON a.label < b.label AND a.dim = b.dim GROUP BY a.label, b.label")
def pair_metrics_whole(spark, d):
    """As ``pair_metrics``, whose SQL takes four components, over all components and with the correlation."""
    means = diversity.moments(diversity.long_form(vectors(spark, d), ("label",), "embedding"), ("label", "dim"), 1)
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m1"))), lambda x: x["m1"]).alias("e"))
    return rounded(diversity.pair_metrics(whole, "label", "e"), 5)


@query()
def clusters(spark, d):
    rows = vectors(spark, d).select(F.col("vec_id").alias("sid"), F.col("embedding").alias("fingerprint"), F.col("label").cast("double").alias("energy"))
    return diversity.cluster(rows, 4, 3)[1]


# Generators


@query(f"WITH a AS ({_ATOMS}), c AS (SELECT sid, aid AS moved, unnest(['x','y','z']) AS axis FROM a WHERE sid % 10 >= 0) SELECT c.sid, moved, axis, count(*) AS n, {_r('sum(x + CASE WHEN aid = moved AND axis = \'x\' THEN 0.1 ELSE 0 END)')} AS x, {_r('sum(y + CASE WHEN aid = moved AND axis = \'y\' THEN 0.1 ELSE 0 END)')} AS y FROM c JOIN a ON a.sid = c.sid GROUP BY c.sid, moved, axis")
def displacements(spark, d):
    made = generators.displacements(atoms(spark, d), 0.1)
    return rounded(made.groupBy("sid", "moved", "axis").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")))


@query(f"WITH a AS ({_ATOMS}) SELECT sid, CAST(aid * 4 + i * 2 + j AS BIGINT) AS aid, species, {_r('x + 50 * i')} AS x, {_r('y + 10 * j')} AS y, {_r('z')} AS z FROM a, (SELECT unnest(range(2)) AS i) p, (SELECT unnest(range(2)) AS j) q")
def supercell(spark, d):
    return rounded(generators.supercell(atoms(spark, d), CELL, 2, 2, 1).select("sid", F.col("aid").cast("long").alias("aid"), "species", "x", "y", "z"))


@query(f"WITH a AS ({_ATOMS}) SELECT sid, aid, CAST(k AS INTEGER) AS step, {_r('x * (0.9 + 0.05 * k)')} AS x, {_r('y / sqrt(0.9 + 0.05 * k)')} AS y, {_r('z / sqrt(0.9 + 0.05 * k)')} AS z FROM a, (SELECT unnest(range(5)) AS k) s")
def isovolumetric_strain(spark, d):
    return rounded(generators.uniaxial(atoms(spark, d), "x", 0.9, 1.1, 5, keep_volume=True).select("sid", "aid", "step", "x", "y", "z"))


@query(f"WITH a AS ({_ATOMS}), m AS (SELECT a.sid, a.aid, a.x AS x0, b.x AS x1 FROM a JOIN a b ON b.sid = a.sid + 1 AND b.aid = a.aid) SELECT sid, aid, CAST(f AS INTEGER) AS frame, {_r('x0 + f / 4.0 * (x1 - x0)')} AS x FROM m, (SELECT unnest(range(5)) AS f) s")
def interpolate(spark, d):
    a = atoms(spark, d)
    return rounded(generators.interpolate(a, a.withColumn("sid", F.col("sid") - 1), 3).select("sid", "aid", "frame", "x"))


@query()
def random_displacements(spark, d):
    return generators.random_displacements(atoms(spark, d), 0.1, 2, 7)


@query()
def kabsch(spark, d):
    turned = S.rotation((1.0, 1.0, 0.0), 30.0)
    a = atoms(spark, d)
    ref = generators.rotate(a, turned).select("sid", "aid", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    return generators.kabsch(a.join(ref, ["sid", "aid"]))


# Identifiers, formulas, lists, set operations


@query("SELECT doc_id, coalesce(nullif(source, ''), 'structure_' || lpad(CAST(doc_id AS VARCHAR), 6, '0')) || '#frame=' || doc_id % 3 AS name FROM documents")
def identifier_coalesce(spark, d):
    return sets.identifier(table(spark, d, "documents"), ["source"], "doc_id", F.col("doc_id") % 3).select("doc_id", "name")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_names(spark, d):
    return sets.repeated_names(table(spark, d, "documents"), "source")


@query("SELECT d.doc_id, l.toxic IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def labelled_structures(spark, d):
    return sets.labelled(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "toxic").select("doc_id", "labelled")


@query("SELECT f AS formula, s AS species, CAST(n AS INTEGER) AS count FROM (VALUES ('TiO2','O',2), ('TiO2','Ti',1), ('LiFePO4','Fe',1), ('LiFePO4','Li',1), ('LiFePO4','O',4), ('LiFePO4','P',1), ('CH3CH3','C',2), ('CH3CH3','H',6)) t(f, s, n)")
def formula_parse(spark, d):
    rows = spark.createDataFrame([("TiO2",), ("LiFePO4",), ("CH3CH3",)], "formula string")
    return rows.select("formula", F.explode(S.rows_of_formula(F.col("formula"))).alias("e")).select("formula", F.col("e.species").alias("species"), F.col("e.count").alias("count"))


@query("SELECT t, CAST(v AS INTEGER) AS v FROM (VALUES ('1,3:5', 1), ('1,3:5', 3), ('1,3:5', 4), ('1,3:5', 5), ('7', 7)) x(t, v)")
def csv_range_expand(spark, d):
    return spark.createDataFrame([("1,3:5",), ("7",)], "t string").select("t", F.explode(S.range_list(F.col("t"))).alias("v"))


@query("SELECT event_type AS species, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("species")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query(f"WITH a AS ({_ATOMS}), u AS (SELECT sid, aid FROM a UNION ALL SELECT sid, aid + 100 FROM a WHERE species = 'R') SELECT sid, count(*) AS n, CAST(max(aid) AS BIGINT) AS top FROM u GROUP BY sid")
def merge_atoms(spark, d):
    a = atoms(spark, d)
    both = sets.merge(a.select("sid", "aid"), a.where("species = 'R'").select("sid", "aid"), ("sid",), offset=100)
    return both.groupBy("sid").agg(F.count("*").alias("n"), F.max("aid").cast("long").alias("top"))


@query(f"WITH a AS ({_ATOMS}) SELECT sid, aid, CAST(row_number() OVER (PARTITION BY sid ORDER BY aid) AS INTEGER) AS new_aid FROM a WHERE aid NOT IN (1, 3)")
def remove_atoms(spark, d):
    return sets.remove_atoms(atoms(spark, d), [1, 3], start=1).select("sid", "aid", "new_aid")


@query(f"WITH a AS ({_ATOMS}) SELECT sid, aid, CAST(row_number() OVER (PARTITION BY sid ORDER BY species, z DESC, aid) AS INTEGER) AS place FROM a")
def sort_atoms(spark, d):
    return sets.sort_atoms(atoms(spark, d)).select("sid", "aid", "place")


@query(f"SELECT sid, {_r('avg(x)')} AS x, {_r('avg(y)')} AS y, {_r('avg(z)')} AS z FROM ({_ATOMS}) GROUP BY sid")
def geometric_centre(spark, d):
    return rounded(generators.centre(atoms(spark, d)))


@query(f"WITH a AS ({_ATOMS}) SELECT p.sid, {_r('max(sqrt(pow(p.x-q.x,2) + pow(p.y-q.y,2) + pow(p.z-q.z,2)))')} AS diameter FROM a p JOIN a q ON p.sid = q.sid AND p.aid < q.aid GROUP BY p.sid")
def diameter(spark, d):
    # The SQL has no row for a structure whose atoms have one number.
    several = atoms(spark, d).groupBy("sid").agg((F.min("aid") < F.max("aid")).alias("more")).where("more").select("sid")
    return rounded(geometry.diameter(atoms(spark, d)).join(several, "sid"))


@query(f"WITH b AS (SELECT user_id, event_type, sqrt(avg(value * value)) AS rmse, avg(abs(value)) AS mae FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type) SELECT user_id, {_r('avg(rmse)')} AS rmse, {_r('avg(mae)')} AS mae FROM b GROUP BY user_id")
def epoch_metrics(spark, d):
    return rounded(training.epoch_metrics(table(spark, d, "events"), "user_id", "event_type", "value").select("user_id", "rmse", "mae"))


# Networks


def _networks(n: int) -> dict:
    import numpy as np

    r = np.random.default_rng(0)
    return {s: [(r.normal(size=(n, 5)), r.normal(size=5), "tanh"), (r.normal(size=(5, 1)), r.normal(size=1), "linear")] for s in SPINS}


def _with_energies(spark, d):
    from ..operators import network

    a = atoms(spark, d).dropDuplicates(["sid", "aid"])
    found = spatial.edges(a, CUTOFF)
    return network.atom_energies(spatial.descriptors(a, found, 8.0, 2, 8.0, 1, SPINS, 0.01), _networks(10)), found


@query()
def network_energies(spark, d):
    from ..operators import network

    return network.energies(_with_energies(spark, d)[0])


@query()
def network_forces(spark, d):
    from ..operators import network

    # One atom of each number, from rows that are dealt by structure once.
    a = atoms(spark, d).repartition("sid").dropDuplicates(["sid", "aid"])
    return network.structure_forces(a, _networks(10), SPINS, (8.0, 2, 8.0, 1), 0.01)
