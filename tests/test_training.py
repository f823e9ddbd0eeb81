import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomspan.operators import network, spatial, training

ATOM = "sid int, aid int, species string, x double, y double, z double"
SPINS, SETTINGS = {"A": -1, "B": 1}, (4.0, 2, 3.5, 2)
N = 2 * (SETTINGS[1] + SETTINGS[3] + 2)


def table(spark, n=12, forces=True, seed=4):
    """Structures labelled by a network that is to be found again."""
    rng = np.random.default_rng(seed)
    base = np.array([[0, 0, 0], [1.5, 0.2, 0.1], [0.3, 1.7, -0.2], [-0.9, 0.6, 1.3]])
    rows = [(k, i, "AABA"[i], *map(float, p)) for k in range(n) for i, p in enumerate(base + rng.normal(0, 0.15, base.shape))]
    atoms = spark.createDataFrame(rows, ATOM)
    full, found = spatial.describe(atoms, SPINS, SETTINGS)
    full = full.persist()
    truth = training.build(["A", "B"], N, [(4, "tanh")], seed=1)
    labelled = network.atom_energies(full, truth)
    grads = network.gradients(found, *SETTINGS, SPINS).persist()
    energies = network.energies(labelled).select("sid", "energy")
    if not forces:
        return training.training_table(energies, full), truth
    pulled = network.forces(labelled, grads)
    return training.training_table(energies, full.join(pulled, ["sid", "aid"]), grads).persist(), truth


def test_gradients_equal_finite_differences(spark):
    rows, _ = table(spark, 3)
    model = training.build(["A", "B"], N, [(3, "tanh"), (3, "sigmoid")], seed=8)
    for alpha in (0.0, 0.4, 1.0):
        e, f, loss, grad = training.batch_losses(rows, model, 2.0, 0.3, alpha)
        x = training.flatten(model)
        data = [r.asDict() for r in rows.collect()]

        def value(v, alpha=alpha):
            parts = [training.structure_losses(training.restore(model, v), r, 2.0, 0.3, alpha > 0)[:3] for r in data]
            n, m = len(parts), sum(p[2] for p in parts)
            return (1 - alpha) * math.sqrt(sum(p[0] for p in parts) / n) + (alpha * math.sqrt(sum(p[1] for p in parts) / m) if m else 0.0)

        assert value(x) == pytest.approx(loss)
        for k in np.random.default_rng(0).choice(len(x), 15, replace=False):
            up, down = x.copy(), x.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert grad[k] == pytest.approx((value(up) - value(down)) / 2e-5, rel=1e-4, abs=1e-7)


def test_losses_are_those_of_the_predictions(spark):
    rows, truth = table(spark, 4)
    e, f, loss, grad = training.batch_losses(rows, truth, alpha=0.5)
    assert e < 1e-9 and f < 1e-6
    sets = spark.createDataFrame([(2.0, 2, 5.0), (1.0, 1, 3.0)], "energy double, n_atoms int, reference double")
    assert training.energy_loss(sets, 0.5, 1.0).first().loss == pytest.approx(math.sqrt((0.5**2 + 0.0) / 2))
    forced = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 2.0), (5.0, 5.0, 5.0, None, None, None)], "fx double, fy double, fz double, rx double, ry double, rz double")
    r = training.force_loss(forced).first()
    assert r.n == 3 and r.loss == pytest.approx(math.sqrt(5 / 3))
    assert training.combined_loss(2.0, 4.0, 0.25) == 2.5
    with pytest.raises(ValueError):
        training.combined_loss(1, 1, 2)


def test_training_lowers_the_loss(spark):
    rows, _ = table(spark, 10)
    start = training.build(["A", "B"], N, [(4, "tanh")], seed=3)
    seen = []
    settings = training.Settings(epochs=8, alpha=0.3, plateau=training.Plateau(0, 0.5), seed=1)
    model, history = training.train(rows, start, training.optimiser("adam", rate=0.03), settings, test=rows.limit(3), after=lambda m, h: seen.append(h["epoch"]))
    assert seen == list(range(8)) and history[-1]["train_energy_rmse"] < 0.5 * history[0]["train_energy_rmse"]
    assert history[-1]["train_force_rmse"] < history[0]["train_force_rmse"] and "test_energy_rmse" in history[0]
    text = training.to_json(model, epoch=7)
    again, state = training.from_json(text)
    assert (training.flatten(again) == training.flatten(model)).all() and training.first_epoch(state) == 8
    resumed, more = training.train(rows, again, training.optimiser("sgd", rate=0.001), training.Settings(epochs=1, batches=3, start=8, alpha=0.3, force_fraction=0.5, resample_every=1, history=history))
    assert [h["epoch"] for h in more] == list(range(9))
    frame = training.history_frame(spark, more)
    assert frame.count() == 9 and math.isnan(frame.where("epoch = 8").first()["test_energy_rmse"])
    assert training.history_frame(spark, {"a": [1.0, 2.0], "b": [3.0]}).orderBy("epoch").collect()[1]["a"] == 2.0


def test_samplers(spark):
    rows = spark.range(2000).select(F.col("id").alias("sid"), F.when(F.col("id") < 1000, 0.0).otherwise(1.0).alias("energy"))
    drawn = training.sampler("energy_weighted", rows, 30000, 1)
    low, high = (drawn.where(c).agg(F.sum("draws")).first()[0] for c in ("energy = 0", "energy = 1"))
    assert low + high == 30000 and low / high == pytest.approx(2, rel=0.1)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, training.sampler("energy_weighted", rows.repartition(5), 30000, 1).collect()))
    errors = rows.where("sid < 10").select("sid", F.lit(1.0).alias("error"))
    hit = training.sampler("error_weighted", rows, 1000, 2, errors)
    assert hit.where("sid >= 10").agg(F.sum("draws")).first()[0] in (None, 0)
    assert training.sampler("error_weighted", rows, 5, 1).where("draws != 1").count() == 0
    with pytest.raises(ValueError):
        training.sampler("best", rows, 5, 1)
    assert training.draw(rows.withColumn("weight", F.lit(0.0)), 5, 1).count() == 0
    assert [training.subset_size(n, f, m) for n, f, m in ((10, 0.35, 1), (10, 0.0, 2), (1, 0.5, 3))] == [3, 2, 1]
    assert training.sample_fraction(rows, 0.0101, 3).count() == 21


def test_rates_and_checkpoints(spark):
    p = training.Plateau(1, 0.1)
    rates = [r := 1.0] + [r := p.rate(m, r) for m in (5, 4, 4, 4, 4, 3)]
    assert rates == pytest.approx([1, 1, 1, 1, 0.1, 0.1, 0.1])
    assert [training.resamples(e, 3, 2) for e in range(3, 7)] == [True, False, True, False] and not training.resamples(0, 0, 0)
    assert [training.first_epoch(None, n) for n in ("x/model-0012.json", "model.json", "")] == [13, 0, 0]
    files = spark.createDataFrame([("m-10",), ("m-9",), ("m-11",)], "name string")
    assert {r.name for r in training.last_checkpoints(files, 2).where("keep").collect()} == {"m-9", "m-11"}
    with pytest.raises(ValueError):
        training.optimiser("lion")
    with pytest.raises(ValueError):
        training.build(["A"], 2, [(3, "cosine")])
    x = np.array([1.0, -2.0])
    sgd, adam = training.optimiser("SGD", rate=0.1, momentum=0.5), training.optimiser("Adam", rate=0.1)
    y = sgd.step(sgd.step(x, x), x)
    assert y == pytest.approx(x - 0.1 * x - 0.15 * x) and adam.step(x, x) == pytest.approx(x - 0.1 * np.sign(x))


def test_predictions_add_up_and_equal_the_network_by_hand(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(4, 3))
    atoms = spark.createDataFrame([(1, i, "AABB"[i], *map(float, v)) for i, v in enumerate(p)], ATOM)
    model = training.build(["A", "B"], N, [(3, "tanh")], seed=2)
    full, found = spatial.describe(atoms, SPINS, SETTINGS)
    refs = {"A": -10.0, "B": 5.0}
    whole, each = network.predict(atoms, found, model, SPINS, SETTINGS, refs, 4.0, 0.25)
    g = {r.aid: (r.species, np.array(r.fingerprint)) for r in full.collect()}
    want = {}
    for i, (s, x) in g.items():
        (w, b, _), (v, c, _) = model[s]
        want[i] = (np.tanh(x @ w + b) @ v + c)[0] / 4.0 + 0.25 + refs[s]
    rows = each.collect()
    assert {r.aid: r.e_atom for r in rows} == pytest.approx(want)
    r = whole.first()
    assert r.energy == pytest.approx(sum(want.values())) and r.cohesive == pytest.approx(sum(want.values()) - 2 * (-10 + 5)) and r.n_atoms == 4
    assert np.abs(np.array([[x.fx, x.fy, x.fz] for x in rows]).sum(0)).max() < 1e-9


def test_descriptor_objects(spark):
    from atomspan.operators.descriptor import Chebyshev

    d = Chebyshev(("A", "B"), *SETTINGS)
    atoms = spark.createDataFrame([(1, 0, "A", 0.0, 0.0, 0.0), (1, 1, "B", 1.0, 0.5, 0.0), (1, 2, "A", 0.0, 1.0, 0.7)], ATOM)
    rows = d.features(atoms).collect()
    assert {len(r.fingerprint) for r in rows} == {d.n_features} == {N} and Chebyshev(("A",), 3.0, 1, 3.0, 1).n_features == 4
    again = Chebyshev.restore(d.manifest())
    assert again == d and again.spins == SPINS
    full, found = d.with_edges(atoms)
    assert full.count() == 3 and d.gradients(found).select("f").distinct().count() == N
    for bad in ((("A", "A"), 3.0, 1, 3.0, 1), ((), 3.0, 1, 3.0, 1), (("A",), 3.0, 1, 3.0, 1, 3.0), (("A",), 3.0, -1, 3.0, 1)):
        with pytest.raises(ValueError):
            Chebyshev(*bad)
    with pytest.raises(ValueError):
        Chebyshev.restore('{"kind":"other"}')


def test_best_epochs_of_equal_values_go_by_run(spark):
    rows = [(run, epoch, float(epoch % 2)) for run in range(40, 0, -1) for epoch in (4, 3, 2)]
    best = training.best_epochs(spark.createDataFrame(rows, "run long, epoch int, rmse_test double"), 43).collect()
    assert [(r.run, r.epoch) for r in best] == [(run, 2) for run in range(1, 41)] + [(run, 4) for run in range(1, 4)]
    plain = training.best_epochs(spark.createDataFrame([(e, v) for _, e, v in rows[:3]], "epoch int, rmse_test double"), 2)
    assert [r.epoch for r in plain.collect()] == [2, 4]
