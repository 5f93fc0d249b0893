"""Studies with more samples than markers: vectors by marker, rows of samples in tasks only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from densitylab.functions import linear
from densitylab.operators import diagnostics, folds, kernel, primal, qc
from densitylab.operators.stage import Stage
from densitylab.plans import study as plans
from densitylab.plans.study import DensityConfig, LadderConfig, Study, run_densities, run_encodings, run_ladder


def wide(spark, samples, markers=6, missing=False):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (samples, markers))
    y = x[:, 1] - x[:, 4] + rng.normal(size=samples) * 0.5
    gone = rng.random(x.shape) < (0.02 if missing else 0)
    vec = spark.createDataFrame([(j, [None if g else int(v) for v, g in zip(c, m)]) for j, (c, m) in enumerate(zip(x.T, gone.T))], "marker_idx int, g array<tinyint>").repartition(3).cache()
    var = spark.createDataFrame([(j, str(j // 10 + 1), (j % 10 + 1) * 1000, "A", "G", f"{j}") for j in range(markers)], "marker_idx int, chrom string, pos bigint, ref string, alt string, marker_id string").cache()
    return Study([f"s{i:05d}" for i in range(samples)], y, vec, var, [f"g{i % 40:02d}" for i in range(samples)])


def densities(s):
    outer = np.arange(len(s.ids)) % 2
    inner = np.arange(len(s.ids)) // 2 % 2
    return run_densities(s, DensityConfig(densities=(3, "all"), alphas=(0.1, 1.0), min_call_rate=0.9), outer, {0: inner, 1: inner})


def ladder(s):
    return run_ladder(s, LadderConfig(inner_folds=2, budgets=(3, 6), rhos=(0.01, 0.1), rho_bounds=(0.01, 0.1), call_rate_min=0.9, bin_bp=3000, ld_window_bp=2000, ld_r2=0.1), np.arange(len(s.ids)) % 40 % 2)


def encodings(s):
    return run_encodings(s, np.arange(len(s.ids)) % 2, 2, rhos=(0.01, 0.1), bounds=(0.001, 1.0))


RUNS = {"densities": (densities, ("density",)), "ladder": (ladder, ("strategy", "budget")), "encodings": (encodings, ("model",))}


@pytest.mark.parametrize("kind", RUNS)
def test_vectors_of_either_side_give_the_same(spark, monkeypatch, kind):
    run, keys = RUNS[kind]
    monkeypatch.setattr(primal, "LEAST", 7)  # several blocks
    monkeypatch.setattr(kernel, "ROWS_BYTES", 8 * 5 * 12)  # several steps in a block
    found = []
    for side in (plans.load_blocks, plans.load_strips):
        monkeypatch.setattr(plans, "load", side)
        r = run(wide(spark, 150, missing=kind != "encodings"))
        found.append(({tuple(p[k] for k in ("sample_id", *keys)): p.prediction for p in r["predictions"].collect()}, {(t.fold, t.workflow): (t.penalty, pytest.approx(t.inner_mse, rel=1e-7)) for t in r["tuning"].collect()}))
    (a, chosen), (b, other) = found
    assert a.keys() == b.keys() and len(a) == 150 * {"densities": 2, "ladder": 4, "encodings": 2}[kind]
    assert chosen == other and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def results(spark, run):
    """Bytes that tasks of ``run`` send to the driver."""
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    sums = lambda: sum(stages.apply(i).resultSize() for stages in [store()] for i in range(stages.size()))
    before = sums()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sums() - before


@pytest.mark.parametrize("kind", RUNS)
def test_no_row_of_a_sample_comes_to_the_driver(spark, monkeypatch, kind):
    run, _ = RUNS[kind]
    lists, make = [], spark.__class__.createDataFrame
    monkeypatch.setattr(spark.__class__, "createDataFrame", lambda self, data, *a, **k: (lists.append(len(data) if isinstance(data, list) else 0), make(self, data, *a, **k))[1])
    monkeypatch.setattr(primal, "LEAST", 1 << 20)  # as many tasks for both sizes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # which would take ids and labels of a short table along
    sizes = []
    try:
        for n in (8000, 40000):
            s = wide(spark, n)
            lists.clear()
            sizes.append(results(spark, lambda: run(s)["metrics"].collect()))  # noqa: B023
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(lists) < 400 and sizes[1] < sizes[0] + 8 * 32000  # less than a number for each sample more


def test_markers_equations_give_the_weights_of_the_kernel():
    rng = np.random.default_rng(3)
    a, t = rng.normal(size=(40, 7)), rng.normal(size=40)
    t -= t.mean()
    shift = np.array([0.05, 0.5, 5.0])
    u, residuals, steps = linear.driven(linear.shifted_by_marker(a.T @ t, np.linalg.norm(t), np.trace(a.T @ a), shift, 1e-10), lambda d: a.T @ (a @ d))
    for k, c in enumerate(shift):
        w = np.linalg.solve(a @ a.T + c * np.eye(40), t)
        assert np.allclose(u[:, k], a.T @ w, atol=1e-9)
        assert residuals[k] == pytest.approx(np.linalg.norm(t - (a @ a.T + c * np.eye(40)) @ ((t - a @ u[:, k]) / c)) / np.linalg.norm(t), abs=1e-13) and residuals[k] <= 1e-10
    assert (steps > 0).all()
    none = linear.driven(linear.shifted_by_marker(np.zeros(7), 0.0, 1.0, shift), lambda d: d)
    assert not none[0].any() and none[0].shape == (7, 3)
    with pytest.raises(linear.SolverError, match="positive"):
        linear.driven(linear.shifted_by_marker(np.ones(7), 1.0, 1.0, np.array([0.0])), lambda d: d)


def test_fits_by_position_equal_those_by_id():
    rng = np.random.default_rng(2)
    ids = [f"s{i}" for i in rng.permutation(30)]
    outer = {s: int(f) for s, f in zip(ids[:25], rng.integers(1, 4, 25))}
    inner = {f: {s: i % 2 for i, s in enumerate(ids[:25]) if outer[s] != f} for f in (1, 2, 3)}
    at = {s: i for i, s in enumerate(ids)}
    for only in (None, [2]):
        want = [(f, [at[s] for s in a], [at[s] for s in b]) for f, a, b in folds.fit_table(outer, inner, only)]
        got = folds.fit_positions(np.argsort(np.array(ids)), folds.codes(ids, outer), {f: folds.codes(ids, own) for f, own in inner.items()}, only)
        assert [(f, a.tolist(), b.tolist()) for f, a, b in got] == want
    with pytest.raises(KeyError):
        folds.codes(ids, {"nobody": 1})


@pytest.mark.parametrize(("markers", "most"), [(31, 9), (31, 99), (100, 9)])  # parts of the samples, all of them picked, and more tiles than cores
def test_diagnostics_by_marker_equal_those_of_tiles_of_samples(spark, monkeypatch, markers, most):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 3, (markers, 60))
    vec = spark.createDataFrame([(j, [None if v < 0 else int(v) for v in row]) for j, row in enumerate(x)], "marker_idx int, g array<tinyint>").repartition(3)
    fits = [kernel.Fit("outer/0", tuple(range(45)), tuple(range(45, 60))), kernel.Fit("outer/1", tuple(range(9, 60)), tuple(range(9)))]
    own = qc.fit_eligible(vec, {f.fit_id: f.train for f in fits}, 0.5, 0.0).select("fit_id", "marker_idx", "mean", F.when(F.col("marker_idx") % 5 == 0, 2.0).otherwise(1.0).alias("scale"), (F.col("marker_idx") % 2).alias("tier"))
    stats = own.unionAll(own.filter("marker_idx % 3 = 0").withColumn("tier", F.lit(7)))  # some markers have two tiers
    sums = {"half": [0], "other": [7], "all": [0, 1]}
    monkeypatch.setattr(kernel, "TILE_BYTES", 1000)
    monkeypatch.setattr(primal, "LEAST", 8)
    with Stage(spark) as stage:
        strips = stage.put(kernel.loaded(vec, stats, fits), "strips")
        columns = primal.Columns(stats, fits)
        blocks = stage.put(primal.cut(vec, columns.markers, fits, np.zeros(60)), "blocks")
        want = {(r.fit, r.workflow): r for r in diagnostics.sums_of_tiles(strips, 60, list(enumerate(fits)), sums, "all", most).collect()}
        got = {(r.fit, r.workflow): r for r in diagnostics.sums_of_markers(blocks, columns, list(enumerate(fits)), sums, "all", most).collect()}
        assert got.keys() == want.keys() and len(got) == 6
        assert all(got[k][2:] == pytest.approx(want[k][2:], rel=1e-9, abs=1e-7) for k in want)
        near = diagnostics.relationship_by_marker(blocks, columns, list(enumerate(fits)), sums, "all", most).collect()
        assert {(r.fit_id, r.workflow) for r in near} == {(f.fit_id, w) for f in fits for w in sums}
