"""Statistics, orders, folds, kernels, solvers and metrics on hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from densitylab.cli import executors
from densitylab.functions import linear
from densitylab.operators import clones, compare, diagnostics, folds, kernel, ld, metrics, ordering, qc, validate
from densitylab.operators.stage import Stage


def long(spark, x, rows):
    return spark.createDataFrame([(int(i), j, None if np.isnan(x[i][j]) else int(x[i][j])) for i in rows for j in range(len(x[0]))], "sample_idx int, marker_idx int, g int")


def vec(spark, x):
    return spark.createDataFrame([(j, [None if np.isnan(v) else int(v) for v in col]) for j, col in enumerate(np.asarray(x, float).T)], "marker_idx int, g array<tinyint>")


X1 = [[0, 0, 0], [2, 0, np.nan], [0, 0, 2], [2, 2, 0]]


def test_statistics_come_from_training_rows(spark):
    got = {r.marker_idx: r for r in qc.eligible(long(spark, X1, [0, 1, 2]), 0.5, 0.05).collect()}
    assert set(got) == {0, 2}
    assert got[0].mean == pytest.approx(2 / 3) and got[2].p == 0.5 and got[2].call_rate == pytest.approx(2 / 3) and got[0].mac == 2
    inside = {r.marker_idx: r.mean for r in qc.vec_eligible(vec(spark, X1), [0, 1, 2], 0.5, 0.05).collect()}
    assert inside == {m: pytest.approx(r.mean) for m, r in got.items()}


def test_heterozygous_marker_differs_between_filters(spark):
    x = [[1], [1], [1], [1]]
    assert qc.eligible(long(spark, x, range(4))).count() == 1
    assert not qc.varying(long(spark, x, range(4))).first().keep


def test_missing_in_counts_and_scaler(spark):
    x = [[0, 0], [1, 1], [2, np.nan], [0, 2]]
    got = {r.marker_idx: r for r in qc.eligible(long(spark, x, range(4)), 0, 0).collect()}
    assert [got[i].mean for i in (0, 1)] == [0.75, 1.0] and [got[i].mac for i in (0, 1)] == [3, 3]
    s = {r.marker_idx: r for r in qc.scaler(long(spark, [[1, 3], [2, 3], [3, 3]], range(3))).collect()}
    assert s[0].scale == pytest.approx(np.sqrt(2 / 3)) and s[1].scale == 1


def test_hash_order_is_stable_and_nested(spark):
    rows = [(i, f"1:{i + 1}:A:G") for i in range(10)]
    a = {r.marker_idx: r["rank"] for r in ordering.hash_order(spark.createDataFrame(rows, "marker_idx int, marker_id string"), "a").collect()}
    b = {r.marker_idx: r["rank"] for r in ordering.hash_order(spark.createDataFrame(rows[::-1], "marker_idx int, marker_id string"), "a").collect()}
    assert a == b and sorted(a.values()) == list(range(10))
    order = ordering.hash_order(spark.createDataFrame(rows, "marker_idx int, marker_id string"), "a")
    stats = spark.createDataFrame([(i, 0.5) for i in range(10) if i % 2], "marker_idx int, mean double")
    small, large = ordering.panel(order, stats, 2), ordering.panel(order, stats, 4)
    assert small.join(large, "marker_idx", "left_anti").isEmpty() and small.count() == 2
    with pytest.raises(validate.ContractError):
        ordering.panel(order, stats, 0)


def test_availability():
    assert ordering.availability(5, 8, True) == (None, False)
    assert ordering.availability(5, 8, False) == (5, True)
    assert ordering.availability(5, "all", True) == (5, False)


def test_cover_equals_one_after_another(spark):
    r = np.random.default_rng(1)
    nodes, edges, want = [], [], set()
    for fit, (n, m) in enumerate(((1, 0), (12, 10), (40, 60), (40, 200), (60, 59))):
        ids, rank = r.permutation(1000)[:n], r.permutation(n)
        pairs = sorted({tuple(sorted(p)) for p in r.integers(0, n, (m, 2)).tolist() if p[0] != p[1]})
        if fit == 4:
            pairs = [(i, i + 1) for i in range(n - 1)]  # a chain
        left = set(range(n))
        while left:
            near = {i: {x + y - i for x, y in pairs if i in (x, y) and x + y - i in left} for i in left}
            i = min(left, key=lambda v: (-len(near[v]), rank[v]))
            want.add((f"f{fit}", int(ids[i])))
            left -= near[i] | {i}
        nodes += [(f"f{fit}", int(x), int(k)) for x, k in zip(ids, rank)]
        edges += [(f"f{fit}", int(ids[x]), int(ids[y]), 0.9) for x, y in pairs] + [(f"f{fit}", int(ids[x]), int(ids[y]), 0.1) for x, y in zip(r.integers(0, n, 5), r.integers(0, n, 5))]
    kept = spark.createDataFrame([(f, x) for f, x, _ in nodes], "fit_id string, marker_idx int")
    variants = kept.select("marker_idx").distinct()
    r2 = spark.createDataFrame(edges, "fit_id string, a int, b int, r2 double")
    got = set()
    for fit in range(5):
        order = spark.createDataFrame([(x, k) for f, x, k in nodes if f == f"f{fit}"], "marker_idx int, rank int")
        own = ld.greedy_cover(variants, kept.filter(F.col("fit_id") == f"f{fit}"), order, r2.filter(F.col("fit_id") == f"f{fit}"), 0.5, Stage(spark))
        got |= {tuple(x) for x in own.select("fit_id", "marker_idx").collect()}
    assert got == want


def test_folds(spark):
    s = spark.createDataFrame([(i,) for i in "zaqbvn"], "sample_id string")
    t = spark.createDataFrame([(i,) for i in "nvbqaz"], "sample_id string")
    d = lambda f: {r.sample_id: r.fold for r in f.collect()}
    assert d(folds.random_folds(s, 3, 9)) == d(folds.random_folds(t, 3, 9))
    assert d(folds.hashed_folds(s, 3, 9)) == d(folds.hashed_folds(t, 3, 9))
    groups = ["a"] * 70 + ["b"] * 12 + [f"s{i}" for i in range(50)]
    g = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(groups)], "sample_id string, group_id string")
    got = d(folds.balanced_groups(g, 4, 101, "full"))
    assert [got[f"i{k}"] for k in range(len(groups))] == folds.balanced_groups_local(groups, 4, 101, "full").tolist()
    with pytest.raises(validate.ContractError):
        folds.group_out(spark.createDataFrame([("a", "x"), ("b", "x")], "sample_id string, group_id string"))


def ridge(spark, missing=True):
    """Genotypes with missing calls, two fits of two tiers each, and dense kernels to compare with."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (24, 31)).astype(float)
    if missing:
        x[0, :3], x[20, 5] = np.nan, np.nan
    fits = [kernel.Fit("outer/0", tuple(range(17)), tuple(range(17, 24))), kernel.Fit("outer/1", tuple(range(5, 24)), tuple(range(5)))]
    stats = qc.fit_eligible(vec(spark, x), {f.fit_id: f.train for f in fits}, 0.5, 0.0)
    stats = stats.select("fit_id", "marker_idx", "mean", F.when(F.col("marker_idx") % 5 == 0, 2.0).otherwise(1.0).alias("scale"), (F.col("marker_idx") % 2).alias("tier"))
    rows, dense = stats.collect(), {}
    for f in fits:
        for name, tiers in (("half", [0]), ("all", [0, 1])):
            own = sorted((r for r in rows if r.fit_id == f.fit_id and r.tier in tiers), key=lambda r: r.marker_idx)
            z = np.nan_to_num((x[:, [r.marker_idx for r in own]] - [r.mean for r in own]) / [r.scale for r in own])
            dense[f.fit_id, name] = z @ z.T
    return x, fits, stats, dense


SUMS = {"half": [0], "all": [0, 1]}


@pytest.mark.parametrize(("strip", "slab"), [(4 << 20, 32 << 20), (24 * 7, 24 * 8 * 3)])
def test_products_need_no_kernel(spark, monkeypatch, strip, slab):
    monkeypatch.setattr(kernel, "STRIP_BYTES", strip)
    monkeypatch.setattr(kernel, "SLAB_BYTES", slab)
    x, fits, stats, dense = ridge(spark)
    with Stage(spark) as stage:
        strips = stage.put(kernel.loaded(vec(spark, x).repartition(3), stats, fits), "strips")
        d = np.random.default_rng(1).normal(size=(24, 2))
        for direct in (0, 8):
            monkeypatch.setattr(kernel, "DIRECT", direct)
            for (f, name), q in zip(dense, kernel.products(strips, [kernel.System(int(f[-1]), tuple(SUMS[n]), d) for f, n in dense])):
                assert np.allclose(q, dense[f, name] @ d, atol=1e-9)
        traces = kernel.traces(strips, fits, SUMS)
        assert all(traces[f.fit_id, n] == pytest.approx(np.trace(dense[f.fit_id, n][np.ix_(f.train, f.train)])) for f in fits for n in SUMS)


def test_diagnostics_from_tiles(spark, monkeypatch):
    x, fits, stats, dense = ridge(spark)
    with Stage(spark) as stage:
        strips = stage.put(kernel.loaded(vec(spark, x), stats, fits), "strips")
        for rows in (7, 24):
            monkeypatch.setattr(kernel, "tile_rows", lambda *_: rows)  # noqa: B023
            got = {(r.fit_id, r.workflow): r for r in diagnostics.relationship(strips, 24, list(enumerate(fits)), SUMS, "all", most=9).collect()}
            for f in fits:
                unit = {}
                for n in SUMS:
                    k = dense[f.fit_id, n][np.ix_(f.train, f.train)]
                    unit[n] = k / (np.trace(k) / len(k))
                pick = np.linspace(0, len(f.train) - 1, 9).astype(int)
                cut = {n: k[np.ix_(pick, pick)] for n, k in unit.items()}
                off = ~np.eye(9, dtype=bool)
                for n in SUMS:
                    r = got[f.fit_id, n]
                    assert r.trace_participation_ratio == pytest.approx(len(f.train) ** 2 / (unit[n] ** 2).sum()) and r.samples == 9
                    assert r.sampled_relative_frobenius == pytest.approx(np.linalg.norm(cut[n] - cut["all"]) / np.linalg.norm(cut["all"]), abs=1e-7)
                    assert r.sampled_offdiagonal_correlation == pytest.approx(np.corrcoef(cut[n][off], cut["all"][off])[0, 1])


def shuffled(spark, df):
    """Bytes that a query's exchanges write."""
    before = sum(e["shuffle_bytes"] for e in executors(spark))
    df.write.format("noop").mode("overwrite").save()
    return sum(e["shuffle_bytes"] for e in executors(spark)) - before


def test_genotypes_are_shuffled_once_for_any_number_of_fits(spark):
    rng = np.random.default_rng(3)
    g = vec(spark, rng.integers(0, 3, (2000, 60))).repartition(4)
    g.cache().count()
    moved = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # statistics this small would be broadcast
    for k in (1, 12):
        fits = [kernel.Fit(f"outer/{i}", tuple(range(i, 1900)), (1999,)) for i in range(k)]
        stats = spark.createDataFrame([(f.fit_id, m, 1.0, 1.0, 0) for f in fits for m in range(60)], "fit_id string, marker_idx int, mean double, scale double, tier int")
        moved.append(shuffled(spark, kernel.loaded(g, stats, fits)))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved[0] > 20_000 and moved[1] < 1.6 * moved[0]  # what grows are statistics, not 2000 dosages a marker
    g.unpersist()


def test_one_krylov_space_serves_all_penalties():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(40, 90))
    k, y = z @ z.T / 90, rng.normal(size=40) + 5
    counts = []
    for grid in ([1e-3], [1e-3, 1e-2, 0.1, 1.0, 10.0]):
        asked = []
        a, true, steps = linear.driven(linear.shifted(y, 40 * np.array(grid), 1e-11), lambda d: asked.append(d.shape[1]) or k @ d)  # noqa: B023
        counts.append(len(asked))
        assert asked[:-1] == [1] * (len(asked) - 1) and asked[-1] == len(grid) and true.max() <= 1e-11 and steps[0] == len(asked) - 1
        for rho, w in zip(grid, a.T):
            assert np.allclose(y.mean() + k @ w, linear.dual_ridge(k, k, y, 40 * rho), atol=1e-9)
    assert counts[0] == counts[1]
    assert linear.driven(linear.shifted(np.ones(5), np.array([1.0])), lambda d: d)[2].tolist() == [0]
    with pytest.raises(linear.SolverError):
        linear.dual_ridge(k, k, y, 0.0)
    with pytest.raises(linear.SolverError):
        linear.driven(linear.shifted(y, np.array([1e-3]), most=2), lambda d: k @ d)
    assert np.allclose(linear.dual_ridge(k / 3, k / 3, y, 0.7), linear.primal_ridge(z / np.sqrt(90), z / np.sqrt(90), y, 0.7, 3.0))
    assert linear.jittered_cholesky(np.ones((3, 3)))[1] > 0


def test_scores_in_degenerate_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 1.0), (4.0, 3.0, 2.0)], "y double, prediction double, train_mean double")
    s = metrics.scores(df).first()
    assert s.n == 3 and s.rmse == pytest.approx(1.0) and s.q2_train_mean == pytest.approx(1 - 3 / 5)
    flat = metrics.scores(df.withColumn("prediction", F.lit(1.0))).first()
    assert flat.pcc is None and metrics.scores(df.withColumn("train_mean", F.col("y"))).first().q2_train_mean is None


def test_best_penalty_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([("w", 0, 0.1, 5.0, 10), ("w", 1, 1.0, 3.0, 10), ("w", 2, 10.0, 3.0, 10)], "w string, penalty_idx int, penalty double, sse double, n int")
    b = metrics.best_penalty(df, "w").first()
    assert (b.penalty, b.inner_mse, b.boundary) == (1.0, 0.3, False)


def test_bootstrap_equals_numpy(spark):
    assert compare.pairs(spark, [1, 2, 3, 4, 5]).count() == 14
    rng = np.random.default_rng(0)
    rows = [(0, f, f"g{f}{i}", float(d), float(b), int(n)) for f in range(2) for i, (d, b, n) in enumerate(zip(rng.normal(size=4), rng.uniform(1, 2, 4), rng.integers(1, 5, 4)))]
    sums = spark.createDataFrame(rows, "pair int, fold int, group_id string, d double, b double, n bigint")
    got = compare.bootstrap(compare.seeded_replicates(sums, 1, 40, 3, batch=7)).first()
    names = sorted(r[2] for r in rows)
    by = {r[2]: r for r in rows}
    r2 = np.random.default_rng(3)
    strata = [np.array([names.index(x[2]) for x in rows if x[1] == f]) for f in range(2)]
    want = []
    for _ in range(40):
        own = [by[names[i]] for s in strata for i in r2.choice(np.sort(s), len(s), replace=True)]
        want.append(sum(x[3] for x in own) / sum(x[5] for x in own))
    assert np.allclose(got.delta_mse_ci95, np.quantile(want, [0.025, 0.975]))
    hashed = compare.hashed_replicates(sums, 50, 3).collect()
    for r in hashed:
        d = m = 0
        for f in range(2):
            own = sorted((x for x in rows if x[1] == f), key=lambda x: x[2])
            h = compare.mixed_number(compare.mixed_number(compare.mixed_number(3)) + f)
            for k in range(len(own)):
                x = own[compare.mixed_number(((compare.mixed_number((h + r.rep) & 0xFFFFFFFF)) + k) & 0xFFFFFFFF) % len(own)]
                d, m = d + x[3], m + x[5]
        assert r.delta_mse == pytest.approx(d / m)
    assert len(hashed) == 50


def test_contracts(spark):
    v = spark.createDataFrame([(0, "1", 5, "A", "G"), (1, "1", 3, "A", "C"), (2, "9", 4, "A", "A")], "marker_idx int, chrom string, pos bigint, ref string, alt string")
    assert [r.marker_idx for r in validate.unordered_variants(v).collect()] == [1]
    assert [r.marker_idx for r in validate.bad_variants(v).collect()] == [2]
    p = spark.createDataFrame([("a", "t", 1.0), ("a", "t", None)], "sample_id string, trait_id string, value double")
    with pytest.raises(validate.ContractError, match="Repeated phenotype"):
        validate.check_phenotypes(p)
    s = spark.createDataFrame([("a", "g", 0), ("b", "g", 1)], "sample_id string, group_id string, outer_fold int")
    with pytest.raises(validate.ContractError, match="Groups"):
        validate.check_splits(s, s)


def test_statistics_of_all_fits_at_once(spark):
    x = np.random.default_rng(5).integers(0, 3, (9, 12)).astype(float)
    x[:, 4], x[2, 1] = np.nan, np.nan
    trains = {"a": [0, 1, 2, 5], "b": list(range(9))}
    names = ("called", "rows", "total", "mean", "variance")
    got = {(r.fit_id, r.marker_idx): [r[n] for n in names] for r in qc.fit_counts(vec(spark, x), trains).collect()}
    for fit, train in trains.items():
        for r in qc.vec_counts(vec(spark, x), train).collect():
            one, other = got[fit, r.marker_idx], [r[n] for n in names]
            assert [v is None for v in one] == [v is None for v in other]
            assert np.allclose([v or 0 for v in one], [v or 0 for v in other])


def test_window_r2_equals_the_join(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (20, 30)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    v = spark.createDataFrame([(i, "12"[i % 2], int(p)) for i, p in enumerate(rng.integers(1, 400, 30))], "marker_idx int, chrom string, pos bigint")
    train = [0, 3, 4, 8, 9, 12, 17, 19]
    kept = qc.vec_counts(vec(spark, x), train).filter("variance > 0 and marker_idx <> 7")
    at, own = {r.marker_idx: (r.chrom, r.pos) for r in v.collect()}, x[train]
    z = np.nan_to_num(own - np.nanmean(own, axis=0))
    z = z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)
    held = sorted(r.marker_idx for r in kept.collect())
    for window, depth in ((1, 3), (60, 3), (1000, 4), (1000, 256)):
        want = {(a, b): (z[:, a] @ z[:, b]) ** 2 for a in held for b in held if at[a][0] == at[b][0] and 0 < at[b][1] - at[a][1] <= window}
        rows = ld.window_r2(vec(spark, x), v, kept.select(F.lit("f").alias("fit_id"), "marker_idx"), {"f": train, "none": [1, 2]}, window, depth=depth).collect()
        got = {(r.a, r.b): r.r2 for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_dense_bin_is_cut_into_tiles(spark):
    rows = [(i, "1", 1000 * i) for i in range(20)] + [(100 + i, "1", 5000 + i) for i in range(1, 500)]
    v = spark.createDataFrame(rows, "marker_idx int, chrom string, pos bigint")
    placed, pairs = ld.tile_pairs(v, 1000, 50)
    sizes = {r.tile: r["count"] for r in placed.groupBy("tile").count().collect()}
    assert max(sizes.values()) <= 50 and sum(sizes.values()) == len(rows) and len(sizes) >= 29
    tile, held = {r.marker_idx: r.tile for r in placed.collect()}, {(r.i, r.j) for r in pairs.collect()}
    assert pairs.count() == len(held)
    for a, _, p in rows:
        for b, _, q in rows:
            if 0 < q - p <= 1000:
                assert (tile[a], tile[b]) in held


def test_near_clone_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 3, (90, 400)).astype(float)
    x[10:40] = x[10]  # clones: exact ones, a chain of near ones, and some with missing calls
    for k in range(60, 66):
        x[k + 1] = x[k]
        x[k + 1, rng.choice(400, 3, replace=False)] = (x[k + 1, 0] + 1) % 3
    x[20:25][rng.random((5, 400)) < 0.1] = np.nan
    x[89] = np.nan
    limit, up = 0.01, list(range(90))
    root = lambda i: i if up[i] == i else root(up[i])
    pairs = set()
    for i in range(90):
        for j in range(i + 1, 90):
            held = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if held.any() and np.abs(x[i, held] - x[j, held]).sum() <= 2 * limit * held.sum():
                pairs.add((i, j))
                a, b = sorted((root(i), root(j)))
                up[b] = a
    for tile in (16, 1024):
        with Stage(spark) as stage:
            found = {(r.a, r.b) for r in clones.links(vec(spark, x).repartition(5), 90, limit, tile).collect()}
            assert found <= pairs and len(found) < len(pairs)
            got = {r.node: r.block for r in clones.blocks(vec(spark, x).repartition(5), 90, stage, limit, tile).collect()}
        assert got == {i: root(i) for i in range(90)}  # every block: a recall of 1
    samples = spark.createDataFrame([(f"i{i}", f"b{got[i]}") for i in range(90)], "sample_id string, group_id string")
    fold = {r.sample_id: r.fold for r in folds.balanced_groups(samples, 4, 7, "outer").collect()}
    assert all(fold[f"i{i}"] == fold[f"i{j}"] for i, j in pairs) and len(set(fold.values())) == 4
