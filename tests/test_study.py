"""Whole studies: leakage, coverage, sources and sinks."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from densitylab import cli
from densitylab.operators import validate
from densitylab.plans import queries as q
from densitylab.operators import folds
from densitylab.plans import study as plans
from densitylab.plans.study import DensityConfig, LadderConfig, Study, run_densities, run_encodings, run_ladder
from densitylab.sources import readers, sinks


def small(spark, shift=None):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (36, 20)).astype(float)
    y = x[:, 3] - x[:, 7] + rng.normal(size=36) * 0.1
    if shift is not None:
        y = y + shift
    vec = spark.createDataFrame([(j, [int(v) for v in c]) for j, c in enumerate(x.T)], "marker_idx int, g array<tinyint>").coalesce(2).cache()
    var = spark.createDataFrame([(j, str(j // 10 + 1), (j % 10 + 1) * 1000, "A", "G", f"{j}") for j in range(20)], "marker_idx int, chrom string, pos bigint, ref string, alt string, marker_id string").cache()
    ids = [f"s{i:02d}" for i in range(36)]
    return Study(ids, y, vec, var, [f"g{i % 12}" for i in range(36)]), x


def test_held_out_labels_do_not_leak(spark):
    study, _ = small(spark)
    outer = {s: i % 2 for i, s in enumerate(study.ids)}
    inner = {f: {s: (i // 2) % 2 for i, s in enumerate(study.ids) if outer[s] != f} for f in (0, 1)}
    config = DensityConfig(densities=(6, "all"), alphas=(0.1, 1.0), min_call_rate=0.9)
    a = run_densities(study, config, outer, inner)
    moved, _ = small(spark, np.array([10000.0 if outer[s] == 0 else 0.0 for s in study.ids]))
    b = run_densities(moved, config, outer, inner)
    own = lambda r: {(x.sample_id, x.density): (x.prediction, x.alpha) for x in r["predictions"].filter("fold = 0").collect()}
    left, right = own(a), own(b)
    assert left.keys() == right.keys() and len(left) == 36
    assert all(np.allclose(left[k], right[k]) for k in left)
    assert a["metrics"].filter("fold is null and complete_oof").count() == 4
    pooled = {(r.density, r.model): r.rmse for r in a["metrics"].filter("fold is null").collect()}
    assert pooled["all", "additive_krr"] < pooled["all", "train_mean"]


def test_ladder_full_panel_is_shared(spark):
    study, _ = small(spark)
    outer = {s: int(g[1:]) % 2 for s, g in zip(study.ids, study.groups)}
    r = run_ladder(study, LadderConfig(inner_folds=2, budgets=(8, 20), rhos=(0.01, 0.1), rho_bounds=(0.01, 0.1), bin_bp=3000, ld_window_bp=2000, ld_r2=0.1), outer)
    rows = r["predictions"].collect()
    assert len(rows) == 36 * 4
    full = {s: {x.sample_id: x.prediction for x in rows if x.strategy == s and x.budget == 20} for s in ("physical", "ld")}
    assert full["physical"] == full["ld"] and len(full["ld"]) == 36
    assert {x.actual_markers for x in rows if x.budget == 8} <= set(range(1, 9))


LADDER = {"inner_folds": 2, "budgets": (8, 20), "rhos": (0.1, 1.0), "rho_bounds": (0.05, 12.0), "bin_bp": 3000, "ld_window_bp": 2000, "ld_r2": 0.1}


def chosen(r, *keys):
    return {tuple(x[k] for k in ("fold", *keys)): x.penalty for x in r["tuning"].collect()}


def test_search_equals_a_plain_loop(spark):
    study, x = small(spark)
    outer = {s: i % 3 for i, s in enumerate(study.ids)}
    bounds, r = (0.004, 7.0), run_encodings(study, outer, 2, 5, (0.1, 1.0), (0.004, 7.0))
    got = {(p.sample_id, p.model): (p.prediction, p.rho) for p in r["predictions"].collect()}
    at, grids = study.position(), {}

    def fit(train, test, model, rho):
        a, b = x[train], x[test]
        scale = a.std(0) if model == "Ridge-standardized" else np.ones(20)
        a, b = (a - a.mean(0)) / scale, (b - x[train].mean(0)) / scale
        k, level = a @ a.T, np.trace(a @ a.T) / len(train)
        y = study.y[train]
        return y.mean() + b @ a.T / level @ np.linalg.solve(k / level + len(train) * rho * np.eye(len(train)), y - y.mean())

    for f in range(3):
        train = sorted(s for s in study.ids if outer[s] != f)
        test = np.array([at[s] for s in study.ids if outer[s] == f])
        inner = folds.balanced_groups_local(train, 2, 5, f"legacy-inner:{f}")
        where, grid = np.array([at[s] for s in train]), [0.1, 1.0]
        models = ("GBLUP-centered", "Ridge-standardized")
        while True:
            sse = {m: [sum(((study.y[where[inner == i]] - fit(where[inner != i], where[inner == i], m, rho)) ** 2).sum() for i in (0, 1)) for rho in grid] for m in models}
            best = {m: int(np.argmin(v)) for m, v in sse.items()}
            low, high = 0 in best.values() and grid[0] > bounds[0], len(grid) - 1 in best.values() and grid[-1] < bounds[1]
            if not low and not high:
                break
            grid = [max(bounds[0], grid[0] / 10)] * low + grid + [min(bounds[1], grid[-1] * 10)] * high
        grids[f] = grid
        for m in models:
            for s, p in zip([s for s in study.ids if outer[s] == f], fit(where, test, m, grid[best[m]])):
                assert got[s, m] == (pytest.approx(p, abs=1e-6), pytest.approx(grid[best[m]]))
    searched = {(q.fold, q.workflow): sorted(q.grid) for q in r["search"].groupBy("fold", "workflow").agg(F.collect_list("penalty").alias("grid")).collect()}
    assert all(searched[f, m] == pytest.approx(grids[f]) for f, m in searched) and any(min(g) == bounds[0] for g in grids.values())
    records = r["fits"].collect()
    assert len(records) == 6 and all(q.residual <= 1e-8 and q.steps > 0 for q in records)


@pytest.mark.parametrize("kind", ["ladder", "encodings"])
def test_held_out_labels_change_no_search(spark, kind):
    """Labels of fold 0 move its own predictions and penalties by nothing, and a fold alone gives what it gives among others."""
    study, _ = small(spark)
    outer = {s: int(g[1:]) % 2 for s, g in zip(study.ids, study.groups)}
    moved, _ = small(spark, np.array([10000.0 * (i + 1) if outer[s] == 0 else 0.0 for i, s in enumerate(study.ids)]))
    run = (lambda s, **k: run_ladder(s, LadderConfig(**LADDER), outer, **k)) if kind == "ladder" else (lambda s, **k: run_encodings(s, outer, 2, rhos=(0.1, 1.0), bounds=(0.01, 10.0), **k))
    keys = ("strategy", "budget") if kind == "ladder" else ("model",)
    values = lambda r: {tuple(p[k] for k in ("sample_id", *keys)): p.prediction for p in r["predictions"].filter("fold = 0").collect()}
    a, b, alone = run(study), run(moved), run(study, only=[0])
    left, right, single = values(a), values(b), values(alone)
    assert left.keys() == right.keys() == single.keys() and len(left) == 18 * (4 if kind == "ladder" else 2)
    assert all(left[k] == pytest.approx(right[k], abs=1e-6) and left[k] == pytest.approx(single[k], abs=1e-9) for k in left)
    own = lambda r: {k: v for k, v in chosen(r, "workflow").items() if k[0] == 0}
    assert own(a) == own(b) == own(alone)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_plans_do_not_grow_with_folds(spark):
    study, _ = small(spark)
    found = []
    for k in (2, 3):
        outer = {s: int(g[1:]) % k for s, g in zip(study.ids, study.groups)}
        r = run_ladder(study, LadderConfig(**{**LADDER, "rho_bounds": (0.1, 1.0)}), outer)
        found.append({n: exchanges(df) for n, df in r.items()})
        assert {(x.fold, x.strategy, x.budget) for x in r["diagnostics"].collect()} == {(f, s, b) for f in range(k) for s in ("physical", "ld") for b in (8, 20)}
    assert found[0] == found[1] and max(found[0].values()) < 10


def test_batches_of_systems_give_the_same(spark, monkeypatch):
    study, _ = small(spark)
    outer = {s: int(g[1:]) % 2 for s, g in zip(study.ids, study.groups)}
    inner = {f: {s: (i // 2) % 2 for i, s in enumerate(study.ids) if outer[s] != f} for f in (0, 1)}
    density = lambda: run_densities(study, DensityConfig(densities=(6, "all"), alphas=(0.1, 1.0), min_call_rate=0.9), outer, inner)
    value = lambda r: {(p.sample_id, p.density): p.prediction for p in r["predictions"].collect()}
    first = density()
    panels = {(r.fit_id, r.density): r.n for r in first["panels"].groupBy("fit_id", "density").agg(F.count("*").alias("n")).collect()}
    assert panels["outer/0", "6"] == 6 and panels["outer/0", "all"] >= 6
    whole = value(first)
    monkeypatch.setattr(plans, "TOGETHER_BYTES", 1)
    apart = value(density())
    assert whole.keys() == apart.keys() and all(whole[k] == pytest.approx(apart[k], abs=1e-8) for k in whole)


def test_command_line(spark, tmp_path):
    assert cli.main(["demo", "--out", str(tmp_path / "d")]) == 0
    (tmp_path / "c.json").write_text(json.dumps({"densities": [16], "alphas": [0.1, 1.0], "outer_folds": 2, "inner_folds": 2, "min_call_rate": 0.9}))
    args = ["run", "--data", str(tmp_path / "d"), "--trait", "synthetic", "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "o")]
    assert cli.main(args) == 0
    assert spark.read.parquet(str(tmp_path / "o/predictions")).count() == 60
    with pytest.raises(FileExistsError):
        cli.main(args)
    (tmp_path / "m.toml").write_text("densities = [16]\nalpha_log10 = [-1, 0, 0.5, 1]\nouter_folds = 2\ninner_folds = 2\nmin_call_rate = 0.9\n")
    assert cli.main([*args[:5], "--config", str(tmp_path / "m.toml"), "--out", str(tmp_path / "m"), "--profile"]) == 0
    tuned = spark.read.parquet(str(tmp_path / "m/tuning")).collect()
    assert [r.fold for r in tuned] == [0] and 0.1 <= tuned[0].penalty <= 10 and spark.read.parquet(str(tmp_path / "m/predictions")).count() == 30
    (tmp_path / "b.json").write_text(json.dumps({"densities": [16], "alphas": [0.1], "outer_folds": 2, "inner_folds": 2, "min_call_rate": 0.9, "clone_limit": 0.2}))
    assert cli.main([*args[:5], "--config", str(tmp_path / "b.json"), "--out", str(tmp_path / "b"), "--profile", "--protocol", "clone"]) == 0
    lines = (tmp_path / "d/phenotypes.tsv").read_text().splitlines()
    (tmp_path / "d/phenotypes.tsv").write_text("\n".join([*lines, lines[-1]]) + "\n")
    with pytest.raises(validate.ContractError, match="Repeated phenotype"):
        cli.load(spark, str(tmp_path / "d"), "synthetic")


def cohort(tmp_path):
    """Markers x samples, with sealed samples whose labels and dosages would be errors if they were read."""
    rng, d = np.random.default_rng(6), tmp_path / "c"
    d.mkdir()
    x = rng.integers(0, 3, (20, 34)).astype(np.float32)
    y = x[3, :28] - x[7, :28] + rng.normal(size=28) * 0.1
    x[:, 28:] = 9
    np.save(d / "dosages.npy", x)
    (d / "samples.tsv").write_text("normalized_id\tsample_index\n" + "".join(f"s{i:02d}\t{i}\n" for i in range(34)))
    (d / "variants.tsv").write_text("CHROM\tPOS\n" + "".join(f"{j // 10 + 1}\t{(j % 10 + 1) * 1000}\n" for j in range(20)))
    (d / "splits.tsv").write_text("accession_id\tgroup_id\tpartition\touter_fold\n" + "".join(f"s{i:02d}\tg{i % 7}\tdevelopment\t{i % 7 % 2}\n" for i in range(28)) + "".join(f"s{i:02d}\tz{i}\tsealed\t\n" for i in range(28, 34)))
    (d / "phenotypes.tsv").write_text("accession_id\ttrait_id\tvalue\n" + "".join(f"s{i:02d}\tprotein\t{v}\n" for i, v in enumerate(y)))
    (d / "source_manifest.json").write_text(json.dumps({"artifacts": [{"path": f"a/{n}", "sha256": sinks.digest(str(d / n))} for n in cli.LISTED]}))
    (tmp_path / "l.json").write_text(json.dumps({**LADDER, "rho_bounds": [0.1, 1.0], "call_rate_min": 0.9}))
    return d, ["ladder", "--data", str(d), "--trait", "protein", "--config", str(tmp_path / "l.json"), "--out", str(tmp_path / "lo")]


def test_ladder_resumes_and_reports(spark, tmp_path, monkeypatch):
    d, args = cohort(tmp_path)
    out = tmp_path / "lo"
    assert cli.main([*args, "--profile"]) == 0 and not (out / "fold_1").exists() and not (out / "report.md").exists()
    with pytest.raises(validate.ContractError, match="fold 1 has not been finished"):
        cli.report(spark, str(out))
    ran, run = [], cli.run_ladder
    monkeypatch.setattr(cli, "run_ladder", lambda s, c, o, only, stage: ran.append(only) or run(s, c, o, only, stage))
    monkeypatch.setattr(cli, "REPLICATES", 30)
    monkeypatch.setattr(cli, "report", lambda s, o, r=cli.report: r(s, o, None, 30))
    assert cli.main(args) == 0 and ran == [[1]]
    pred = spark.read.parquet(str(out / "predictions"))
    assert pred.count() == 28 * 4 and spark.read.parquet(str(out / "comparisons")).count() == 5
    assert {"physical", "ld"} == {r.strategy for r in spark.read.parquet(str(out / "metrics")).collect()}
    catalog, dealt = readers.tsv(spark, str(out / "marker_catalog.tsv")).collect(), readers.tsv(spark, str(out / "outer_splits.tsv")).collect()
    assert [int(r.marker_idx) for r in catalog] == list(range(20)) and catalog[0].asDict() == {"marker_idx": "0", "chrom": "1", "pos": "1000"}
    assert {r.sample_id: int(r.outer_fold) for r in dealt} == json.loads((out / "splits.json").read_text())["outer"]
    assert len(json.loads((out / "costs.json").read_text())) == 2 and "comparisons" in (out / "report.md").read_text()
    assert spark.read.parquet(str(out / "fits")).filter("residual > 1e-8").count() == 0
    assert {r.marker_idx for r in spark.read.parquet(str(out / "fold_0/panels")).collect()} <= set(range(20))
    changed = json.loads((tmp_path / "l.json").read_text())
    (tmp_path / "l.json").write_text(json.dumps({**changed, "seed": 5}))
    with pytest.raises(ValueError, match="another run"):
        cli.main(args)
    (tmp_path / "l.json").write_text(json.dumps(changed))
    (d / "source_manifest.json").rename(d / "kept.json")
    for name in cli.FILES[True]:  # one byte of any input
        raw = (d / name).read_bytes()
        at = len(raw) - 2 if name != "dosages.npy" else raw.rindex(np.float32(9).tobytes()) + 2
        (d / name).write_bytes(raw[:at] + (b"0" if raw[at : at + 1] != b"0" else b"1") + raw[at + 1 :])
        with pytest.raises(ValueError):
            cli.main(args)
        (d / name).write_bytes(raw)
    assert cli.main(args) == 0 and ran == [[1]]
    (d / "kept.json").rename(d / "source_manifest.json")
    with pytest.raises(validate.ContractError, match="28 development samples, not 27"):
        cli.load_cohort(spark, str(d), "protein", 2, {"development": 27, "sealed": 6})
    lines = (d / "splits.tsv").read_text()
    (d / "splits.tsv").write_text(lines.replace("\tz28\t", "\tg1\t"))
    with pytest.raises(validate.ContractError, match="recorded digests"):
        cli.load_cohort(spark, str(d), "protein")
    (d / "source_manifest.json").write_text('{"artifacts": []}')
    with pytest.raises(validate.ContractError, match="doesn't list splits.tsv"):
        cli.load_cohort(spark, str(d), "protein")
    (d / "source_manifest.json").unlink()
    with pytest.raises(validate.ContractError, match="Groups in both partitions"):
        cli.load_cohort(spark, str(d), "protein")


def test_encodings_from_wide_tables(spark, tmp_path):
    import pandas as pd

    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (30, 12)).astype(float)
    y = x[:, 2] - x[:, 5] + rng.normal(size=30) * 0.1
    pd.DataFrame(x, columns=[f"m{j}" for j in range(12)]).assign(acid=[f"a{i}" for i in range(30)])[["acid", *[f"m{j}" for j in range(12)]]].to_parquet(tmp_path / "g.parquet")
    pd.DataFrame({"acid": [f"a{i}" for i in range(31)], "protein": [*y, 0.0]}).to_parquet(tmp_path / "p.parquet")
    (tmp_path / "f.csv").write_text("sample_id,fold\n" + "".join(f"a{i},{i % 10 + 1}\n" for i in range(30)))
    (tmp_path / "e.json").write_text(json.dumps({"inner_folds": 2, "rhos": [0.1], "bounds": [0.1, 0.1]}))
    args = ["encodings", "--genotypes", str(tmp_path / "g.parquet"), "--phenotypes", str(tmp_path / "p.parquet"), "--folds", str(tmp_path / "f.csv"), "--trait", "protein", "--config", str(tmp_path / "e.json"), "--out", str(tmp_path / "eo")]
    study, outer = cli.load_wide(spark, *args[2:7:2], "protein")
    assert study.ids == [f"a{i}" for i in range(30)] and outer["a9"] == 9 and np.allclose(study.y, np.float32(y))
    out = sinks.resume(str(tmp_path / "eo"), {"command": "encodings", "config": {}})
    sinks.write_json({"outer": outer}, str(out / "splits.json"))
    frames = run_encodings(study, outer, 2, rhos=(0.1,), bounds=(0.1, 0.1))
    for f in range(10):
        cli._save({k: v.filter(F.col("fold") == f) for k, v in frames.items() if k in ("predictions", "search", "fits")}, out / f"fold_{f}")
        sinks.write_json({"fold": f}, str(out / f"fold_{f}/complete.json"))
    (tmp_path / "old.txt").write_text("\n".join(f"{n} per fold: [{', '.join(f'np.float64({v})' for v in [w] * 10)}]" for n, w in (("PCC", 0.5), ("RMSE", 0.9), ("MAE", 0.7))))
    assert cli.main(["report", "--out", str(out), "--published", f"old={tmp_path / 'old.txt'}"]) == 0
    got = {r.model: r for r in spark.read.parquet(str(out / "historical")).collect()}
    pred = spark.read.parquet(str(out / "predictions")).collect()
    for m, r in got.items():
        own = np.array([((p.y - p.prediction) ** 2, p.fold) for p in pred if p.model == m])
        by = [own[own[:, 1] == f, 0].mean() for f in range(10)]
        assert r.own_mse == pytest.approx(own[:, 0].mean()) and r.published_mse == pytest.approx(0.81) and r.improved_folds == sum(v < 0.81 for v in by)
    gap = "sample_id,fold\n" + "".join(f"a{i},{1 + 2 * (i % 2)}\n" for i in range(30))
    (tmp_path / "f.csv").write_text(gap)
    with pytest.raises(validate.ContractError, match="fold labels"):
        cli.load_wide(spark, *args[2:7:2], "protein")
    (tmp_path / "f.csv").write_text("sample_id,fold\na0,1\na1,2\n")
    with pytest.raises(validate.ContractError, match="cover"):
        cli.load_wide(spark, *args[2:7:2], "protein")


def test_predictions_must_be_whole_and_finite(spark):
    kinds = "sample_id string, model string, y double, prediction double, train_mean double"
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    good = [("a", "m", 1.0, 1.0, 0.0), ("b", "m", 1.0, 1.0, 0.0)]
    validate.check_predictions(spark.createDataFrame(good, kinds), ids, ["model"])
    for bad, said in ((good[:1], "every id once"), ([good[0], ("b", "m", 1.0, float("nan"), 0.0)], "finite"), ([], "no predictions"), ([*good, good[0]], "every id once")):
        with pytest.raises(validate.ContractError, match=said):
            validate.check_predictions(spark.createDataFrame(bad, kinds), ids, ["model"])
    with pytest.raises(validate.ContractError, match="No marker is left"):
        validate.no_empty_panels({("outer/0", "physical:8"): 0})
    with pytest.raises(validate.ContractError, match="training"):
        folds.fit_table({"a": 0, "b": 1}, {})


def test_sources(spark, tmp_path):
    np.save(tmp_path / "g.npy", np.array([[0, 1, -1], [2, 0, 1]], np.int8))
    got = {r.marker_idx: r.g for r in readers.npy(spark, str(tmp_path / "g.npy"), 1, block=2).collect()}
    assert got == {0: [0, 2], 1: [1, 0], 2: [None, 1]}
    assert {r.marker_idx: r.g for r in readers.npy(spark, str(tmp_path / "g.npy"), 0, samples=[2, 0]).collect()} == {0: [None, 0], 1: [1, 2]}
    with pytest.raises(ValueError):
        readers.column_blocks(3, 0)
    spark.createDataFrame([("a", 0.0, 2.0), ("b", 1.0, 1.0)], "acid string, m1 double, m2 double").coalesce(1).toPandas().to_parquet(tmp_path / "w.parquet")
    samples, vec = readers.wide_parquet(spark, str(tmp_path / "w.parquet"), block=1)
    assert samples.count() == 2 and {r.marker_idx: r.g for r in vec.collect()} == {0: [0.0, 1.0], 1: [2.0, 1.0]}
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\n")
    assert readers.tsv(spark, str(tmp_path / "t.tsv"), ["a"]).first().b == ""
    with pytest.raises(readers.SourceError):
        readers.tsv(spark, str(tmp_path / "t.tsv"), ["c"])
    (tmp_path / "t.csv").write_text("sample_id,fold\na,1\nb,\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv"), ["sample_id", "fold"]).collect()] == [("a", "1"), ("b", "")]


def test_configuration_and_labels(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"seed": 3, "rhos": [0.1, 1]}')
    (tmp_path / "c.toml").write_text("seed = 3\nrhos = [0.1, 1]\n")
    assert readers.config(str(tmp_path / "c.json")) == readers.config(str(tmp_path / "c.toml")) == {"seed": 3, "rhos": [0.1, 1]}
    spark.createDataFrame([("a", 0.1, 5.0), ("b", None, 6.0), ("c", 3.0, 7.0)], "acid string, protein double, oil double").write.parquet(str(tmp_path / "p"))
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "sample_id string")
    got = readers.phenotypes_of(spark, str(tmp_path / "p"), "protein", ids)
    assert {r.sample_id: r.value for r in got.collect()} == {"a": float(np.float32(0.1)), "b": None}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "protein" in scan and "oil" not in scan
    labels = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "sample_id string, value double")
    splits = spark.createDataFrame([("a", "development"), ("b", "sealed")], "sample_id string, partition string")
    assert [tuple(r) for r in readers.development_labels(labels, splits).collect()] == [("a", 1.0)]


def test_arrays_fit_their_manifests():
    validate.array_contract(np.zeros((2, 3), np.int8), (2, 3))
    for array, shape, said in ((np.zeros((2, 3)), (3, 2), "shape"), (np.full((2, 3), "x"), (2, 3), "numbers"), (np.zeros((2, 0)), (2, 0), "empty manifest")):
        with pytest.raises(validate.ContractError, match=said):
            validate.array_contract(array, shape)


def test_sinks(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        sinks.write_json({"a": float("nan")}, str(tmp_path / "a.json"))
    sinks.resume(str(tmp_path / "r"), {"seed": 1})
    sinks.resume(str(tmp_path / "r"), {"seed": 1})
    with pytest.raises(ValueError):
        sinks.resume(str(tmp_path / "r"), {"seed": 2})
    path = str(tmp_path / "big.bin")
    (tmp_path / "big.bin").write_bytes(bytes(range(256)) * 5)
    monkeypatch.setattr(sinks, "BLOCK", 1000)
    d = sinks.file_digests(spark, [path, str(tmp_path / "r/identity.json")])
    halves = [hashlib.sha256(p).hexdigest() for p in ((bytes(range(256)) * 5)[:1000], (bytes(range(256)) * 5)[1000:])]
    assert d[path]["tree"] == sinks.text_digest("".join(halves)) and d[path]["sha256"] is None
    assert d[str(tmp_path / "r/identity.json")]["sha256"] == sinks.digest(str(tmp_path / "r/identity.json"))
    assert sinks.file_digests(spark, [path], {path: {**d[path], "tree": "known"}})[path]["tree"] == "known"
    assert sinks.plain_digests(spark, [path]) == {path: sinks.digest(path)}
    assert "| n |" in sinks.markdown(spark.range(1).select(F.col("id").alias("n")), "t")
    table = spark.createDataFrame([(1, "a b", None)], "n int, s string, x double")
    sinks.write_tsv(table, str(tmp_path / "t"), ["s", "n", "x"])
    back = readers.tsv(spark, str(tmp_path / "t"))
    assert back.columns == ["s", "n", "x"] and tuple(back.first()) == ("a b", "1", "")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_tsv(table, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="empty"):
        sinks.write_tsv(table.limit(0), str(tmp_path / "u"))


def test_queries_have_matching_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("embeddings", "lineitem", "orders", "customer", "events", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("qc_train_a", "ld_pairs_r2", "panel_coverage", "krr_density2", "kernel_diagnostics", "parse_fold_metrics", "marker_hash_order", "validation_report"):
        a, b = q.QUERIES[name](spark, sf), con.sql(q.ORACLE[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        left, right = a.toPandas()[cols].sort_values(cols).reset_index(drop=True), b[cols].sort_values(cols).reset_index(drop=True)
        for c in cols:
            if left[c].dtype.kind in "if":
                assert np.allclose(left[c].astype(float), right[c].astype(float), equal_nan=True), (name, c)
            else:
                assert left[c].astype(str).tolist() == right[c].astype(str).tolist(), (name, c)


def test_stream_equals_batch(spark, tmp_path):
    from densitylab.streaming.events import hourly, hourly_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    run = hourly_stream(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "c"), "hours")
    run.awaitTermination(60)
    closed = {(r.event_type, r.hour): (r.n, round(r.total, 6)) for r in spark.table("hours").collect()}
    batch = {(r.event_type, r.hour): (r.n, round(r.total, 6)) for r in hourly(events).collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())  # hours that the watermark has closed are whole
