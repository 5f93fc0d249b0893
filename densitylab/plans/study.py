"""The three studies: marker densities, the density ladder, and the two encodings (A, B1, B2).

All fits of a study, outer and inner, are rows of one plan: statistics of each fit and its markers
by tier.  They are staged, genotypes with them, and so no plan grows with folds or rounds.  Systems are
solved by products that never form a kernel: with kernels, whose vectors have a number a sample (``Loaded``), or, where samples
are more than markers, with the markers' equations, whose vectors have a number a marker (``ByMarker``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import shifted, shifted_by_marker
from ..operators import diagnostics, ld, metrics, ordering, qc
from ..operators import folds as fo
from ..operators import kernel as ke
from ..operators import primal as pr
from ..operators import validate as va
from ..operators.stage import Stage

_ERRORS = "fit_id string, workflow string, penalty_idx int, penalty double, n bigint, sse double, markers int, capped boolean"
_ROWS = "fit_id string, workflow string, penalty double, position int, prediction double, train_mean double, markers int, scale double, residual double, steps int"
#: Relative residual where a study asks for none.
EXACT = 1e-10
#: Bytes of the vectors of the systems that are solved together, on the driver; a fit at least.
TOGETHER_BYTES = 256 << 20


@dataclass(frozen=True)
class DensityConfig:
    seed: int = 1
    outer_folds: int = 5
    inner_folds: int = 3
    densities: Sequence[int | str] = (1000, "all")
    alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0)
    min_call_rate: float = 0.95
    min_maf: float = 0.05
    min_mac: int = 0
    hash_salt: str = "canonical-v1"
    #: M5: first and last exponent, step and hard cap of a grid that grows instead of ``alphas``.
    alpha_log10: Sequence[float] | None = None
    #: Samples at this distance or less are near clones, in the protocol that keeps their blocks together.
    clone_limit: float = 0.001

    def __post_init__(self):
        va.positive(list(self.alphas), "alphas")
        va.thresholds(self.min_call_rate, self.min_maf, self.min_mac)
        for d in self.densities:
            va.density(d)


@dataclass(frozen=True)
class LadderConfig:
    seed: int = 101
    inner_folds: int = 4
    budgets: Sequence[int] = (2000, 5000, 10000, 20000, 41346)
    rhos: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
    rho_bounds: tuple[float, float] = (1e-6, 1e4)
    call_rate_min: float = 0.98
    maf_min: float = 0.01
    bin_bp: int = 1_000_000
    ld_window_bp: int = 1_000_000
    ld_r2: float = 0.8
    residual: float = 1e-8
    strategies: Sequence[str] = ("physical", "ld")

    def __post_init__(self):
        va.positive([*self.rhos, *self.rho_bounds, self.residual, self.ld_r2], "rhos, bounds, residual and ld_r2")
        va.positive([*self.budgets, self.bin_bp, self.ld_window_bp], "budgets and widths")
        va.thresholds(self.call_rate_min, self.maf_min, 0)


@dataclass
class Study:
    """sample_id by position, y by position, marker_vec, variants.  Ids and groups may be arrays."""

    ids: Sequence[str]
    y: np.ndarray
    vec: DataFrame
    variants: DataFrame
    groups: Sequence[str] = field(default_factory=list)

    def position(self) -> dict[str, int]:
        return {s: i for i, s in enumerate(self.ids)}


def align(samples: DataFrame, phenotypes: DataFrame, trait: str) -> tuple[DataFrame, DataFrame]:
    """Matched samples with values in sample order, and phenotyped ids without genotypes."""
    p = phenotypes.filter((F.col("trait_id") == trait) & F.col("value").isNotNull()).select("sample_id", "value")
    return samples.join(p, "sample_id"), p.join(samples.select("sample_id"), "sample_id", "left_anti").select("sample_id")


#: Folds of samples: by sample_id, or an array by position.
Folds = Mapping[str, int] | np.ndarray


def _fits(study: Study, outer: Folds, inner: Mapping[int, Folds], only: Sequence[int] | None) -> list[ke.Fit]:
    table = fo.fit_positions(np.argsort(np.asarray(study.ids, dtype=str), kind="stable"), fo.codes(study.ids, outer), {f: fo.codes(study.ids, own) for f, own in inner.items()}, only)
    return [ke.Fit(*row) for row in table]


def _inner(study: Study, outer: Folds, groups: Sequence[str], k: int, seed: int, context: str, only: Sequence[int] | None) -> dict[int, np.ndarray]:
    """Balanced inner folds of the training samples of each outer fold, by position; ``context`` names the fold."""
    of, own = fo.codes(study.ids, outer), {}
    groups = np.asarray(groups, dtype=str)
    for f in np.unique(of[of != fo.ABSENT]).tolist() if only is None else only:
        train = np.flatnonzero((of != f) & (of != fo.ABSENT))
        own[f] = np.full(len(of), fo.ABSENT, np.int32)
        own[f][train] = fo.balanced_groups_local(groups[train], k, seed, context.format(f))
        va.whole_groups(groups[train], own[f][train])
    return own


@dataclass(frozen=True)
class Panel:
    """What a fit knows of a workflow: markers, the kernel's divisor (None: its mean diagonal), whether capped."""

    markers: int
    scale: float | None = None
    capped: bool = False


@dataclass(frozen=True)
class Answer:
    """Predictions of a fit's test samples by a workflow, a column a penalty."""

    fit: ke.Fit
    workflow: str
    grid: list[float]
    panel: Panel
    scale: float
    mean: float
    predictions: np.ndarray
    residuals: np.ndarray
    steps: np.ndarray

    def errors(self, y: np.ndarray) -> list[tuple]:
        """Rows of _ERRORS."""
        missed = ((y[np.array(self.fit.test)][:, None] - self.predictions) ** 2).sum(0)
        return [(self.fit.fit_id, self.workflow, i, float(c), len(self.fit.test), float(e), self.panel.markers, self.panel.capped) for i, (c, e) in enumerate(zip(self.grid, missed))]

    def rows(self, penalty: float) -> list[tuple]:
        """Rows of _ROWS for one penalty of the grid."""
        i = self.grid.index(penalty)
        return [(self.fit.fit_id, self.workflow, penalty, int(s), float(p), self.mean, self.panel.markers, self.scale, float(self.residuals[i]), int(self.steps[i])) for s, p in zip(self.fit.test, self.predictions[:, i])]


def _scale_of(panel: Panel, trace: float, n: int) -> float:
    scale = trace / n if panel.scale is None else panel.scale
    if not scale > 0:
        raise va.ContractError("the kernel has no variance")
    return float(scale)


@dataclass
class Loaded:
    """Genotypes joined with the statistics of all fits, and the traces of their kernels."""

    strips: DataFrame
    fits: list[ke.Fit]
    sums: dict[str, list[int]]
    traces: dict[tuple[str, str], float]

    def answers(self, study: Study, panels, penalties: dict[str, list[float]], residual: float | None) -> list[Answer]:
        return solve(study, self, panels, penalties, residual)

    def errors(self, study: Study, answers: Sequence[Answer]) -> list[tuple]:
        return [r for a in answers for r in a.errors(study.y)]  # a row a fit, workflow and penalty

    def solved(self, chosen: Sequence[tuple[Answer, float]]) -> DataFrame:
        return self.strips.sparkSession.createDataFrame([row for a, p in chosen for row in a.rows(p)], _ROWS)

    def diagnostics(self, samples: int, fits: list[tuple[int, ke.Fit]], full: str, most: int = 512) -> DataFrame:
        return diagnostics.relationship(self.strips, samples, fits, self.sums, full, most)


@dataclass(frozen=True)
class MarkerAnswer:
    """Effects of the markers of a fit's workflow, a column a penalty."""

    number: int
    fit: ke.Fit
    workflow: str
    grid: list[float]
    panel: Panel
    scale: float
    mean: float
    system: pr.System
    residuals: np.ndarray
    steps: np.ndarray


@dataclass
class ByMarker:
    """Genotypes in blocks of samples, the panels of all fits, and what each fit's training samples sum up to by marker."""

    blocks: DataFrame
    fits: list[ke.Fit]
    sums: dict[str, list[int]]
    columns: pr.Columns
    levels: np.ndarray
    moments: np.ndarray

    def answers(self, study: Study, panels, penalties: dict[str, list[float]], residual: float | None) -> list[MarkerAnswer]:
        """``solve`` by the markers' equations: a step is one pass over the blocks for all systems of a batch; the driver has vectors by marker."""
        out, m = [], len(self.columns.markers)
        wanted = [(i, f, w, penalties[f"{f.fit_id}|{w}"]) for i, f in enumerate(self.fits) for w in self.sums if penalties.get(f"{f.fit_id}|{w}") and panels[f.fit_id].get(w) is not None]
        for batch in _batches(wanted, lambda x: 8 * m * (2 * len(x[3]) + 4), lambda x: x[0]):
            live = {}
            for i, f, w, grid in batch:
                mean, root = self.columns.panel(i, self.sums[w])
                one, two, called, cross, known = self.moments[:, :, i]
                n, trace = len(f.train), float((root**2 * (two - 2 * mean * one + mean**2 * called)).sum())
                scale = _scale_of(panels[f.fit_id][w], trace, n)
                root = root / np.sqrt(scale)
                size = float(np.linalg.norm(study.y[f.train] - self.levels[i]))
                solver = shifted_by_marker(root * (cross - mean * known), size, trace / scale, np.asarray(grid, float) * (1 if residual is None else n), EXACT if residual is None else residual)
                live[i, w] = f, grid, scale, mean, root, solver
            at = {}
            for key, own in list(live.items()):
                self._step(live, at, out, panels, key, own, None)
            while live:
                systems = [pr.System(i, mean, root, at[i, w]) for (i, w), (_, _, _, mean, root, _) in live.items()]
                for (key, own), q in zip(list(live.items()), pr.products(self.blocks, systems)):
                    self._step(live, at, out, panels, key, own, q)
        return out

    def _step(self, live: dict, at: dict, out: list[MarkerAnswer], panels, key: tuple[int, str], own: tuple, q: np.ndarray | None) -> None:
        (i, w), (f, grid, scale, mean, root, solver) = key, own
        try:
            at[key] = solver.send(q)
        except StopIteration as end:
            u, true, steps = end.value
            if not np.isfinite(u).all():
                raise va.ContractError("predictions aren't finite") from None
            out.append(MarkerAnswer(i, f, w, list(grid), panels[f.fit_id][w], scale, float(self.levels[i]), pr.System(i, mean, root, u), true, steps))
            del live[key]

    def errors(self, study: Study, answers: Sequence[MarkerAnswer]) -> list[tuple]:
        sums = pr.errors(self.blocks, [a.system for a in answers], [a.mean for a in answers]) if answers else []
        return [(a.fit.fit_id, a.workflow, i, float(c), len(a.fit.test), float(e), a.panel.markers, a.panel.capped) for a, own in zip(answers, sums) for i, (c, e) in enumerate(zip(a.grid, own))]

    def solved(self, chosen: Sequence[tuple[MarkerAnswer, float]]) -> DataFrame:
        spark, systems, rows = self.blocks.sparkSession, [], []
        if not chosen:
            return spark.createDataFrame([], _ROWS)
        for i, (a, penalty) in enumerate(chosen):
            k = a.grid.index(penalty)
            systems.append(pr.System(a.number, a.system.mean, a.system.root, a.system.d[:, k : k + 1]))
            rows.append((i, a.fit.fit_id, a.workflow, penalty, a.mean, a.panel.markers, a.scale, float(a.residuals[k]), int(a.steps[k])))
        own = spark.createDataFrame(rows, "system int, fit_id string, workflow string, penalty double, train_mean double, markers int, scale double, residual double, steps int")
        return pr.predictions(self.blocks, systems, [a.mean for a, _ in chosen]).join(F.broadcast(own), "system").select(*[c.split()[0] for c in _ROWS.split(", ")])

    def diagnostics(self, samples: int, fits: list[tuple[int, ke.Fit]], full: str, most: int = 512) -> DataFrame:
        return diagnostics.relationship_by_marker(self.blocks, self.columns, fits, self.sums, full, most)


def load(study: Study, stats: DataFrame, fits: list[ke.Fit], sums: dict[str, list[int]], stage: Stage) -> Loaded | ByMarker:
    """Genotypes and statistics of all fits, for vectors on the shorter side."""
    return load_blocks(study, stats, fits, sums, stage) if len(study.ids) > study.variants.count() else load_strips(study, stats, fits, sums, stage)


def load_blocks(study: Study, stats: DataFrame, fits: list[ke.Fit], sums: dict[str, list[int]], stage: Stage) -> ByMarker:
    columns = pr.Columns(stats, fits)
    blocks = stage.put(pr.cut(study.vec, columns.markers, fits, study.y), "blocks", keep=True)
    levels = np.array([study.y[f.train].mean() for f in fits])
    return ByMarker(blocks, fits, sums, columns, levels, pr.moments(blocks, levels, len(columns.markers)))


def _batches(wanted: list, size: Callable[[tuple], int], fit: Callable[[tuple], object]) -> list[list]:
    """``wanted`` in batches whose vectors have TOGETHER_BYTES; a fit at least."""
    batches, held = [], 0
    for one in wanted:
        own = size(one)
        if not batches or (held + own > TOGETHER_BYTES and fit(batches[-1][-1]) != fit(one)):
            batches.append([])
            held = 0
        batches[-1].append(one)
        held += own
    return batches


def load_strips(study: Study, stats: DataFrame, fits: list[ke.Fit], sums: dict[str, list[int]], stage: Stage) -> Loaded:
    strips = stage.put(ke.loaded(study.vec, stats, fits), "strips", keep=True)
    return Loaded(strips, fits, sums, ke.traces(strips, fits, sums))


def solve(study: Study, load: Loaded, panels: dict[str, dict[str, Panel]], penalties: dict[str, list[float]], residual: float | None = None) -> list[Answer]:
    """Predictions for the penalties wanted of each ``fit|workflow``; all penalties of a system come from one Krylov space.

    With a residual, penalties are multiples of the training samples; without one they are added as they are.
    A step is one pass over the strips for all systems of a batch; the driver has a batch's vectors.
    """
    number, samples, out = {f.fit_id: i for i, f in enumerate(load.fits)}, len(study.ids), []
    wanted = [(f, w, penalties[f"{f.fit_id}|{w}"]) for f in load.fits for w in load.sums if penalties.get(f"{f.fit_id}|{w}") and panels[f.fit_id].get(w) is not None]
    for batch in _batches(wanted, lambda x: 8 * samples * (2 * len(x[2]) + 4), lambda x: x[0].fit_id):
        live = {}
        for f, w, grid in batch:
            scale = _scale_of(panels[f.fit_id][w], load.traces.get((f.fit_id, w), 0.0), len(f.train))
            train = np.array(f.train)
            solver = shifted(study.y[train], np.asarray(grid, float) * (1 if residual is None else len(train)), EXACT if residual is None else residual)
            live[f.fit_id, w] = f, w, grid, scale, train, solver, next(solver)
        while live:
            systems = []
            for f, w, _, _, train, _, d in live.values():
                spread = np.zeros((samples, d.shape[1]))
                spread[train] = d
                systems.append(ke.System(number[f.fit_id], tuple(load.sums[w]), spread))
            for key, q in zip(list(live), ke.products(load.strips, systems)):
                f, w, grid, scale, train, solver, _ = live[key]
                try:
                    live[key] = f, w, grid, scale, train, solver, solver.send(q[train] / scale)
                except StopIteration as end:  # the last product was that of the weights, at the test samples too
                    _, true, steps = end.value
                    mean = float(study.y[train].mean())
                    p = mean + q[np.array(f.test)] / scale
                    if not np.isfinite(p).all():
                        raise va.ContractError("predictions aren't finite") from None
                    out.append(Answer(f, w, list(grid), panels[f.fit_id][w], scale, mean, p, true, steps))
                    del live[key]
    return out


def _people(study: Study) -> DataFrame:
    groups = study.groups if len(study.groups) else np.full(len(study.ids), "")
    columns = [pa.array(np.arange(len(study.ids)), pa.int32()), pa.array(study.ids, pa.string()), pa.array(study.y, pa.float64()), pa.array(groups, pa.string())]
    return study.vec.sparkSession.createDataFrame(pa.table(columns, names=["position", "sample_id", "y", "group_id"]))


def run_densities(study: Study, config: DensityConfig, outer: Folds, inner: Mapping[int, Folds], only: Sequence[int] | None = None, stage: Stage | None = None) -> dict[str, DataFrame]:
    """A: predictions, metrics, tuning, omitted, qc, panels.  Statistics come from each fit's training rows alone."""
    spark = study.vec.sparkSession
    stage = stage or Stage(spark)
    fits = _fits(study, outer, inner, only)
    stats = stage.put(qc.fit_eligible(study.vec, {f.fit_id: f.train for f in fits}, config.min_call_rate, config.min_maf, config.min_mac), "qc")
    order = ordering.hash_order(study.variants, config.hash_salt)
    numbered = sorted([d for d in config.densities if d != "all"]) + (["all"] if "all" in config.densities else [])
    ranked = stats.join(order, "marker_idx").withColumn("k", F.row_number().over(Window.partitionBy("fit_id").orderBy("rank")))
    tier = F.coalesce(*[F.lit(i) if d == "all" else F.when(F.col("k") <= int(d), F.lit(i)) for i, d in enumerate(numbered)], F.lit(len(numbered)))
    marked = stage.put(ranked.withColumn("tier", tier).filter(F.col("tier") < len(numbered)).withColumn("scale", F.lit(1.0)), "marked")
    weights = marked.groupBy("fit_id", "tier").agg(F.count("*").alias("n"), F.sum(2 * F.col("p") * (1 - F.col("p"))).alias("c")).collect()
    eligible = {r.fit_id: r.n for r in stats.groupBy("fit_id").agg(F.count("*").alias("n")).collect()}
    for f in fits:
        if not eligible.get(f.fit_id):
            raise va.ContractError(f"no eligible marker in {f.fit_id}")
    sums = {str(d): list(range(i + 1)) for i, d in enumerate(numbered)}
    panels: dict[str, dict[str, Panel]] = {}
    omitted = []
    for f in fits:
        own, n, c = {r.tier: r for r in weights if r.fit_id == f.fit_id}, 0, 0.0
        panels[f.fit_id] = {}
        for t, d in enumerate(numbered):
            n, c = n + (own[t].n if t in own else 0), c + (own[t].c if t in own else 0.0)
            use, capped = ordering.availability(eligible[f.fit_id], d, f.fit_id.startswith("outer"))
            if use is None:
                omitted.append((f.fit_id, str(d), eligible[f.fit_id]))
            else:
                panels[f.fit_id][str(d)] = Panel(n, c, capped)
    held = load(study, marked.select("fit_id", "marker_idx", "mean", "scale", "tier"), fits, sums, stage)
    if config.alpha_log10:
        first, last, step, cap = config.alpha_log10
        exponents = np.arange(round((last - first) / step) + 1) * step + first
        growth = [10 ** (step * i) for i in range(1, 5)]
        solved, tuning, _ = _nested_search(study, held, panels, (10**exponents).tolist(), (10**-cap, 10**cap), None, stage, growth)
    else:
        solved, tuning, _ = _nested_search(study, held, panels, list(config.alphas), None, None, stage)
    pred = solved.join(_people(study), "position").select("sample_id", "group_id", F.split("fit_id", "/")[1].cast("int").alias("fold"), F.col("workflow").alias("density"), "markers", "y", "prediction", "train_mean", F.col("penalty").alias("alpha"))
    pred = stage.put(pred, "predictions")
    va.finite_rows(pred, ["y", "prediction", "train_mean"])
    both = metrics.with_mean_model(pred)
    table_of = metrics.pooled_and_by_fold(both, ["density", "model"]).drop("mse", "r2").withColumn("complete_oof", F.when(F.col("fold").isNull(), F.col("n") == len(study.ids)))
    chosen_of = ranked.select("fit_id", "marker_idx", F.col("k").alias("place"), tier.alias("tier"))
    own = F.explode(F.array(*[F.when(F.col("tier") <= i, F.lit(str(d))) for i, d in enumerate(numbered)])).alias("density")
    panel = chosen_of.filter(F.col("fit_id").startswith("outer")).select("fit_id", "marker_idx", "place", own).filter("density is not null")
    left_out = spark.createDataFrame(omitted, "fit_id string, density string, eligible int")
    panel = panel.join(left_out.select("fit_id", "density"), ["fit_id", "density"], "left_anti")
    return {"predictions": pred, "metrics": table_of, "tuning": tuning, "omitted": left_out, "qc": stats, "panels": panel}


def _nested_search(study: Study, load: Loaded | ByMarker, panels, rhos: Sequence[float], bounds: tuple[float, float] | None, residual: float | None, stage: Stage, growth: Sequence[float] = (10.0,)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1-M4: (predictions, tuning, search).

    Each outer fold has a grid of its own, which all its workflows share.  It grows by the
    factors in ``growth``, and never beyond the bounds (None: not at all), while an optimum stands at an end that
    isn't the bound; kernels don't depend on the penalty, so only new penalties are ever solved.
    Outer fits are solved along with the inner ones, for the whole grid, as penalties cost no steps; what the search chooses is kept.
    """
    spark, fold_of = study.vec.sparkSession, {f.fit_id: int(f.fit_id.split("/")[1]) for f in load.fits}
    folds = sorted(set(fold_of.values()))
    grids = {f: sorted(float(r) for r in rhos) if bounds else [float(r) for r in rhos] for f in folds}
    fresh, errors, outer = dict(grids), [], []
    while True:
        want = {f"{f.fit_id}|{w}": fresh[fold_of[f.fit_id]] for f in load.fits if fold_of[f.fit_id] in fresh for w in load.sums}
        answers = load.answers(study, panels, want, residual)
        outer += [a for a in answers if a.fit.fit_id.startswith("outer")]
        errors += load.errors(study, [a for a in answers if a.fit.fit_id.startswith("inner")])
        known = spark.createDataFrame(errors, _ERRORS).withColumn("fold", F.split("fit_id", "/")[1].cast("int"))
        if bounds:
            known = known.withColumn("penalty_idx", F.lit(0))  # on ties the least penalty; without growth the first of the grid
        sse = metrics.pooled_sse(known, "fold", "workflow")
        best, fresh = metrics.best_penalty(sse, "fold", "workflow").collect(), {}
        for f in folds if bounds else ():
            grid, own = grids[f], {r.penalty for r in best if r.fold == f}
            grown = {max(bounds[0], grid[0] / g) for g in growth} if grid[0] in own and grid[0] > bounds[0] else set()
            grown |= {min(bounds[1], grid[-1] * g) for g in growth} if grid[-1] in own and grid[-1] < bounds[1] else set()
            grown = sorted(grown)
            if grown:
                fresh[f], grids[f] = grown, sorted([*grid, *grown])
        if not fresh:
            break
    chosen = {(r.fold, r.workflow): r.penalty for r in best}
    solved = load.solved([(a, p) for a in outer if (p := chosen.get((fold_of[a.fit.fit_id], a.workflow))) in a.grid])
    search = sse.select("fold", "workflow", "penalty", (F.col("sse") / F.col("n")).alias("inner_mse"))
    return stage.put(solved, "solved"), stage.put(metrics.best_penalty(sse, "fold", "workflow"), "tuning"), stage.put(search, "search")


def _fit_records(solved: DataFrame, tuning: DataFrame) -> DataFrame:
    """A row an outer fit: what was chosen and how it was solved."""
    own = solved.select(F.split("fit_id", "/")[1].cast("int").alias("fold"), "workflow", "markers", "scale", "residual", "steps").distinct()
    return tuning.join(own, ["fold", "workflow"])


@dataclass
class LadderPlan:
    """What a ladder knows before any system is solved."""

    fits: list[ke.Fit]
    kept: DataFrame
    marked: DataFrame
    sums: dict[str, list[int]]
    panels: dict[str, dict[str, Panel]]
    chosen: DataFrame
    coverage: DataFrame | None
    ld: DataFrame | None


def plan_ladder(study: Study, config: LadderConfig, outer: Folds, only: Sequence[int] | None, stage: Stage) -> LadderPlan:
    """Markers kept by each fit, orders, nested panels and their coverage; every table is staged."""
    inner = _inner(study, outer, study.groups, config.inner_folds, config.seed, "inner:{}:full", only)
    fits = _fits(study, outer, inner, only)
    trains = {f.fit_id: f.train for f in fits}
    physical = stage.put(ordering.physical_order(study.variants, config.seed, config.bin_bp), "physical")
    budgets = sorted(config.budgets)
    full = budgets[-1]
    mean = F.coalesce("mean", F.lit(0.0))
    keep = (F.col("called") / F.col("rows") >= config.call_rate_min) & (F.least(mean / 2, 1 - mean / 2) >= config.maf_min) & (F.coalesce("variance", F.lit(0.0)) > 0)
    kept = stage.put(qc.fit_counts(study.vec, trains).filter(keep).select("fit_id", "marker_idx", mean.alias("mean")), "kept")
    each = physical.withColumn("fit_id", F.explode(F.array(*map(F.lit, trains))))
    orders, cover, summary, r2 = {"physical": each}, None, None, None
    outermost = F.col("fit_id").startswith("outer")
    if "ld" in config.strategies:
        r2 = stage.put(ld.window_r2(study.vec, study.variants, kept, trains, config.ld_window_bp), "r2")
        reps = ld.greedy_cover(study.variants, kept, physical, r2, config.ld_r2, stage)
        orders["ld"] = stage.put(ordering.representatives_first(each, reps, kept), "ld-order")
        good = study.variants.join(kept.filter(outermost).select("fit_id", "marker_idx"), "marker_idx")
        summary = stage.put(ld.summary(good, r2.filter(outermost), config.ld_r2), "ld-summary")
    ranked, marked = None, None
    for number, name in enumerate(config.strategies):
        own = orders[name].filter(outermost).select("fit_id", F.lit(name).alias("strategy"), "marker_idx", "rank", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
        ranked = own if ranked is None else ranked.unionByName(own)
        steps = budgets if not number else budgets[:-1]
        own = ordering.tiers(orders[name], steps).join(kept, ["fit_id", "marker_idx"])
        place = F.coalesce(*[F.when(F.col("tier") == b, F.lit(number * 100 + i)) for i, b in enumerate(steps)])
        own = own.select("fit_id", "marker_idx", "mean", F.lit(1.0).alias("scale"), place.alias("tier"))
        marked = own if marked is None else marked.unionByName(own)
    chosen = stage.put(ranked.filter(F.col("rank") < F.col("budget")).join(kept.select("fit_id", "marker_idx"), ["fit_id", "marker_idx"], "left_semi"), "panels")
    va.nested_panels(chosen)
    marked = stage.put(marked, "marked")
    if r2 is not None:
        panels = [(f.fit_id, name, b) for f in fits if f.fit_id.startswith("outer") for name in config.strategies for b in budgets]
        high = r2.filter(outermost & (F.col("r2") >= config.ld_r2)).select("fit_id", "a", "b", "chrom")
        cover = stage.put(ld.coverage(study.variants, chosen, high, config.bin_bp, panels), "coverage")
    counts = {(r.fit_id, r.tier): r.n for r in marked.groupBy("fit_id", "tier").agg(F.count("*").alias("n")).collect()}
    sums = {f"{name}:{b}": [number * 100 + j for j in range(i + 1)] for number, name in enumerate(config.strategies) for i, b in enumerate(budgets) if not (number and b == full)}
    panels_of = {f.fit_id: {w: Panel(sum(counts.get((f.fit_id, t), 0) for t in ts)) for w, ts in sums.items()} for f in fits}
    va.no_empty_panels({(f, w): p.markers for f, own in panels_of.items() for w, p in own.items()})
    return LadderPlan(fits, kept, marked, sums, panels_of, chosen, cover, summary)


def run_ladder(study: Study, config: LadderConfig, outer: Folds, only: Sequence[int] | None = None, stage: Stage | None = None) -> dict[str, DataFrame]:
    """B1: physical and LD-aware panels at rising budgets; the full panel is fitted once for both.  ``only``: outer folds to run."""
    stage = stage or Stage(study.vec.sparkSession)
    plan = plan_ladder(study, config, outer, only, stage)
    first, full = config.strategies[0], max(config.budgets)
    held = load(study, plan.marked, plan.fits, plan.sums, stage)
    solved, tuning, search = _nested_search(study, held, plan.panels, config.rhos, config.rho_bounds, config.residual, stage)
    flow = F.split("workflow", ":")
    pred = solved.join(_people(study), "position").select("sample_id", "group_id", F.split("fit_id", "/")[1].cast("int").alias("fold"), flow[0].alias("strategy"), flow[1].cast("int").alias("budget"), F.col("markers").alias("actual_markers"), "y", "prediction", "train_mean")
    for name in config.strategies[1:]:  # the full panel is the same fit
        pred = pred.unionByName(pred.filter((F.col("strategy") == first) & (F.col("budget") == full)).withColumn("strategy", F.lit(name)))
    pred = stage.put(pred, "predictions")
    outers = [(i, f) for i, f in enumerate(plan.fits) if f.fit_id.startswith("outer")]
    near = outer_diagnostics(study, held, outers, f"{first}:{full}", config.strategies[1:])  # made when it is read
    kept = plan.kept.filter(F.col("fit_id").startswith("outer"))
    return {"predictions": pred, "metrics": metrics.ladder_metrics(pred), "tuning": tuning, "search": search, "fits": _fit_records(solved, tuning), "coverage": plan.coverage, "ld": plan.ld, "panels": plan.chosen, "qc": kept, "diagnostics": near}


def outer_diagnostics(study: Study, held: Loaded | ByMarker, outers: list[tuple[int, ke.Fit]], full: str, aliases: Sequence[str]) -> DataFrame:
    """A18, A19 of every strategy and budget of the outer fits; the full panel is one fit under several names."""
    near = held.diagnostics(len(study.ids), outers, full)
    names = F.array(F.lit(full), *[F.lit(f"{name}:{full.split(':')[1]}") for name in aliases])
    near = near.withColumn("workflow", F.explode(F.when(F.col("workflow") == full, names).otherwise(F.array("workflow"))))  # a union would go through all tiles again
    flow = F.split("workflow", ":")
    return near.select(F.split("fit_id", "/")[1].cast("int").alias("fold"), flow[0].alias("strategy"), flow[1].cast("int").alias("budget"), F.col("samples").alias("diagnostic_training_samples"), "trace_participation_ratio", "sampled_relative_frobenius", "sampled_offdiagonal_correlation")


def run_encodings(study: Study, outer: Folds, inner_folds: int = 4, seed: int = 101, rhos: Sequence[float] = (1e-4, 1e-2, 1.0), bounds: tuple[float, float] = (1e-6, 1e4), residual: float = 1e-8, only: Sequence[int] | None = None, stage: Stage | None = None) -> dict[str, DataFrame]:
    """B2: centred and standardised encodings of all markers, each kernel divided by its mean diagonal."""
    stage = stage or Stage(study.vec.sparkSession)
    inner = _inner(study, outer, study.ids, inner_folds, seed, "legacy-inner:{}", only)
    fits = _fits(study, outer, inner, only)
    stats = qc.fit_counts(study.vec, {f.fit_id: f.train for f in fits})
    scale = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0)
    parts = stats.select("fit_id", "marker_idx", "mean", F.inline(F.array(F.struct(F.lit(1.0).alias("scale"), F.lit(0).alias("tier")), F.struct(scale.alias("scale"), F.lit(1).alias("tier")))))
    sums = {"GBLUP-centered": [0], "Ridge-standardized": [1]}
    n = study.variants.count()
    panels = {f.fit_id: dict.fromkeys(sums, Panel(n)) for f in fits}
    held = load(study, parts, fits, sums, stage)
    solved, tuning, search = _nested_search(study, held, panels, rhos, bounds, residual, stage)
    pred = solved.join(_people(study), "position").select("sample_id", F.split("fit_id", "/")[1].cast("int").alias("fold"), F.col("workflow").alias("model"), "y", "prediction", "train_mean", F.col("penalty").alias("rho"))
    pred = stage.put(pred, "predictions")
    return {"predictions": pred, "metrics": metrics.pooled_and_by_fold(pred, ["model"]), "tuning": tuning, "search": search, "fits": _fit_records(solved, tuning)}
