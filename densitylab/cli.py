"""Command line: demo, run, ladder, encodings, report."""

from __future__ import annotations

import argparse
import json
import platform
import resource
import sys
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import number_or_null, variant_id, zero_based
from .operators import clones, compare, metrics
from .operators import folds as fo
from .operators import validate as va
from .operators.stage import Stage
from .plans.study import DensityConfig, LadderConfig, Study, align, run_densities, run_encodings, run_ladder
from .sources import readers, sinks, vcf

#: Replicates of the group bootstrap, and of the bootstrap of near-clone blocks.
REPLICATES, BLOCK_REPLICATES = 2000, 10_000


def _phenotypes(spark: SparkSession, path: str, trait: str) -> DataFrame:
    pheno = readers.tsv(spark, path, ["accession_id", "trait_id", "value"]).filter(F.col("trait_id") == trait)
    pheno = pheno.select(F.col("accession_id").alias("sample_id"), "trait_id", number_or_null(F.col("value")).alias("value"))
    va.check_phenotypes(pheno)
    return pheno


def has_vcf(folder: str) -> bool:
    """Whether genotypes are in VCF files; an array goes before them."""
    return not (Path(folder) / "genotypes.npy").exists() and (Path(folder) / "vcf").is_dir()


def inputs_of(folder: str, cohort: bool = False) -> list[str]:
    """The files of a study's folder that a run's identity names."""
    if not cohort and has_vcf(folder):
        return [f"{folder}/{n}" for n in ("samples.tsv", "phenotypes.tsv")] + sorted(str(p) for p in (Path(folder) / "vcf").rglob("*.vcf*"))
    return [f"{folder}/{n}" for n in FILES[cohort]]


def load(spark: SparkSession, folder: str, trait: str) -> Study:
    """A study from samples.tsv, phenotypes.tsv, and either variants.tsv and genotypes.npy (samples x markers) or VCF files in vcf/, all checked."""
    samples = readers.numbered(readers.tsv(spark, f"{folder}/samples.tsv", ["accession_id", "genetic_group"]), "sample_idx").select(F.col("accession_id").alias("sample_id"), F.col("genetic_group").alias("group_id"), "sample_idx").cache()
    if samples.isEmpty():
        raise va.ContractError("no samples")
    va.check_samples(samples)
    if has_vcf(folder):
        stage = Stage(spark)  # to the end of the driver, as the study reads it
        people, variants, calls = vcf.markers(spark, f"{folder}/vcf", stage)
        place = {r.sample_id: r.sample_idx for r in people.collect()}  # a number a sample
        va.none_of(samples.join(people, "sample_id", "left_anti"), "Samples without genotypes")
    else:
        raw = readers.numbered(readers.tsv(spark, f"{folder}/variants.tsv", ["chromosome", "position", "ref", "alt"]), "marker_idx")
        variants = raw.select("marker_idx", F.col("chromosome").alias("chrom"), F.col("position").cast("bigint").alias("pos"), "ref", "alt")
        variants = variants.withColumn("marker_id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))).cache()
    va.check_variants(variants)
    matched, unmatched = align(samples, _phenotypes(spark, f"{folder}/phenotypes.tsv", trait), trait)
    rows = matched.orderBy("sample_idx").collect()
    if len(rows) < 12:
        raise va.ContractError(f"{len(rows)} samples have genotypes and values; 12 are needed")
    sinks.log.info("%d matched, %d unmatched", len(rows), unmatched.count())
    if has_vcf(folder):
        vec = vcf.of_samples(calls, [place[r.sample_id] for r in rows]).cache()
    else:
        va.array_contract(np.load(f"{folder}/genotypes.npy", mmap_mode="r"), (samples.count(), variants.count()))
        vec = readers.npy(spark, f"{folder}/genotypes.npy", 1, [r.sample_idx for r in rows]).cache()
    return Study([r.sample_id for r in rows], np.array([r.value for r in rows]), vec, variants, [r.group_id for r in rows])


#: Files of a study's folder, without and with partitions; those of a cohort that its manifest must list.
FILES = {False: ["samples.tsv", "variants.tsv", "phenotypes.tsv", "genotypes.npy"], True: ["splits.tsv", "samples.tsv", "variants.tsv", "phenotypes.tsv", "dosages.npy"]}
LISTED = ["splits.tsv", "samples.tsv", "variants.tsv"]


def load_cohort(spark: SparkSession, folder: str, trait: str, folds: int | None = None, sizes: dict[str, int] | None = None) -> tuple[Study, dict[str, int]]:
    """The development samples of a partitioned cohort, and their outer folds.

    splits.tsv, samples.tsv, variants.tsv and dosages.npy (markers x samples).  Labels and dosages of sealed samples
    are never read.  Files must have the digests in source_manifest.json, if there is one, and it must list those in LISTED.
    """
    manifest = Path(folder) / "source_manifest.json"
    if manifest.exists():
        recorded = {Path(a["path"]).name: a["sha256"] for a in json.loads(manifest.read_text())["artifacts"]}
        unlisted = [n for n in LISTED if n not in recorded]
        if unlisted:
            raise va.ContractError(f"the manifest doesn't list {unlisted[0]}")
        recorded = {n: d for n, d in recorded.items() if (Path(folder) / n).exists()}
        found = sinks.plain_digests(spark, [f"{folder}/{n}" for n in recorded])
        va.same_digests({Path(p).name: d for p, d in found.items()}, recorded)
    splits = readers.tsv(spark, f"{folder}/splits.tsv", ["accession_id", "group_id", "partition", "outer_fold"])
    splits = splits.select(F.col("accession_id").alias("sample_id"), "group_id", "partition", F.col("outer_fold").try_cast("int").alias("outer_fold"))
    va.check_samples(splits)
    va.check_cohort(splits, folds, sizes)
    labels = readers.development_labels(_phenotypes(spark, f"{folder}/phenotypes.tsv", trait).filter("value is not null"), splits)
    places = readers.tsv(spark, f"{folder}/samples.tsv", ["normalized_id", "sample_index"]).select(F.col("normalized_id").alias("sample_id"), F.col("sample_index").cast("int").alias("sample_idx"))
    va.none_of(va.repeated(places, "sample_id"), "Repeated ids")
    dev = splits.filter("partition = 'development'")
    rows = dev.join(places, "sample_id", "left").join(labels.select("sample_id", "value"), "sample_id", "left").orderBy("sample_id").collect()
    lacking = [r.sample_id for r in rows if r.sample_idx is None or r.value is None]
    if lacking:
        raise va.ContractError(f"{len(lacking)} development samples lack genotypes or a value, {lacking[0]} first")
    raw = readers.numbered(readers.tsv(spark, f"{folder}/variants.tsv", ["CHROM", "POS"]), "marker_idx")
    variants = raw.select("marker_idx", F.col("CHROM").alias("chrom"), F.col("POS").cast("bigint").alias("pos")).cache()
    va.array_contract(np.load(f"{folder}/dosages.npy", mmap_mode="r"), (variants.count(), places.count()))
    vec = readers.npy(spark, f"{folder}/dosages.npy", 0, [r.sample_idx for r in rows]).cache()
    study = Study([r.sample_id for r in rows], np.array([r.value for r in rows]), vec, variants, [r.group_id for r in rows])
    return study, {r.sample_id: r.outer_fold for r in rows}


def load_wide(spark: SparkSession, genotypes: str, phenotypes: str, folds: str, trait: str, count: int | None = None) -> tuple[Study, dict[str, int]]:
    """Complete samples of a wide genotype table, a phenotype table and folds numbered from 1."""
    samples, vec = readers.wide_parquet(spark, genotypes)
    va.check_samples(samples)
    labels = readers.phenotypes_of(spark, phenotypes, trait, samples)
    va.none_of(va.repeated(labels, "sample_id"), "Repeated phenotype")
    split = readers.csv(spark, folds, ["sample_id", "fold"]).select("sample_id", zero_based(F.col("fold")).alias("outer_fold"))
    va.check_splits(samples, split)
    va.fold_labels(split, count)
    rows = samples.join(labels, "sample_id", "left").join(split, "sample_id").orderBy("sample_idx").collect()
    if any(r.value is None or not np.isfinite(r.value) for r in rows):
        raise va.ContractError("every sample needs a finite value")
    n = vec.count()
    variants = spark.range(n).select(F.col("id").cast("int").alias("marker_idx"))
    return Study([r.sample_id for r in rows], np.array([r.value for r in rows]), vec.cache(), variants), {r.sample_id: r.outer_fold for r in rows}


def _dealt(samples: DataFrame, k: int, seed: int, protocol: str, context: str) -> DataFrame:
    """Folds by protocol: at random, one a group, or whole near-clone blocks to k folds of balanced size."""
    if protocol == "group":
        return fo.group_out(samples)
    return fo.balanced_groups(samples, k, seed, context) if protocol == "clone" else fo.random_folds(samples, k, seed)


def outer_and_inner(spark: SparkSession, study: Study, config: DensityConfig, protocol: str, splits: str | None) -> tuple[dict, dict]:
    frame = lambda ids, groups: spark.createDataFrame(list(zip(ids, groups)), "sample_id string, group_id string")
    as_dict = lambda df: {r.sample_id: r.fold for r in df.select("sample_id", "fold").collect()}
    if protocol == "clone":
        with Stage(spark) as stage:
            of_place = {r.node: r.block for r in clones.blocks(study.vec, len(study.ids), stage, config.clone_limit).collect()}  # a number a sample
        study.groups = [f"b{of_place[i]:08d}" for i in range(len(study.ids))]
    everyone = frame(study.ids, study.groups)
    if splits:
        given = readers.tsv(spark, splits, ["accession_id", "fold"]).select(F.col("accession_id").alias("sample_id"), F.col("fold").cast("int").alias("outer_fold"))
        given = given.join(everyone, "sample_id", "left") if protocol != "iid" else given
        va.check_splits(everyone, given)
        outer = as_dict(given.withColumnRenamed("outer_fold", "fold"))
    else:
        outer = as_dict(_dealt(everyone, config.outer_folds, config.seed, protocol, "outer"))
    of, inner = dict(zip(study.ids, study.groups)), {}
    for f in sorted(set(outer.values())):
        train = [s for s in study.ids if outer[s] != f]
        own = frame(train, [of[s] for s in train])
        inner[f] = as_dict(_dealt(own, config.inner_folds, config.seed + f + 1, protocol, f"inner:{f}"))
    return outer, inner


def _save(frames: dict[str, DataFrame | None], out: Path) -> None:
    for name, df in frames.items():
        if df is not None:
            df.write.mode("overwrite").parquet(str(out / name))


def executors(spark: SparkSession) -> list[dict]:
    """Id, task seconds and peak JVM heap of each executor so far, from the status store."""
    store, out = spark.sparkContext._jsc.sc().statusStore(), []
    listed = store.executorList(False)
    for i in range(listed.size()):
        e = listed.apply(i)
        peaks = e.peakMemoryMetrics()
        heap = peaks.get().getMetricValue("JVMHeapMemory") if peaks.isDefined() else None
        out.append({"executor": e.id(), "task_seconds": e.totalDuration() / 1000, "tasks": e.totalTasks(), "shuffle_bytes": e.totalShuffleWrite(), "peak_heap_bytes": heap})
    return out


def _cost(spark: SparkSession, began: float, **more) -> dict:
    """Seconds since ``began``, the driver's greatest memory, and what executors have used."""
    return {**more, "seconds": time.perf_counter() - began, "driver_peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "executors": executors(spark)}


def by_fold(spark: SparkSession, out: Path, outer: dict[str, int], run: Callable[[list[int], Stage], dict[str, DataFrame]], profile: bool) -> None:
    """Outer folds one after another, each complete in its folder before the next; those that are complete are left alone.

    What a fold stages goes when the fold is written.
    """
    folds = sorted(set(outer.values()))
    for f in folds[:1] if profile else folds:
        own = out / f"fold_{f}"
        if (own / "complete.json").exists():
            sinks.log.info("fold %d is complete", f)
            continue
        began = time.perf_counter()
        with Stage(spark) as stage:
            _save(run([f], stage), own)
        test = sum(v == f for v in outer.values())
        sinks.write_json(_cost(spark, began, status="complete", fold=f, train_samples=len(outer) - test, test_samples=test), str(own / "complete.json"))


def _gathered(spark: SparkSession, out: Path, name: str, folds: list[int]) -> DataFrame:
    lacking = [f for f in folds if not (out / f"fold_{f}" / "complete.json").exists()]
    if lacking:
        raise va.ContractError(f"fold {lacking[0]} has not been finished")
    return spark.read.parquet(*[str(out / f"fold_{f}" / name) for f in folds])


def report(spark: SparkSession, out: str, published: dict[str, str] | None = None, replicates: int | None = None) -> None:
    """Pooled metrics, comparisons, costs and a page of text from the folds of ``ladder`` or ``encodings``."""
    folder = Path(out)
    identity = json.loads((folder / "identity.json").read_text())
    outer = json.loads((folder / "splits.json").read_text())["outer"]
    replicates = replicates or (BLOCK_REPLICATES if identity.get("protocol") == "clone" else REPLICATES)
    folds, ids = sorted(set(outer.values())), spark.createDataFrame([(s,) for s in outer], "sample_id string")
    pred = _gathered(spark, folder, "predictions", folds).cache()
    ladder = identity["command"] == "ladder"
    keys = ["strategy", "budget"] if ladder else ["model"]
    va.check_predictions(pred, ids, keys)
    _save({"predictions": pred, "search": _gathered(spark, folder, "search", folds), "fits": _gathered(spark, folder, "fits", folds)}, folder)
    frames: dict[str, DataFrame] = {}
    if ladder:
        frames["metrics"] = metrics.ladder_metrics(pred)
        rows = [(r.strategy, r.budget) for r in frames["metrics"].select("strategy", "budget").collect()]
        names = [s for s in ("physical", "ld") if any(s == x for x, _ in rows)]
        wanted = compare.pairs(spark, sorted({b for _, b in rows}), names)
        errors = compare.paired_errors(pred, wanted).cache()
        sums = compare.group_sums(errors).cache()
        limits = compare.decision(compare.bootstrap(compare.seeded_replicates(sums, wanted.count(), replicates, identity["config"]["seed"])))
        frames["comparisons"] = wanted.join(compare.paired_summary(errors), "pair").join(limits, "pair").orderBy("pair")
    else:
        frames["metrics"] = metrics.pooled_and_by_fold(pred, keys)
        theirs = None
        for name, path in (published or {}).items():
            figures = readers.published_folds(spark.read.text(path, wholetext=True)).cache()
            own = frames["metrics"].filter("fold is not null")
            sizes = own.select("fold", "n").distinct()
            one = metrics.weighted_comparison(own, figures, sizes).select(F.lit(name).alias("reference"), "*")
            theirs = one if theirs is None else theirs.unionByName(one)
        if theirs is not None:
            frames["historical"] = theirs
    _save(frames, folder)
    sinks.write_json([json.loads((folder / f"fold_{f}" / "complete.json").read_text()) for f in folds], str(folder / "costs.json"))
    notes = ["Penalties come from inner folds of training samples alone.", "Intervals draw whole groups within outer folds; predictions are fixed."]
    tables = [sinks.markdown(spark.read.parquet(str(folder / n)), n, notes if n == "metrics" else ()) for n in frames]
    (folder / "report.md").write_text("\n".join(tables), encoding="utf-8")
    sinks.write_json({"status": "complete", "samples": len(outer), "outer_folds": len(folds)}, str(folder / "complete.json"))


def _density_study(spark: SparkSession, a: argparse.Namespace, given: dict) -> int:
    config = DensityConfig(**{k: v for k, v in given.items() if k in DensityConfig.__dataclass_fields__})
    if Path(a.out).exists():
        raise FileExistsError(a.out)
    began = time.perf_counter()
    study = load(spark, a.data, a.trait)
    outer, inner = outer_and_inner(spark, study, config, a.protocol, a.splits)
    frames = run_densities(study, config, outer, inner, sorted(set(outer.values()))[:1] if a.profile else None)
    out = sinks.new_folder(a.out)  # after the inputs have passed, so that a bad one doesn't block the next try
    sinks.write_json({"outer": outer, "inner": {str(k): v for k, v in inner.items()}}, str(out / "splits.json"))
    _save(frames, out)
    sinks.write_json(_cost(spark, began, command="run", trait=a.trait, samples=len(study.ids), status="complete"), str(out / "run.json"))
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="densitylab")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("demo").add_argument("--out", required=True)
    for name in ("run", "ladder", "encodings"):
        p = sub.add_parser(name)
        p.add_argument("--trait", required=True)
        p.add_argument("--out", required=True, help="ladder and encodings go on in a folder of the same run")
        p.add_argument("--config")
        p.add_argument("--profile", action="store_true", help="the first fold alone")
        p.add_argument("--data", required=name != "encodings", help="folder of the study; a partitioned cohort if it has dosages.npy")
        if name != "encodings":
            p.add_argument("--protocol", choices=["iid", "group", "clone"], default="iid")
            p.add_argument("--splits")
        else:
            p.add_argument("--genotypes", help="wide Parquet file")
            p.add_argument("--phenotypes", help="Parquet file")
            p.add_argument("--folds", help="CSV file of sample_id, fold")
    p = sub.add_parser("report")
    p.add_argument("--out", required=True)
    p.add_argument("--published", action="append", default=[], metavar="NAME=FILE")
    a = parser.parse_args(args)
    if a.command == "demo":
        readers.write_demo(a.out)
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "report":
        report(spark, a.out, dict(p.split("=", 1) for p in a.published))
        return 0
    given = readers.config(a.config) if a.config else {}
    if a.command == "run":
        return _density_study(spark, a, given)
    if a.command == "ladder":
        config = LadderConfig(**{k: v for k, v in given.items() if k in LadderConfig.__dataclass_fields__})
        cohort = (Path(a.data) / "dosages.npy").exists()
        files = inputs_of(a.data, cohort) + [a.splits] * bool(a.splits)
        if cohort:
            study, outer = load_cohort(spark, a.data, a.trait, given.get("outer_folds"), given.get("cohort"))
        else:
            study = load(spark, a.data, a.trait)
            outer, _ = outer_and_inner(spark, study, DensityConfig(seed=config.seed, outer_folds=given.get("outer_folds", 10)), a.protocol, a.splits)
        settings, run = {**config.__dict__}, lambda only, stage: run_ladder(study, config, outer, only, stage)
    else:
        if a.data:
            files = inputs_of(a.data)
            study = load(spark, a.data, a.trait)
            outer, _ = outer_and_inner(spark, study, DensityConfig(outer_folds=given.get("outer_folds", 10)), "iid", None)
        else:
            files = [a.genotypes, a.phenotypes, a.folds]
            study, outer = load_wide(spark, a.genotypes, a.phenotypes, a.folds, a.trait, given.get("outer_folds"))
        settings = {k: given[k] for k in ("inner_folds", "seed", "rhos", "bounds", "residual") if k in given}
        run = lambda only, stage: run_encodings(study, outer, **settings, only=only, stage=stage)
    inputs = sinks.input_digests(spark, files, f"{a.out}/inputs.json")
    out = sinks.resume(a.out, {"command": a.command, "trait": a.trait, "config": settings, "outer": sinks.text_digest(json.dumps(outer, sort_keys=True)), "inputs": inputs, "protocol": getattr(a, "protocol", "iid")})
    if not (out / "splits.json").exists():
        sinks.write_json({"python": sys.version, "numpy": np.__version__, "spark": spark.version, "machine": platform.machine()}, str(out / "environment.json"))
        sinks.write_tsv(study.variants.orderBy("marker_idx"), str(out / "marker_catalog.tsv"), mode="overwrite")
        rows = spark.createDataFrame([(s, f) for s, f in outer.items()], "sample_id string, outer_fold int")
        sinks.write_tsv(rows.orderBy("sample_id"), str(out / "outer_splits.tsv"), mode="overwrite")
        sinks.write_json({"outer": outer}, str(out / "splits.json"))  # last, so that a run that stopped before writes all of them again
    by_fold(spark, out, outer, run, a.profile)
    if not a.profile:
        report(spark, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
