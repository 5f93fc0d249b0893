"""Contracts of the inputs, as queries over their violations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite


class ContractError(ValueError):
    pass


def none_of(bad: DataFrame, message: str) -> None:
    """Raise if there is a row; the message shows the first few."""
    rows = bad.limit(3).collect()
    if rows:
        raise ContractError(f"{message}: {', '.join(str(tuple(r)) for r in rows)}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def bad_ids(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.filter(k.isNull() | (k == "") | (F.trim(k) != k)).select(key)


def bad_variants(v: DataFrame, chroms: Sequence[str] = ("1", "2", "3", "4", "5")) -> DataFrame:
    """Chromosome outside the domain, position under 1, or not a biallelic SNP."""
    base = "^[ACGT]$"
    snp = F.col("ref").rlike(base) & F.col("alt").rlike(base) & (F.col("ref") != F.col("alt"))
    return v.filter(~F.coalesce(F.col("chrom").isin(list(chroms)) & (F.col("pos") >= 1) & snp, F.lit(False)))


def unordered_variants(v: DataFrame) -> DataFrame:
    """Rows that don't strictly follow the one before; each chromosome's markers are looked at by themselves, then their borders."""
    key = F.struct("pos", "ref", "alt")
    inside = Window.partitionBy("chrom").orderBy("marker_idx")
    steps = v.withColumn("before", F.lag(key).over(inside)).filter(F.col("before") >= key).select("marker_idx")
    spans = v.groupBy(F.col("chrom").cast("int").alias("c")).agg(F.min("marker_idx").alias("lo"), F.max("marker_idx").alias("hi"))
    follow = spans.alias("a").join(spans.alias("b"), F.expr("a.c < b.c and a.hi > b.lo")).select(F.col("b.lo").alias("marker_idx"))
    return steps.unionAll(follow)


def bad_dosages(long: DataFrame) -> DataFrame:
    return long.filter(F.col("g").isNotNull() & ~F.col("g").isin(0, 1, 2))


def not_finite(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~finite(F.col(column)))


def uncovered(ids: DataFrame, split: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids on one side only: an exact cover has none."""
    a, b = ids.select(key).withColumn("l", F.lit(1)), split.select(key).withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").filter("l is null or r is null").select(key)


def split_groups(split: DataFrame, group: str = "group_id", fold: str = "outer_fold") -> DataFrame:
    """Groups that stand in several folds."""
    return split.groupBy(group).agg(F.count_distinct(fold).alias("folds")).filter("folds > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def uneven_predictions(pred: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Workflows whose predictions don't cover every id once."""
    n = ids.select("sample_id").distinct().agg(F.count("*").alias("want"))
    got = pred.join(ids.select("sample_id").distinct(), "sample_id", "left").groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d"))
    return got.join(F.broadcast(n)).filter("n <> want or d <> want")


def finite_rows(df: DataFrame, columns: Sequence[str]) -> None:
    """What a score is computed from is finite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | ~finite(F.col(c))
    none_of(df.filter(bad).select("sample_id"), "Predictions must be finite")


def nested_panels(chosen: DataFrame) -> None:
    """A marker of a panel is in every larger one of its fit and strategy; ``chosen``: fit_id, strategy, budget, marker_idx."""
    own = ["fit_id", "strategy"]
    sizes = chosen.select(*own, "budget").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("budget"))))
    held = chosen.join(F.broadcast(sizes), [*own, "budget"]).groupBy(*own, "marker_idx").agg(F.max("place").alias("deepest"), F.count("*").alias("n"))
    none_of(held.filter("n <> deepest").select(*own, "marker_idx"), "Panels aren't nested")


def check_predictions(pred: DataFrame, ids: DataFrame, keys: Sequence[str]) -> None:
    """Finite values, and every id once in each workflow."""
    finite_rows(pred, ("y", "prediction", "train_mean"))
    if pred.isEmpty():
        raise ContractError("no predictions")
    none_of(uneven_predictions(pred, ids, keys), "Workflows don't predict every id once")


def disjoint_groups(fold_of: dict[str, int], members: Sequence[tuple[str, int]]) -> None:
    """No group stands on both sides of a split."""
    split = sorted({g for g, i in members if fold_of[g] != i})
    if split:
        raise ContractError(f"Groups across inner folds: {', '.join(split[:3])}")


def whole_groups(groups: np.ndarray, folds: np.ndarray) -> None:
    """V20 by position."""
    names, first, which = np.unique(groups, return_index=True, return_inverse=True)
    split = np.unique(which[folds != folds[first][which]])
    if len(split):
        raise ContractError(f"Groups across inner folds: {', '.join(map(str, names[split[:3]]))}")


def no_empty_panels(markers: dict[tuple[str, str], int]) -> None:
    """Every panel has a marker."""
    empty = sorted(k for k, n in markers.items() if not n)
    if empty:
        raise ContractError(f"No marker is left in panel {empty[0]}")


def check_cohort(splits: DataFrame, folds: int | None = None, sizes: dict[str, int] | None = None) -> None:
    """Development and sealed samples share neither an id nor a group; outer folds are 0 .. folds - 1; ``sizes`` by partition."""
    if sizes:
        found = {r.partition: r.n for r in splits.groupBy("partition").agg(F.count_distinct("sample_id").alias("n")).collect()}
        wrong = sorted(p for p, n in sizes.items() if found.get(p, 0) != n)
        if wrong:
            raise ContractError(f"{found.get(wrong[0], 0)} {wrong[0]} samples, not {sizes[wrong[0]]}")
    none_of(splits.filter("partition not in ('development', 'sealed')"), "Unknown partition")
    dev, sealed = splits.filter("partition = 'development'"), splits.filter("partition = 'sealed'")
    none_of(overlap(dev, sealed, "sample_id"), "Samples in both partitions")
    none_of(overlap(dev, sealed, "group_id"), "Groups in both partitions")
    none_of(split_groups(dev), "Groups across folds")
    if folds is not None:
        none_of(dev.filter(~F.coalesce(F.col("outer_fold").between(0, folds - 1), F.lit(False))), f"Folds are 0 to {folds - 1}")
        if dev.select("outer_fold").distinct().count() != folds:
            raise ContractError(f"not every one of {folds} folds has samples")


def array_contract(array, shape: tuple[int, int]) -> None:
    """V5, V6: a matrix of numbers of the shape that the manifests give, which aren't empty."""
    if 0 in shape:
        raise ContractError("empty manifest")
    if array.dtype.kind not in "fiu":
        raise ContractError(f"genotypes of type {array.dtype} aren't numbers")
    if array.shape != shape:
        raise ContractError(f"genotypes of shape {array.shape} don't fit the manifests, {shape}")


def same_digests(found: dict[str, str], recorded: dict[str, str]) -> None:
    """Files are those that were recorded."""
    wrong = sorted(n for n, d in recorded.items() if found.get(n) != d)
    if wrong:
        raise ContractError(f"Files differ from their recorded digests: {', '.join(wrong)}")


def positive(values: Sequence[float], what: str) -> None:
    import math

    if not values or any(not math.isfinite(v) or v <= 0 for v in values):
        raise ContractError(f"{what} must be positive and finite")


def density(value: int | str) -> None:
    if value != "all" and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
        raise ContractError("a density is a positive integer or 'all'")


def folds(k: int, n: int) -> None:
    if not 2 <= k <= n:
        raise ContractError(f"{k} folds of {n} rows")


def thresholds(call: float, maf: float, mac: int) -> None:
    if not (0 <= call <= 1 and 0 <= maf <= 0.5 and mac >= 0):
        raise ContractError("quality thresholds are out of range")


def check_variants(v: DataFrame) -> None:
    none_of(bad_variants(v), "Invalid variants")
    none_of(repeated(v, "chrom", "pos", "ref", "alt"), "Repeated variants")
    none_of(unordered_variants(v), "Variants must be strictly ordered")


def check_samples(s: DataFrame, key: str = "sample_id") -> None:
    none_of(bad_ids(s, key), "Empty or padded ids")
    none_of(repeated(s, key), "Repeated ids")


def check_phenotypes(p: DataFrame) -> None:
    """Repeats are looked for over all rows of a trait, missing values included."""
    none_of(repeated(p, "trait_id", "sample_id"), "Repeated phenotype")
    none_of(not_finite(p, "value"), "Phenotypes must be finite")


def fold_labels(split: DataFrame, folds: int | None = None, fold: str = "outer_fold") -> None:
    """Labels are 0 .. k - 1, each with a sample; k is ``folds`` if given."""
    found = sorted(r[0] for r in split.select(fold).distinct().collect())
    if found != list(range(folds or len(found))):
        raise ContractError(f"fold labels are {found[:3]} ..., not 0 to {(folds or len(found)) - 1}")


def check_splits(ids: DataFrame, split: DataFrame) -> None:
    none_of(repeated(split, "sample_id"), "Repeated ids in splits")
    none_of(uncovered(ids, split), "Splits don't cover the samples")
    none_of(split.filter("outer_fold is null or outer_fold < 0"), "Negative fold")
    if split.select("outer_fold").distinct().count() < 2:
        raise ContractError("fewer than two folds")
    if "group_id" in split.columns:
        none_of(split_groups(split), "Groups across folds")
