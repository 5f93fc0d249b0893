"""Partitions of samples for cross-validation."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import tabbed_digest
from .validate import ContractError
from .validate import folds as check_folds


def random_folds(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """sample_id, fold by a seeded permutation of the sorted ids; the same for any order of the rows."""
    ids = np.array(sorted(str(r.sample_id) for r in samples.select("sample_id").collect()))
    check_folds(k, len(ids))
    shuffled = np.random.default_rng(seed).permutation(len(ids))
    return samples.sparkSession.createDataFrame([(str(ids[i]), j % k) for j, i in enumerate(shuffled)], "sample_id string, fold int")


def hashed_folds(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """C1 without a driver: ranks of keyed digests, dealt round-robin."""
    from .ordering import ranked

    h = samples.select("sample_id", tabbed_digest(seed, F.col("sample_id")).alias("h"))
    return ranked(h, "h", "sample_id").select("sample_id", (F.col("rank") % k).alias("fold"))


def group_out(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """One fold a group, numbered in the groups' order."""
    names = samples.select(group).distinct()
    if names.filter(F.col(group).isNull() | (F.trim(F.col(group).cast("string")) == "")).count() or names.count() < 2:
        raise ContractError("at least two groups with a name are needed")
    number = names.withColumn("fold", F.dense_rank().over(Window.orderBy(group)) - 1)  # a fold each, so they are few
    return samples.join(number, group).select("sample_id", group, "fold")


def balanced_groups(samples: DataFrame, k: int, seed: int, context: str, group: str = "group_id") -> DataFrame:
    """Groups by falling size, then digest, each to the least loaded fold (the first of equals).

    The order is made in ranges and the deal is one pass over group sizes in that order, with k loads in hand.
    """
    sizes = samples.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", tabbed_digest(seed, context, F.col(group)))
    ordered = sizes.orderBy(F.desc("n"), "h", group).select(F.col(group).cast("string").alias(group), "n").coalesce(1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, f) for f in range(k)]  # a heap: least load first, then the first fold
        for batch in batches:
            folds = []
            for n in batch.column(1).to_pylist():
                load, fold = loads[0]
                heapq.heapreplace(loads, (load + n, fold))
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds, pa.int32())], names=[group, "fold"])

    plan = ordered.mapInArrow(deal, f"{group} string, fold int")
    return samples.join(plan, group).select("sample_id", group, "fold")


def balanced_groups_local(groups: Sequence[str], k: int, seed: int, context: str) -> np.ndarray:
    """C3 for a list on the driver, as inner splits need it."""
    names, which, counts = np.unique(np.asarray(groups, dtype=str), return_inverse=True, return_counts=True)
    digests = np.frombuffer(b"".join(hashlib.sha256(f"{seed}\t{context}\t{g}".encode()).digest() for g in names), ">u8").reshape(-1, 4)
    loads, fold = [0] * k, np.zeros(len(names), np.int64)
    for g in np.lexsort((*digests.T[::-1], -counts)):  # names, which are sorted, break ties
        fold[g] = loads.index(min(loads))
        loads[fold[g]] += int(counts[g])
    return fold[which]


def fit_table(outer: dict[str, int], inner: dict[int, dict[str, int]], only: Sequence[int] | None = None) -> list[tuple[str, list[str], list[str]]]:
    """C4: (fit_id, training ids, test ids) for outer/f and inner/f/i, ids sorted; of the outer folds ``only``, if given."""
    out = []
    for f in sorted(set(outer.values())) if only is None else only:
        train = sorted(s for s, g in outer.items() if g != f)
        out.append((f"outer/{f}", train, sorted(s for s, g in outer.items() if g == f)))
        for i in sorted(set(inner.get(f, {}).values())):
            own = inner[f]
            out.append((f"inner/{f}/{i}", sorted(s for s in train if own[s] != i), sorted(s for s in train if own[s] == i)))
    for fit, train, test in out:
        if len(train) < 2 or not test:
            raise ContractError(f"{fit} has {len(train)} training and {len(test)} test samples")
    return out


#: The fold of a sample that takes no part.
ABSENT = np.iinfo(np.int32).min


def codes(ids: Sequence[str], fold_of: Mapping[str, int] | np.ndarray) -> np.ndarray:
    """Folds by position, of a mapping or already so."""
    if isinstance(fold_of, Mapping):
        if len(fold_of.keys() & set(ids)) < len(fold_of):
            raise KeyError("folds name samples that aren't in the study")
        return np.fromiter((fold_of.get(s, ABSENT) for s in ids), np.int32, len(ids))
    return np.asarray(fold_of, np.int32)


def fit_positions(order: np.ndarray, outer: np.ndarray, inner: Mapping[int, np.ndarray], only: Sequence[int] | None = None) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """``fit_table`` by positions: folds are arrays, and ``order`` has the positions by id."""
    order, out = np.asarray(order, np.int32), []
    order = order[outer[order] != ABSENT]
    for f in np.unique(outer[order]).tolist() if only is None else only:
        train = order[outer[order] != f]
        out.append((f"outer/{f}", train, order[outer[order] == f]))
        own = inner[f][train] if f in inner else np.zeros(0, np.int32)
        if (own == ABSENT).any():
            raise ContractError(f"a training sample of fold {f} has no inner fold")
        out += [(f"inner/{f}/{i}", train[own != i], train[own == i]) for i in np.unique(own).tolist()]
    for fit, train, test in out:
        if len(train) < 2 or not len(test):
            raise ContractError(f"{fit} has {len(train)} training and {len(test)} test samples")
    return out
