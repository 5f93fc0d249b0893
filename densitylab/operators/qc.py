"""Training-only marker statistics and filters (A1-A5).

``long`` frames have fit_id (optional), marker_idx, g (null: missing) and hold
training rows only; the ``vec`` forms take marker_vec and the training positions
and stay inside the row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import minor_count, minor_frequency
from .validate import thresholds


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("fit_id", "marker_idx") if c in df.columns]


def counts(long: DataFrame) -> DataFrame:
    """called, rows, total, mean and population variance of each marker."""
    g = F.col("g").cast("double")
    return long.groupBy(*_keys(long)).agg(F.count("g").alias("called"), F.count("*").alias("rows"), F.coalesce(F.sum("g"), F.lit(0)).alias("total"), F.avg(g).alias("mean"), F.var_pop(g).alias("variance"))


def _filtered(stats: DataFrame, call: float, maf: float, mac: int) -> DataFrame:
    thresholds(call, maf, mac)
    out = stats.filter("called > 0").withColumn("p", F.col("mean") / 2).withColumn("call_rate", F.col("called") / F.col("rows")).withColumn("mac", minor_count(F.col("total"), F.col("called")))
    return out.filter((F.col("call_rate") >= call) & (F.col("mac") > 0) & (minor_frequency(F.col("p")) >= maf) & (F.col("mac") >= mac))


def eligible(long: DataFrame, call: float = 0.95, maf: float = 0.05, mac: int = 0) -> DataFrame:
    """A1: [fit_id,] marker_idx, mean, p, call_rate, mac of the markers that pass.  A marker with only heterozygotes passes."""
    s = _filtered(counts(long), call, maf, mac)
    return s.select(*_keys(long), "mean", "p", "call_rate", "mac")


def varying(long: DataFrame, call: float = 0.98, maf: float = 0.01) -> DataFrame:
    """A2: means of all markers and whether each is kept; a marker without variance is not."""
    s = counts(long)
    mean = F.coalesce("mean", F.lit(0.0))
    keep = (F.col("called") / F.col("rows") >= call) & (minor_frequency(mean / 2) >= maf) & (F.coalesce("variance", F.lit(0.0)) > 0)
    return s.select(*_keys(long), mean.alias("mean"), keep.alias("keep"))


def scaler(long: DataFrame, standardize: bool = True) -> DataFrame:
    """A3: mean and scale (population deviation; 1 for a constant column or without standardising)."""
    g = F.col("g").cast("double")
    s = long.groupBy(*_keys(long)).agg(F.avg(g).alias("mean"), F.stddev_pop(g).alias("sd"), F.min(g).alias("lo"), F.max(g).alias("hi"))
    scale = F.when(F.lit(not standardize) | (F.col("lo") == F.col("hi")), F.lit(1.0)).otherwise(F.col("sd"))
    return s.select(*_keys(long), "mean", scale.alias("scale"))


def vec_counts(vec: DataFrame, train: Sequence[int]) -> DataFrame:
    """The same statistics from marker_vec."""
    return fit_counts(vec, {"all": train}).drop("fit_id").withColumn("total", F.col("total").cast("bigint"))


def vec_eligible(vec: DataFrame, train: Sequence[int], call: float = 0.95, maf: float = 0.05, mac: int = 0) -> DataFrame:
    return _filtered(vec_counts(vec, train), call, maf, mac).select("marker_idx", "mean", "p", "call_rate", "mac")


def strips(batches: Iterator[pa.RecordBatch], column: int, limit: int = 32 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their dosages as doubles (missing: NaN) of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, limit // (8 * max(1, len(batch.column(column)[0]))))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, part.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def packed(positions: Sequence[int]) -> np.ndarray:
    """Positions as bits, to travel with a function."""
    at = np.asarray(positions, np.int64)
    mark = np.zeros(at.max(initial=-1) + 1, bool)
    mark[at] = True
    return np.packbits(mark)


def unpacked(marks: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(marks))


def fit_counts(vec: DataFrame, trains: dict[str, Sequence[int]]) -> DataFrame:
    """fit_id and the columns of ``counts`` for all fits at once: one scan, no shuffle.

    Training positions travel with the function, so plans stay small however many samples there are.
    """
    at = {f: packed(t) for f, t in trains.items()}

    def run(batches):
        for part, g in strips(batches, 1):
            for fit, marks in at.items():
                train = unpacked(marks)
                x = g[:, train]
                known = ~np.isnan(x)
                called, x = known.sum(1), np.where(known, x, 0.0)
                total = x.sum(1)
                mean = total / np.maximum(called, 1)
                spread = (np.where(known, x - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(called, 1)
                flat = np.where(known, x, np.inf).min(1, initial=np.inf) == np.where(known, x, -np.inf).max(1, initial=-np.inf)
                none = called == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fit] * len(part)),
                        part.column(0),
                        pa.array(called, pa.int64()),
                        pa.array(np.full(len(part), len(train)), pa.int64()),
                        pa.array(total),
                        pa.array(mean, mask=none),
                        pa.array(np.where(flat, 0.0, spread), mask=none),
                    ],
                    names=["fit_id", "marker_idx", "called", "rows", "total", "mean", "variance"],
                )

    return vec.select("marker_idx", "g").mapInArrow(run, "fit_id string, marker_idx int, called bigint, rows bigint, total double, mean double, variance double")


def fit_eligible(vec: DataFrame, trains: dict[str, Sequence[int]], call: float = 0.95, maf: float = 0.05, mac: int = 0) -> DataFrame:
    """A1 for all fits."""
    return _filtered(fit_counts(vec, trains), call, maf, mac).select("fit_id", "marker_idx", "mean", "p", "call_rate", "mac")


def kernel_scale(qc: DataFrame) -> DataFrame:
    """A4: sum of 2 p (1 - p), by fit where there are several."""
    keys = ["fit_id"] if "fit_id" in qc.columns else []
    return qc.groupBy(*keys).agg(F.sum(2 * F.col("p") * (1 - F.col("p"))).alias("scale"))


def kernel_trace(long: DataFrame, stats: DataFrame) -> DataFrame:
    """A5: trace of Z Z' over the rows, divided by their number, without the kernel."""
    z = F.coalesce(F.col("g") - F.col("mean"), F.lit(0.0))
    joined = long.join(stats.select("marker_idx", "mean"), "marker_idx")
    return joined.agg((F.sum(z * z) / F.count_distinct("sample_idx")).alias("trace"))
