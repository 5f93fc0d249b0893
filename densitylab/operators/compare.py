"""Paired comparisons and whole-group bootstraps."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .validate import none_of


def pairs(spark: SparkSession, budgets: Sequence[int], strategies: Sequence[str] = ("physical", "ld")) -> DataFrame:
    """Adjacent budgets, the whole panel against the least, and the strategies at each smaller budget."""
    rows = []
    for s in strategies:
        rows += [("adjacent", s, a, s, b) for a, b in zip(budgets, budgets[1:])]
        rows.append(("full_vs_sparse", s, budgets[0], s, budgets[-1]))
    rows += [("strategy", strategies[0], b, s, b) for s in strategies[1:] for b in budgets[:-1]]
    kinds = "pair int, kind string, reference_strategy string, reference_budget int, candidate_strategy string, candidate_budget int"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kinds)


def paired_errors(pred: DataFrame, wanted: DataFrame) -> DataFrame:
    """pair, sample_id, group_id, fold, base (reference's squared error), delta (candidate's less it)."""
    e = pred.select("sample_id", "group_id", "fold", "strategy", "budget", ((F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction"))).alias("e"))
    a = e.join(F.broadcast(wanted), (e["strategy"] == F.col("reference_strategy")) & (e["budget"] == F.col("reference_budget"))).select("pair", "sample_id", "group_id", "fold", F.col("e").alias("base"))
    b = e.join(F.broadcast(wanted), (e["strategy"] == F.col("candidate_strategy")) & (e["budget"] == F.col("candidate_budget"))).select("pair", "sample_id", F.col("e").alias("other"))
    both = a.join(b, ["pair", "sample_id"], "full_outer")
    none_of(both.filter("base is null or other is null").select("pair", "sample_id"), "Paired ids differ")
    return both.select("pair", "sample_id", "group_id", "fold", "base", (F.col("other") - F.col("base")).alias("delta"))


def paired_summary(errors: DataFrame) -> DataFrame:
    """delta_mse, relative_mse_gain, improved_outer_folds by pair."""
    by_fold = errors.groupBy("pair", "fold").agg(F.sum("delta").alias("d"), F.sum("base").alias("b"), F.count("*").alias("n"))
    return by_fold.groupBy("pair").agg((F.sum("d") / F.sum("n")).alias("delta_mse"), F.try_divide(-F.sum("d"), F.nullif(F.sum("b"), F.lit(0.0))).alias("relative_mse_gain"), F.count_if(F.col("d") < 0).alias("improved_outer_folds"))


def group_sums(errors: DataFrame) -> DataFrame:
    """Pair, fold, group_id with the sums of delta and base, and the count."""
    return errors.groupBy("pair", "fold", "group_id").agg(F.sum("delta").alias("d"), F.sum("base").alias("b"), F.count("*").alias("n"))


def _intervals(reps: DataFrame) -> DataFrame:
    q = F.array(F.lit(0.025), F.lit(0.975))
    return reps.groupBy("pair").agg(F.percentile("delta_mse", q).alias("delta_mse_ci95"), F.percentile("gain", q).alias("relative_gain_ci95"))


def seeded_replicates(sums: DataFrame, n_pairs: int, replicates: int, seed: int, batch: int = 100) -> DataFrame:
    """Pair, rep, delta_mse, gain of a stream of one generator, drawn pair after pair and replicate after replicate.

    The driver runs the generator once and keeps nothing but its state before each batch of replicates; a task takes
    up the state of its batch, draws again and multiplies the groups' multiplicities with their sums.  Group names and their folds, the
    bounded unit of this form, are the only rows on the driver; ``hashed_replicates`` has no such bound.
    """
    spark = sums.sparkSession
    rows = sums.select("fold", F.col("group_id").cast("string").alias("g")).distinct().collect()
    names = sorted({r.g for r in rows})
    at = {g: i for i, g in enumerate(names)}
    strata = [np.array(sorted({at[r.g] for r in rows if r.fold == f})) for f in sorted({r.fold for r in rows})]
    rng, starts = np.random.default_rng(seed), []
    for p in range(n_pairs):
        for r in range(replicates):
            if r % batch == 0:
                starts.append((p, r, min(batch, replicates - r), json.dumps(rng.bit_generator.state)))
            for s in strata:
                rng.choice(s, len(s), replace=True)
    work = spark.createDataFrame(starts, "pair int, first int, n int, state string")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("pair", pa.int32()), ("rep", pa.int32()), ("delta_mse", pa.float64()), ("gain", pa.float64())])
        table = np.zeros((len(names), 3))
        for g, *own in zip(*(right.column(c).to_pylist() for c in ("group_id", "d", "b", "n"))):
            table[at[g]] += own
        out = []
        for pair, first, n, state in zip(*(left.column(c).to_pylist() for c in ("pair", "first", "n", "state"))):
            own = np.random.default_rng()
            own.bit_generator.state = json.loads(state)
            for r in range(first, first + n):
                times = np.zeros(len(names), np.int64)
                for s in strata:
                    times += np.bincount(own.choice(s, len(s), replace=True), minlength=len(names))
                d, b, m = times @ table
                out.append((pair, r, d / m, -d / b if b else None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds.types)], schema=kinds)

    named = sums.select("pair", F.col("group_id").cast("string").alias("group_id"), "d", "b", "n")
    every = named.join(work.select(F.col("pair").alias("p"), F.col("first").alias("f")), F.col("pair") == F.col("p")).select("p", "f", "group_id", "d", "b", "n")
    return work.groupBy("pair", "first").cogroup(every.groupBy("p", "f")).applyInArrow(run, "pair int, rep int, delta_mse double, gain double")


def bootstrap(replicates: DataFrame) -> DataFrame:
    """95 % intervals of the ratios over the replicates."""
    return _intervals(replicates)


#: Fixed value: the multiplier of a well-known hash of 32 bits.
MIX = 0x45D9F3B
_BITS = 0xFFFFFFFF


def mixed(x: Column) -> Column:
    """A hash of 32 bits of a bigint below 2^32, in plain arithmetic."""
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX).cast("bigint")).bitwiseAND(F.lit(_BITS))
    return F.shiftright(x, 16).bitwiseXOR(x)


def mixed_number(x: int) -> int:
    for _ in range(2):
        x = ((x >> 16 ^ x) * MIX) & _BITS
    return x >> 16 ^ x


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    """``mixed`` of 32-bit integers, whose products wrap by themselves."""
    for _ in range(2):
        x = (x >> np.uint32(16) ^ x) * np.uint32(MIX)
    return x >> np.uint32(16) ^ x


def hashed_replicates(sums: DataFrame, replicates: int, seed: int, batch: int = 125, segment: int = 1 << 20) -> DataFrame:
    """I3 without a driver: in each fold, draw k of a replicate takes the group numbered by a hash of the counter mod the fold's groups.

    The counter is seed, pair, fold (a number), replicate and k, mixed in one after another.  A task has a segment of a fold's groups
    and a batch of replicates: it counts how often their draws take each group and multiplies the counts with the groups'
    sums, so no row is made for a draw, and memory is bounded by the segment, whatever the groups.
    """
    number = sums.withColumn("i", F.row_number().over(Window.partitionBy("pair", "fold").orderBy("group_id")).cast("bigint") - 1)
    with_key = lambda df, name: df.withColumn("h", mixed((F.col("h") + F.col(name)).bitwiseAND(F.lit(_BITS))))
    sizes = with_key(with_key(sums.groupBy("pair", "fold").agg(F.count("*").alias("m")).withColumn("h", F.lit(mixed_number(seed)).cast("bigint")), "pair"), "fold")
    firsts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(batch))).alias("first")
    dealt = number.join(sizes, ["pair", "fold"]).select("pair", "fold", F.floor(F.col("i") / segment).alias("segment"), firsts, "i", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("d", "b")], F.col("n").cast("double").alias("n"), "m", "h")
    kinds = pa.schema([("pair", pa.int32()), ("rep", pa.int32()), ("d", pa.float64()), ("b", pa.float64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, parts = None, [], []
        for rows in (x for x in batches if x.num_rows):
            at = at or [rows.column(c)[0].as_py() for c in ("pair", "segment", "first", "m", "h")]
            own.append(rows.column("i").to_numpy())
            parts.append(np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("d", "b", "n")], 1))
        pair, part, first, m, h = at
        lo, own = part * segment, np.concatenate(own)
        here = min(segment, m - lo)
        table = np.zeros((here, 3))
        table[own - lo] = np.concatenate(parts)
        out = []
        for rep in range(first, min(first + batch, replicates)):
            start = mixed_number((h + rep) & _BITS)
            times = np.zeros(here, np.int64)
            for k in range(0, m, segment):
                counter = (np.arange(k, min(m, k + segment), dtype=np.uint64) + np.uint64(start)).astype(np.uint32)
                i = (_mixed_bits(counter) % np.uint32(m)).astype(np.int64)
                times += np.bincount(i if here == m else i[(i >= lo) & (i < lo + here)] - lo, minlength=here)
            out.append((pair, rep, *(times.astype(np.float64) @ table).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    each = dealt.groupBy("pair", "fold", "segment", "first").applyInArrow(run, "pair int, rep int, d double, b double, n double")
    d, b, n = (F.sum(c) for c in ("d", "b", "n"))
    return each.groupBy("pair", "rep").agg((d / n).alias("delta_mse"), F.try_divide(-d, F.nullif(b, F.lit(0.0))).alias("gain"))


def decision(intervals: DataFrame, sesoi: float = 0.01) -> DataFrame:
    """What the interval of the relative gain says against the least gain of interest."""
    lo, hi = F.col("relative_gain_ci95")[0], F.col("relative_gain_ci95")[1]
    verdict = F.when(lo > sesoi, "improved").when(hi < -sesoi, "worse").when((lo > -sesoi) & (hi < sesoi), "equivalent").otherwise("undecided")
    return intervals.withColumn("decision", verdict)
