"""Deterministic marker orders and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bin_number, salted_digest, tabbed_digest
from .stage import Stage
from .validate import density as check_density


def ranked(df: DataFrame, *order, name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Rank from 0 in the whole table, or in each value of ``keys``, by ranges: positions inside a range plus the sizes of those before it.

    No task sees more than a range, so a catalogue of any size is ranked.  The cuts between ranges come from samples, which differ
    from one scan to the next, so the rows are staged with the range they fell in, and sizes and positions are of that one deal.
    """
    order = [*keys, *order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = Stage(df.sparkSession).put(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = inside.join(before.select("_part", "_before"), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_part", "_at", "_before")
    if not keys:
        return out
    return out.join(out.groupBy(*keys).agg(F.min(name).alias("_first")), list(keys)).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def hash_order(variants: DataFrame, salt: str) -> DataFrame:
    """marker_idx, rank by (digest of salt and marker_id, marker_id); stable under any order of the rows."""
    h = variants.select("marker_idx", "marker_id", salted_digest(salt, F.col("marker_id")).alias("digest"))
    return ranked(h, "digest", "marker_id").select("marker_idx", "rank")


def panel(order: DataFrame, qc: DataFrame, k: int | str) -> DataFrame:
    """R2: the first k eligible markers by rank, with their statistics; filter before prefix."""
    check_density(k)
    keys = ["fit_id"] if "fit_id" in qc.columns else []
    held = qc.join(order, "marker_idx")
    if k == "all":
        return held
    if not keys:  # TopK of the rank alone
        return held.join(held.select("rank").orderBy("rank").limit(int(k)), "rank", "left_semi")
    return held.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter(F.col("_k") <= int(k)).drop("_k")


def availability(n_eligible: int, k: int | str, outer: bool) -> tuple[int | None, bool]:
    """Markers used and whether capped; an outer panel that is too small is left out (None)."""
    if k == "all" or n_eligible >= int(k):
        return (n_eligible if k == "all" else int(k)), False
    return (None, False) if outer else (n_eligible, True)


def physical_order(variants: DataFrame, seed: int, width: int) -> DataFrame:
    """Round-robin over (chromosome, bin), digest order inside a bin."""
    h = variants.select("marker_idx", "chrom", bin_number(F.col("pos"), width).alias("bin"), tabbed_digest(seed, F.col("chrom"), F.col("pos"), F.col("marker_idx")).alias("h"))
    turn = h.withColumn("turn", F.row_number().over(Window.partitionBy("chrom", "bin").orderBy("h")))
    return ranked(turn, "turn", "chrom", "bin").select("marker_idx", "rank")


def prefix_then_qc(order: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` markers by rank, less those that fail; none comes instead."""
    return order.filter(F.col("rank") < budget).join(kept.select("marker_idx"), "marker_idx", "left_semi")


def tiers(order: DataFrame, budgets: list[int]) -> DataFrame:
    """The least budget that takes in each marker; markers beyond the largest are left out."""
    tier = F.coalesce(*[F.when(F.col("rank") < b, F.lit(b)) for b in sorted(budgets)])
    return order.withColumn("tier", tier).filter("tier is not null")


def representatives_first(physical: DataFrame, representatives: DataFrame, kept: DataFrame) -> DataFrame:
    """Representatives, then other kept markers, then the rest, each in physical order; by fit where ``physical`` has fits."""
    keys = [c for c in ("fit_id",) if c in physical.columns]
    on = [*keys, "marker_idx"]
    marked = physical.join(representatives.select(*on, F.lit(0).alias("r")), on, "left").join(kept.select(*on, F.lit(1).alias("q")), on, "left")
    marked = marked.select(*on, F.coalesce("r", "q", F.lit(2)).alias("class"), F.col("rank").alias("physical"))
    return ranked(marked, "class", "physical", keys=keys).select(*on, "rank")
