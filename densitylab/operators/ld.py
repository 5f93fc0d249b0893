"""Local linkage disequilibrium: pairs, summary, greedy cover, panel coverage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .qc import packed, unpacked
from .stage import Stage


def tile_pairs(variants: DataFrame, window: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(marker_idx, chrom, pos, tile; chrom, i, j): tiles of at most ``depth`` neighbouring markers, and the pairs of tiles with markers in reach.

    Bins are as wide as the window, so what is in reach lies in the same bin or the next; bins with more markers
    are cut into several tiles, so a dense stretch is many tiles.
    """
    v = variants.select("marker_idx", "chrom", "pos", F.floor(F.col("pos") / window).alias("bin"))
    place = F.row_number().over(Window.partitionBy("chrom", "bin").orderBy("pos", "marker_idx")) - 1
    placed = v.withColumn("tile", F.shiftleft("bin", 24) + F.floor(place / depth))
    spans = placed.groupBy("chrom", "bin", "tile").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    left = spans.select("chrom", F.col("tile").alias("i"), (F.col("hi") + window).alias("end"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    right = spans.select("chrom", F.col("tile").alias("j"), "lo", "bin")
    return placed.drop("bin"), left.join(right, ["chrom", "bin"]).filter("j >= i and lo <= end").select("chrom", "i", "j")


def window_r2(vec: DataFrame, variants: DataFrame, kept: DataFrame, trains: dict[str, Sequence[int]], window: int, depth: int = 256) -> DataFrame:
    """fit_id, a, b, chrom, r2 of all local pairs of the markers that each fit keeps.

    ``kept``: fit_id, marker_idx.  Genotypes are shuffled once for all fits, to the pairs of tiles that theirs is
    part of; a task has two tiles of ``depth`` markers, however dense a stretch is, and pairs carry no genotypes.
    """
    at = {f: packed(t) for f, t in trains.items()}
    fits = kept.groupBy("marker_idx").agg(F.collect_list("fit_id").alias("fits"))
    placed, pairs = tile_pairs(variants.join(fits.select("marker_idx"), "marker_idx", "left_semi"), window, depth)
    v = placed.join(fits, "marker_idx").join(vec.select("marker_idx", "g"), "marker_idx")
    left = pairs.select("chrom", F.col("i").alias("tile"), "i", "j", F.lit(True).alias("own"))
    right = pairs.filter("j > i").select("chrom", F.col("j").alias("tile"), "i", "j", F.lit(False).alias("own"))
    dealt = v.join(left.unionAll(right), ["chrom", "tile"]).select("marker_idx", "chrom", "pos", "fits", "g", "own", "i", "j")

    def unit(g: pa.ListArray, which: np.ndarray, train: np.ndarray) -> np.ndarray:
        x = g.take(pa.array(which)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(which), -1)[:, train]
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        z = np.where(known, x - (x.sum(1) / np.maximum(known.sum(1), 1))[:, None], 0.0)
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(size == 0, 1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()  # two tiles
        marker, pos, first = (t.column(c).to_numpy() for c in ("marker_idx", "pos", "own"))
        g = t.column("g").combine_chunks()
        g = g.chunk(0) if isinstance(g, pa.ChunkedArray) else g
        chrom, holds = t.column("chrom")[0].as_py(), [set(x) for x in t.column("fits").to_pylist()]
        inside = bool(first.all())  # a tile with itself
        for fit, marks in at.items():
            train = unpacked(marks)
            mine = np.array([fit in x for x in holds])
            a, b = np.flatnonzero(mine & first), np.flatnonzero(mine & (first == inside))
            if not len(a) or not len(b):
                continue
            gap = pos[b][None, :] - pos[a][:, None]
            p, q = np.nonzero((gap > 0) & (gap <= window))
            r = (unit(g, a, train) @ unit(g, b, train).T)[p, q]
            yield pa.RecordBatch.from_arrays(
                [pa.array([fit] * len(p), pa.string()), pa.array(marker[a[p]], pa.int32()), pa.array(marker[b[q]], pa.int32()), pa.array([chrom] * len(p), pa.string()), pa.array(np.clip(r * r, 0, 1))],
                names=["fit_id", "a", "b", "chrom", "r2"],
            )

    return dealt.groupBy("chrom", "i", "j").applyInArrow(run, "fit_id string, a int, b int, chrom string, r2 double")


def _fit(df: DataFrame) -> list[str]:
    return [c for c in ("fit_id",) if c in df.columns]


def summary(variants: DataFrame, r2: DataFrame, threshold: float) -> DataFrame:
    """[fit_id,] chrom, local_pairs, mean_r2 (null without pairs), high_ld_pairs; by fit where ``r2`` has fits."""
    by = [*_fit(r2), "chrom"]
    s = r2.groupBy(*by).agg(F.count("*").alias("local_pairs"), F.avg("r2").alias("mean_r2"), F.count_if(F.col("r2") >= threshold).alias("high_ld_pairs"))
    return variants.select(*by).distinct().join(s, by, "left").na.fill(0, ["local_pairs", "high_ld_pairs"])


def greedy_cover(variants: DataFrame, kept: DataFrame, order: DataFrame, r2: DataFrame, threshold: float, stage: Stage) -> DataFrame:
    """[fit_id,] marker_idx of the representatives: most uncovered neighbours first, ties by rank.

    A marker that beats all others within two steps is taken at once: nobody who could cover its neighbours comes before
    it, as counts only fall.  So all such markers of a round are taken together, and the result is that of
    taking one after another.  Who beats whom travels along the edges as messages.
    A round is a few aggregations over the edges between markers that are neither taken nor covered, which it leaves
    fewer; no chromosome or neighbourhood is in one task.  A marker that is never covered represents itself.
    """
    by = _fit(kept)
    on = lambda name: [*by, F.col("marker_idx").alias(name)]
    nodes = stage.put(kept.select(*by, "marker_idx").join(order.select("marker_idx", "rank"), "marker_idx").join(variants.select("marker_idx"), "marker_idx", "left_semi"), "nodes")
    one = r2.filter((F.col("r2") >= threshold) & (F.col("a") != F.col("b"))).select(*by, "a", "b")
    both = one.unionAll(one.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ranked = both.join(nodes.select(*on("a"), F.col("rank").alias("ra")), [*by, "a"]).join(nodes.select(*on("b"), F.col("rank").alias("rb")), [*by, "b"])
    edges = stage.put(ranked.select(*by, "a", "ra", "b", "rb"), "edges")
    covered = []
    while not edges.isEmpty():
        degree = edges.groupBy(*by, "a").agg(F.count("*").alias("n"))
        own, other = F.struct("n", (-F.col("ra")).alias("r")), F.struct(F.col("m").alias("n"), (-F.col("rb")).alias("r"))
        named = edges.join(degree, [*by, "a"]).join(degree.select(*by, F.col("a").alias("b"), F.col("n").alias("m")), [*by, "b"])
        first = named.groupBy(*by, "a").agg(F.max(own).alias("own"), F.max(other).alias("near")).select(*by, "a", "own", F.greatest("own", "near").alias("near"))
        second = edges.join(first.select(*by, F.col("a").alias("b"), "near"), [*by, "b"]).groupBy(*by, "a").agg(F.max("near").alias("beyond"))
        taken = first.join(second, [*by, "a"]).filter((F.col("near") == F.col("own")) & (F.col("beyond") <= F.col("own"))).select(*by, "a", F.lit(False).alias("covered"))
        near = edges.join(taken, [*by, "a"], "left_semi").select(*by, F.col("b").alias("a"), F.lit(True).alias("covered"))
        gone = stage.put(taken.unionAll(near.distinct()), "gone")
        left = edges.join(gone, [*by, "a"], "left_anti")
        edges = stage.put(left.join(gone.withColumnRenamed("a", "b"), [*by, "b"], "left_anti").select(*edges.columns), "edges")
        covered.append(gone)
    if not covered:
        return nodes.select(*by, "marker_idx")
    out = stage.together(covered).filter("covered").select(*by, F.col("a").alias("marker_idx"))
    return nodes.join(out, [*by, "marker_idx"], "left_anti").select(*by, "marker_idx")  # who isn't covered represents itself


def coverage(variants: DataFrame, chosen: DataFrame, edges: DataFrame, width: int, panels: Sequence[tuple[str, str, int]] = ()) -> DataFrame:
    """Markers, occupied and all bins, span, median and longest spacing, high-LD pairs, by chromosome.

    With ``panels`` (fit_id, strategy, budget), ``chosen`` has these columns and ``edges`` has fit_id, and there are rows for every panel.
    """
    keys = ["fit_id", "strategy", "budget"] if panels else []
    by = [*keys, "chrom"]
    bins = F.floor(F.col("pos") / width)
    every = variants.groupBy("chrom").agg(F.count_distinct(bins).alias("catalog_bins"))
    if panels:
        every = every.select("*", F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, p)]) for p in panels])))
    held = variants.join(chosen.select(*keys, "marker_idx"), "marker_idx")
    gaps = held.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy(*by).orderBy("pos")))
    own = gaps.groupBy(*by).agg(
        F.count("*").alias("markers"),
        F.count_distinct(bins).alias("occupied_bins"),
        (F.max("pos") - F.min("pos")).alias("span_bp"),
        F.median("gap").alias("median_spacing_bp"),
        F.max("gap").alias("max_spacing_bp"),
    )
    both = edges.join(chosen.select(*keys, F.col("marker_idx").alias("a")), [*keys[:1], "a"]).join(chosen.select(*keys, F.col("marker_idx").alias("b")), [*keys, "b"])
    high = both.groupBy(*by).agg(F.count("*").alias("high_ld_pairs"))
    return every.join(own, by, "left").join(high, by, "left").na.fill(0, ["markers", "occupied_bins", "span_bp", "high_ld_pairs"])
