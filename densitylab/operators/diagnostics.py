"""Diagnostics of kernels (A18, A19), reduced from tiles: no kernel is ever whole anywhere.

Tiles are of samples by samples, or, where samples are more than markers, of markers by markers: with columns z_c of the centred and
scaled genotypes, kernels K = sum of z_c z_c' over a panel and F over another, the sum of K_ij F_ij over all pairs of samples is that of
(z_c' z_d)^2 over c of the one and d of the other, and their diagonals' that of (z_c^2)' (z_d^2).  So all pairs of samples cost one
pass over the genotypes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as ke
from .kernel import Fit, tiles
from .primal import TRAIN, Columns, opened

_SUMS = ["trace", "squares", "sampled_squares", "sampled_cross", "off", "off_sum", "off_squares", "off_cross"]


def sampled(n: int, most: int = 512) -> np.ndarray:
    """Evenly spaced training samples, at most ``most``."""
    return np.linspace(0, n - 1, min(most, n)).astype(int)


def sums_of_tiles(strips: DataFrame, samples: int, fits: Sequence[tuple[int, Fit]], sums: dict[str, list[int]], full: str, most: int = 512) -> DataFrame:
    """A row a fit and workflow: sums over the entries of its kernel, and over sampled ones with those of ``full``."""
    picked = {}
    for number, f in fits:
        picked[number] = np.zeros(samples, bool)
        picked[number][np.asarray(f.train, np.int64)[sampled(len(f.train), most)]] = True

    def body(fit: int, lo: int, at: int, parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        shape = next(iter(parts.values())).shape
        i, j = lo + np.arange(shape[0])[:, None], at + np.arange(shape[1])[None, :]
        twice = np.where(i < j, 2.0, np.where(i == j, 1.0, 0.0))
        pick = picked[fit][lo : lo + shape[0], None] & picked[fit][None, at : at + shape[1]]
        of = lambda flow: sum((parts[t] for t in sums[flow] if t in parts), np.zeros(shape))
        whole, out = of(full), []
        near, off = twice * pick, twice * (pick & (i != j))
        for flow in sums:
            k = of(flow)
            out.append((fit, flow, float((k * (i == j)).sum()), float((twice * k * k).sum()), float((near * k * k).sum()), float((near * k * whole).sum()), float(off.sum()), float((off * k).sum()), float((off * k * k).sum()), float((off * k * whole).sum())))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["fit", "workflow", *_SUMS])

    tiers = sorted({t for ts in sums.values() for t in ts})
    kinds = "fit bigint, workflow string, " + ", ".join(f"{c} double" for c in _SUMS)
    return tiles(strips, samples, fits, tiers, kinds, body).groupBy("fit", "workflow").agg(*[F.sum(c).alias(c) for c in _SUMS])


def relationship(strips: DataFrame, samples: int, fits: Sequence[tuple[int, Fit]], sums: dict[str, list[int]], full: str, most: int = 512) -> DataFrame:
    """fit_id, workflow, samples, trace_participation_ratio, sampled_relative_frobenius, sampled_offdiagonal_correlation.

    A18: n^2 over the sum of squares of the kernel with unit mean diagonal, from all its entries.  A19: distance and off-diagonal
    correlation to the full panel's kernel on evenly spaced training samples, both with unit mean diagonals.
    """
    return _related(sums_of_tiles(strips, samples, fits, sums, full, most), fits, full, most)


def relationship_by_marker(blocks: DataFrame, columns: Columns, fits: Sequence[tuple[int, Fit]], sums: dict[str, list[int]], full: str, most: int = 512) -> DataFrame:
    """``relationship`` from blocks of samples (``primal.cut``)."""
    return _related(sums_of_markers(blocks, columns, fits, sums, full, most), fits, full, most)


def sums_of_markers(blocks: DataFrame, columns: Columns, fits: Sequence[tuple[int, Fit]], sums: dict[str, list[int]], full: str, most: int = 512) -> DataFrame:
    """``sums_of_tiles`` from tiles of markers by markers; parts of the samples are summed apart while there are fewer tiles than cores."""
    flows = {flow: np.asarray(t) for flow, t in sums.items()}
    rows = {number: [c[np.isin(columns.rows[number][1], np.concatenate(list(flows.values())))] for c in columns.rows[number]] for number, _ in fits}
    m, deep = len(columns.markers), max([1, *(int(np.bincount(r[0]).max(initial=1)) for r in rows.values())])
    width = int(max(16, min(m, 2048, np.sqrt(ke.TILE_BYTES / (24 * max(1, len(fits)))) / deep)))
    count = -(-m // width)
    pairs = count * (count + 1) // 2
    parts = max(1, -(-4 * blocks.sparkSession.sparkContext.defaultParallelism // pairs))
    picked = {number: None if most >= len(f.train) else np.asarray(f.train, np.int64)[sampled(len(f.train), most)] for number, f in fits}
    sizes = {number: min(most, len(f.train)) for number, f in fits}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                n, real = one.column(2)[0].as_py(), one.column(3)[0].as_py()
                g = np.frombuffer(one.column(4)[0].as_buffer(), np.float64 if real else np.int8).reshape(-1, n)
                for i in range(count):
                    for j in range(i, count):
                        both = np.concatenate([g[k * width : (k + 1) * width] for k in dict.fromkeys((i, j))])
                        head = [pa.array([x], pa.int32()) for x in (i, j, one.column(0)[0].as_py() % parts)]
                        yield pa.RecordBatch.from_arrays([*head, *one.columns[:4], pa.array([both.tobytes()], pa.binary()), *one.columns[5:]], names=["i", "j", "part", *one.schema.names])

    def side(number: int, i: int) -> list[np.ndarray]:
        at = (rows[number][0] >= i * width) & (rows[number][0] < (i + 1) * width)
        return [c[at] for c in rows[number]]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, {}
        for batch in batches:
            at = at or tuple(batch.column(k)[0].as_py() for k in range(2))
            for block in opened(iter([batch.select(names)])):
                for number in rows:
                    z, train = [], block.parts[number] == TRAIN
                    if picked[number] is not None:
                        pick = np.zeros(len(train), bool)
                        here = picked[number] - block.lo
                        pick[here[(here >= 0) & (here < len(pick))]] = True
                        pick = pick[train]
                    for k, shift in zip(at, (0, 0 if at[0] == at[1] else width)):
                        place, _, mean, weight = side(number, k)
                        x = block.x[place - k * width + shift][:, train]
                        gone = 0 if block.missing is None else block.missing[place - k * width + shift][:, train]
                        z.append(np.sqrt(weight)[:, None] * (x - mean[:, None] * (1 - gone)))
                    a, b = z if picked[number] is None else (v[:, pick] for v in z)
                    made = [z[0] @ z[1].T, a @ b.T, (a * a) @ (b * b).T, a.sum(1)]
                    total[number] = [p + q for p, q in zip(total[number], made)] if number in total else made
        for number, made in total.items():
            if parts == 1:
                yield finished(number, *at, made)
            else:
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (number, *at)), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in made)], names=["fit", "i", "j", "g", "p", "h", "s"])

    def finished(number: int, i: int, j: int, made: list[np.ndarray]) -> pa.RecordBatch:
        g, p, h, s = made
        left, right, out = side(number, i)[1], side(number, j)[1], []
        inside = lambda flow: (np.isin(left, flows[flow]), np.isin(right, flows[flow]))
        both = lambda x, a, b: float(x[np.ix_(a[0], b[1])].sum()) + (float(x[np.ix_(b[0], a[1])].sum()) if i < j else 0.0)
        f, g2, p2, pairs_of = inside(full), g * g, p * p, sizes[number] * (sizes[number] - 1) if i == j == 0 else 0
        for flow in sums:
            a, trace, off = inside(flow), 0.0, 0.0
            if i == j:
                trace, off = float(g.diagonal()[a[0]].sum()), float((s[a[0]] ** 2).sum() - p.diagonal()[a[0]].sum())
            squares, cross = both(p2, a, a), both(p2, a, f)
            out.append((number, flow, trace, both(g2, a, a), squares, cross, float(pairs_of), off, squares - both(h, a, a), cross - both(h, a, f)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["fit", "workflow", *_SUMS])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = None, None
        for batch in batches:
            head = head or tuple(batch.column(k)[0].as_py() for k in range(3))
            for r in range(batch.num_rows):
                made = [np.frombuffer(batch.column(3 + k)[r].as_buffer()) for k in range(4)]
                total = made if total is None else [p + q for p, q in zip(total, made)]
        shape = len(side(head[0], head[1])[0]), len(side(head[0], head[2])[0])
        yield finished(*head, [*(x.reshape(shape) for x in total[:3]), total[3]])

    names = blocks.columns
    kinds = "fit bigint, workflow string, " + ", ".join(f"{c} double" for c in _SUMS)
    dealt = blocks.mapInArrow(deal, "i int, j int, part int, block bigint, lo bigint, samples int, real boolean, g binary, parts binary, y binary").repartition(2 * parts * pairs, "i", "j", "part").groupBy("i", "j", "part")
    if parts == 1:
        made = dealt.applyInArrow(own, kinds)
    else:
        made = dealt.applyInArrow(own, "fit int, i int, j int, g binary, p binary, h binary, s binary").groupBy("fit", "i", "j").applyInArrow(add, kinds)
    return made.groupBy("fit", "workflow").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _related(s: DataFrame, fits: Sequence[tuple[int, Fit]], full: str, most: int) -> DataFrame:
    # the full panel's row beside each of its fit: a join would go through all tiles twice
    whole = [F.max(F.when(F.col("workflow") == full, F.col(c))).over(Window.partitionBy("fit")).alias(f"full_{c}") for c in _SUMS]
    facts = F.create_map(*[F.lit(x) for i, f in fits for x in (i, len(f.train))])
    names = F.create_map(*[F.lit(x) for i, f in fits for x in (i, f.fit_id)])
    j = s.select("*", *whole).filter("full_trace is not null").withColumn("n", facts[F.col("fit").cast("int")].cast("double"))
    a, b = F.col("n") / F.col("trace"), F.col("n") / F.col("full_trace")  # to unit mean diagonals
    distance = a * a * F.col("sampled_squares") - 2 * a * b * F.col("sampled_cross") + b * b * F.col("full_sampled_squares")
    m = F.col("off")
    cover = F.col("off_cross") - F.col("off_sum") * F.col("full_off_sum") / m
    spread = lambda p: F.col(f"{p}off_squares") - F.col(f"{p}off_sum") * F.col(f"{p}off_sum") / m
    return j.select(
        names[F.col("fit").cast("int")].alias("fit_id"),
        "workflow",
        F.least(F.col("n"), F.lit(float(most))).cast("int").alias("samples"),
        (F.col("trace") * F.col("trace") / F.col("squares")).alias("trace_participation_ratio"),
        (F.sqrt(F.greatest(distance, F.lit(0.0))) / (b * F.sqrt("full_sampled_squares"))).alias("sampled_relative_frobenius"),
        F.try_divide(cover, F.sqrt(spread("") * spread("full_"))).alias("sampled_offdiagonal_correlation"),
    )
