"""Ridge systems by the equations of their markers, for studies with more samples than markers.

With A the centred and scaled genotypes of a panel over the root of the kernel's divisor, K = A A', and the weights a of
(K + c I) a = t enter predictions as u = A' a alone, which solves (A' A + c I) u = A' t.  Genotypes are cut once into
blocks of samples with all markers, their labels and their part in each fit.  A step is one pass over the blocks for all
fits, panels and systems, and what moves is a number a marker and column, however many samples there are.
Errors are summed and predictions made in tasks, so no row of a sample reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as ke
from .kernel import Fit, added
from .validate import ContractError

#: Part of a sample in a fit; samples of a block at least; blocks a core.
NO, TRAIN, TEST = 0, 1, 2
LEAST, BLOCKS_A_CORE = 1024, 4

_BLOCKS = "block bigint, lo bigint, samples int, real boolean, g binary, parts binary, y binary"
_SUMS = "system int, q binary"


def cut(vec: DataFrame, markers: np.ndarray, fits: Sequence[Fit], y: np.ndarray) -> DataFrame:
    """Blocks of samples with the genotypes of ``markers`` (ascending), each sample's part in every fit and its label: the one shuffle of genotypes."""
    n, cores = len(y), vec.sparkSession.sparkContext.defaultParallelism
    rows = max(1, min(ke.SLAB_BYTES // (8 * max(1, len(markers))), max(LEAST, -(-n // (BLOCKS_A_CORE * cores)))))
    count, limit = -(-n // rows), ke.STRIP_BYTES
    real = isinstance(vec.schema["g"].dataType.elementType, T.DoubleType)
    kind = np.float64 if real else np.int8
    parts = np.zeros((len(fits), n), np.int8)
    for i, f in enumerate(fits):
        parts[i, np.asarray(f.train, np.int64)] = TRAIN
        parts[i, np.asarray(f.test, np.int64)] = TEST

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), markers)))
            step = max(1, limit // (n * np.dtype(kind).itemsize))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = part.column(1).flatten().fill_null(float("nan") if real else -1).to_numpy(zero_copy_only=False).astype(kind).reshape(len(part), -1)
                own = part.column(0).to_numpy().astype(np.int32).tobytes()
                cells = [x[:, k * rows : (k + 1) * rows].tobytes() for k in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array([own] * count, pa.binary()), pa.array(cells, pa.binary())], names=["block", "markers", "g"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, x = 0, [], []
        for batch in batches:
            block = batch.column(0)[0].as_py()
            own += [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column(1)]
            x += [np.frombuffer(b.as_buffer(), kind).reshape(len(m), -1) for m, b in zip(own[len(x) :], batch.column(2))]
        lo, g = block * rows, np.concatenate(x)[np.argsort(np.concatenate(own))]
        cells = [np.ascontiguousarray(a).tobytes() for a in (g, parts[:, lo : lo + rows], y[lo : lo + rows])]
        head = [pa.array([block]), pa.array([lo]), pa.array([g.shape[1]], pa.int32()), pa.array([real])]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array([c], pa.binary()) for c in cells)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    dealt = vec.select("marker_idx", "g").mapInArrow(deal, "block bigint, markers binary, g binary")
    return dealt.repartition(4 * count, "block").groupBy("block").applyInArrow(gather, _BLOCKS)  # more partitions than blocks, so that few tasks get two


@dataclass
class Block:
    """Samples from ``lo`` on: dosages (missing: 0) by marker, the mark of missing calls (None: none), parts by fit, labels."""

    lo: int
    x: np.ndarray
    missing: np.ndarray | None
    parts: np.ndarray
    y: np.ndarray


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for r in range(batch.num_rows):
            lo, n, real = (batch.column(i)[r].as_py() for i in (1, 2, 3))
            g, parts, y = (np.frombuffer(batch.column(4 + i)[r].as_buffer(), k) for i, k in enumerate((np.float64 if real else np.int8, np.int8, np.float64)))
            g = g.reshape(-1, n)
            gone = np.isnan(g) if real else g < 0
            yield Block(lo, np.where(gone, 0, g).astype(np.float64), gone.astype(np.float64) if gone.any() else None, parts.reshape(-1, n), y)


class Columns:
    """The markers of each fit by tier: places in ``markers`` (ascending), means and weights 1 / scale^2."""

    def __init__(self, stats: DataFrame, fits: Sequence[Fit]):
        t = stats.select("fit_id", "marker_idx", "tier", "mean", "scale").toArrow()  # a row a fit, marker and tier; markers are the fewer side
        number = {f.fit_id: i for i, f in enumerate(fits)}
        names = t.column("fit_id").combine_chunks().dictionary_encode()
        of = np.array([number[s] for s in names.dictionary.to_pylist()], np.int64)
        fit = of[names.indices.to_numpy()] if len(t) else np.zeros(0, np.int64)
        marker, tier = (t.column(c).to_numpy().astype(np.int64) for c in ("marker_idx", "tier"))
        mean, scale = (np.nan_to_num(t.column(c).to_numpy().astype(np.float64)) for c in ("mean", "scale"))
        self.markers, place = np.unique(marker, return_inverse=True)
        self.rows = [(place[fit == i], tier[fit == i], mean[fit == i], 1.0 / scale[fit == i] ** 2) for i in range(len(fits))]

    def panel(self, fit: int, tiers: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and root of the weight of each marker in a fit's panel; 0 for others."""
        place, tier, mean, weight = self.rows[fit]
        at = np.isin(tier, tiers)
        out = np.zeros((2, len(self.markers)))
        out[0, place[at]], out[1, place[at]] = mean[at], np.sqrt(weight[at])
        return out[0], out[1]


@dataclass(frozen=True)
class System:
    """Columns d, by marker, of a fit's panel: its mean, and the root of its weights over the kernel's divisor."""

    fit: int
    mean: np.ndarray
    root: np.ndarray
    d: np.ndarray


class _Batch:
    """Systems side by side, as tasks need them."""

    def __init__(self, systems: Sequence[System]):
        self.fits, self.shapes = [s.fit for s in systems], [s.d.shape for s in systems]
        self.cuts = np.cumsum([0, *(k for _, k in self.shapes)])
        self.root, self.mean = (np.array([getattr(s, c) for s in systems]) for c in ("root", "mean"))
        self.q = np.concatenate([s.root[:, None] * s.d for s in systems], 1)
        self.lost = np.concatenate([(s.mean * s.root)[:, None] * s.d for s in systems], 1)

    def forward(self, block: Block) -> Iterator[tuple[slice, np.ndarray]]:
        """A d at the samples of a block, some at a time."""
        level, step = self.lost.sum(0), max(1, ke.ROWS_BYTES // (8 * self.q.shape[1]))
        for lo in range(0, block.x.shape[1], step):
            at = slice(lo, lo + step)
            h = block.x[:, at].T @ self.q - level
            if block.missing is not None:
                h += block.missing[:, at].T @ self.lost
            yield at, h

    def each(self, h: np.ndarray, block: Block, at: slice, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The columns of each system, and its samples of a part."""
        for i, (fit, lo, hi) in enumerate(zip(self.fits, self.cuts, self.cuts[1:])):
            yield i, h[:, lo:hi], block.parts[fit, at] == part


def _partial(blocks: DataFrame, body, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums by system of what ``body(block, totals)`` adds to ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, any_ = [np.zeros(s) for s in shapes], False
        for block in opened(batches):
            any_ = True
            body(block, totals)
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals)), pa.int32()), pa.array([np.ascontiguousarray(t).tobytes() for t in totals], pa.binary())], names=["system", "q"])

    tasks = min(blocks.rdd.getNumPartitions(), max(1, blocks.sparkSession.sparkContext.defaultParallelism))
    return added(blocks.coalesce(tasks).mapInArrow(run, _SUMS), tasks, shapes, tasks)


def moments(blocks: DataFrame, levels: np.ndarray, markers: int) -> np.ndarray:
    """Over each fit's training samples, by marker and fit: sums of dosages, of their squares, calls, and the sums of labels less ``levels`` times dosages, and at calls."""

    def body(block: Block, totals: list[np.ndarray]) -> None:
        inside = (block.parts == TRAIN).T.astype(np.float64)
        t = (block.y[:, None] - levels) * inside
        gone = (lambda v: 0) if block.missing is None else (lambda v: block.missing @ v)
        for k, v in enumerate((block.x @ inside, (block.x * block.x) @ inside, inside.sum(0) - gone(inside), block.x @ t, t.sum(0) - gone(t))):
            totals[0][k] += v

    return _partial(blocks, body, [(5, markers, len(levels))])[0]


def products(blocks: DataFrame, systems: Sequence[System]) -> list[np.ndarray]:
    """A' A d of each system, A over the training samples of its fit: one pass over the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(_Batch(systems))

    def body(block: Block, totals: list[np.ndarray]) -> None:
        batch = shared.value
        for at, h in batch.forward(block):
            for _, own, train in batch.each(h, block, at, TRAIN):
                own *= train[:, None]
            inner, level = block.x[:, at] @ h, h.sum(0)
            seen = level - block.missing[:, at] @ h if block.missing is not None else np.broadcast_to(level, inner.shape)
            for i, (lo, hi) in enumerate(zip(batch.cuts, batch.cuts[1:])):
                totals[i] += batch.root[i][:, None] * (inner[:, lo:hi] - batch.mean[i][:, None] * seen[:, lo:hi])

    out = _partial(blocks, body, [s.d.shape for s in systems])
    shared.unpersist()
    return out


def errors(blocks: DataFrame, systems: Sequence[System], levels: Sequence[float]) -> list[np.ndarray]:
    """Summed squared errors of the predictions level + A d at the test samples of each system, a number a column."""
    shared = blocks.sparkSession.sparkContext.broadcast(_Batch(systems))

    def body(block: Block, totals: list[np.ndarray]) -> None:
        batch = shared.value
        for at, h in batch.forward(block):
            for i, own, test in batch.each(h, block, at, TEST):
                totals[i] += ((block.y[at][test, None] - levels[i] - own[test]) ** 2).sum(0)

    out = _partial(blocks, body, [(s.d.shape[1],) for s in systems])
    shared.unpersist()
    return out


def predictions(blocks: DataFrame, systems: Sequence[System], levels: Sequence[float]) -> DataFrame:
    """system, position, prediction of the test samples of each system, which has one column."""
    batch = _Batch(systems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            for at, h in batch.forward(block):
                for i, own, test in batch.each(h, block, at, TEST):
                    p = levels[i] + own[test, 0]
                    if not np.isfinite(p).all():
                        raise ContractError("predictions aren't finite")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i), pa.int32()), pa.array(block.lo + at.start + np.flatnonzero(test), pa.int32()), pa.array(p)], names=["system", "position", "prediction"])

    return blocks.mapInArrow(run, "system int, position int, prediction double")
