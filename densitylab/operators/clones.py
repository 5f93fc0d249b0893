"""Near-clone blocks of samples (C7), for blocked folds and block bootstraps.

The distance of two samples is the sum of |dosage differences| over twice the sites that both have called.  Pairs
at ``limit`` or less are links, and a block is a connected component.

All pairs are judged, in tiles of samples by samples whose number follows the cores, so what is dealt grows with the genotypes; a task goes
through its tile in short blocks.  With s = g - 1 (missing: 0), |g - h| is at least (g - h)^2 / 2, and the sum of (s - t)^2 over all sites is that
over the sites called by both and at most 1 for each missing call.  So one product of matrices a block bounds the differences from below, and
as both only grow with the markers, a block without a pair below the limit of all sites is out for good, which for unrelated samples is soon.
Pairs that remain, few, are counted exactly, unless what was found before already connects them.
A tile hands on a spanning forest of its links and not all of them, so a block of many clones costs two
edges a sample and tile; the components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import SIDE_BYTES, TILES_A_CORE
from .stage import Stage

#: Samples along a side of a tile at least; samples by samples of a block; markers of a product, and bytes of dosages as doubles of a piece; pairs counted at once.
TILE, BLOCK, CHUNK, CHUNK_BYTES, AT_ONCE = 1024, (256, 1024), 512, 64 << 20, 4096


class Forest:
    """Components of numbers, and the edges that made them."""

    def __init__(self, n: int):
        self.up, self.a, self.b = np.arange(n), [], []

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.up[x]
        while not np.array_equal(higher := self.up[at], at):
            at = higher
        self.up[x] = at
        return at

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            r, s = x, y
            while (up := int(self.up[r])) != r:
                r = up
            while (up := int(self.up[s])) != s:
                s = up
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.a.append(x)
                self.b.append(y)


def links(vec: DataFrame, samples: int, limit: float = 0.001, tile: int = TILE) -> DataFrame:
    """a, b: links of positions in marker_vec, a spanning forest of those in each tile.  Samples without a common call aren't linked."""
    sites, cores = vec.count(), vec.sparkSession.sparkContext.defaultParallelism
    count = max(int(np.ceil((np.sqrt(8 * TILES_A_CORE * cores + 1) - 1) / 2)), int(np.ceil(sites * samples / SIDE_BYTES)))
    rows = max(1, min(samples, tile), -(-samples // count))
    count = -(-samples // rows)
    bound = np.float32(2 * limit * sites + 1e-5 * sites + 1e-3)  # with room for the products' numbers of 24 bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(CHUNK, CHUNK_BYTES // (8 * samples)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                flat = part.column(1).flatten().cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
                g = np.where(np.isnan(flat), -1, flat).astype(np.int8).reshape(len(part), -1)
                cut = [np.ascontiguousarray(g[:, k * rows : (k + 1) * rows]) for k in range(count)]
                for i in range(count):
                    cells = [(i, j, len(part), cut[i].tobytes(), cut[j].tobytes() if j > i else b"") for j in range(i, count)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["i", "j", "n", "left", "right"])

    def joined(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Dosages by sample, and missing calls of each."""
        g = np.concatenate([np.frombuffer(b, np.int8).reshape(n, -1) for n, b in pieces])
        return np.ascontiguousarray(g.T), (g < 0).sum(0)

    def centred(g: np.ndarray) -> np.ndarray:
        return np.where(g < 0, 0, g - 1).astype(np.float32)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows are links, exactly."""
        known = (a >= 0) & (b >= 0)
        called = known.sum(1)
        return (called > 0) & (np.where(known, np.abs(a - b), 0).sum(1) <= 2 * limit * called + 1e-9)

    def extended(g: np.ndarray, lost: np.ndarray, left: bool) -> np.ndarray:
        """The first markers of each sample, so that one product gives half the squared differences less what missing calls allow."""
        x = centred(g[:, :CHUNK])
        own = ((x * x).sum(1) / 2 - lost * (0.5 - limit)).astype(np.float32)[:, None]
        return np.concatenate([-x, own, np.ones_like(own)] if left else [x, np.ones_like(own), own], 1)

    def candidates(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pairs of rows whose differences may be under the limit; from product to product only while there are any."""
        for lo in range(CHUNK, sites, CHUNK):
            if not (apart <= bound).any():
                return np.zeros(0, np.int64)
            x, y = centred(a[:, lo : lo + CHUNK]), centred(b[:, lo : lo + CHUNK])
            apart -= x @ y.T
            apart += ((x * x).sum(1) / 2)[:, None]
            apart += (y * y).sum(1) / 2
        return np.flatnonzero((apart <= bound).ravel())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, [], []
        for batch in batches:
            at = at or (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            for n, p, q in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                left.append((n, p))
                right.append((n, q))
        same = at[0] == at[1]
        a, gone = joined(left)
        b, lost = (a, gone) if same else joined(right)
        shift = 0 if same else len(a)
        found = Forest(shift + len(b))
        x, y = extended(a, gone, True), extended(b, lost, False)
        for r in range(0, len(a), BLOCK[0]):
            for c in range(r // BLOCK[1] * BLOCK[1] if same else 0, len(b), BLOCK[1]):
                apart = x[r : r + BLOCK[0]] @ y[c : c + BLOCK[1]].T
                i, j = np.divmod(candidates(apart, a[r : r + BLOCK[0]], b[c : c + BLOCK[1]]), apart.shape[1])
                i, j = i + r, j + c
                if same:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), AT_ONCE):
                    p, q = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
                    apart = found.roots(p) != found.roots(q + shift)
                    p, q = p[apart], q[apart]
                    link = near(a[p], b[q])
                    found.join(p[link], q[link] + shift)
        if found.a:
            p, q = np.array(found.a), np.array(found.b)
            first, second = (np.where(v < shift, v + at[0] * rows, v - shift + at[1] * rows) for v in (p, q))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    dealt = vec.select("marker_idx", "g").mapInArrow(deal, "i int, j int, n int, left binary, right binary")
    number = count * (count + 1) // 2
    return dealt.repartition(max(1, 4 * number), "i", "j").groupBy("i", "j").applyInArrow(own, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))  # more partitions than tiles, so that few tasks get two


def components(nodes: DataFrame, edges: DataFrame, stage: Stage) -> DataFrame:
    """node, block (the least node of its component): least labels move along edges, and then along labels, until none changes."""
    one = edges.select("a", "b").filter("a <> b")
    both = stage.put(one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = stage.put(nodes.select("node", F.col("node").alias("block")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("block").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, "node", "left").select("node", F.col("block").alias("old"), F.least("block", F.coalesce("c", "block")).alias("block"))
        hop = now.select(F.col("node").alias("block"), F.col("block").alias("up"))
        new = stage.put(step.join(hop, "block").select("node", F.least("block", "up").alias("block"), "old"), "labels")
        now = new.select("node", "block")
        if new.filter("block <> old").isEmpty():
            return now


def blocks(vec: DataFrame, samples: int, stage: Stage, limit: float = 0.001, tile: int = TILE) -> DataFrame:
    """node (position in marker_vec), block: each sample's near-clone block, named by its least position."""
    found = stage.put(links(vec, samples, limit, tile), "clone-links")
    return components(vec.sparkSession.range(samples).select(F.col("id").alias("node")), found, stage)
