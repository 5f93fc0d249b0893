"""Sequence packing by Karmarkar-Karp multiway differencing (operator 5).

Every document's ids, closed by an end id, are cut into pieces: whole windows
of ``capacity`` ids, which are sequences as they are, and a rest, which is cut
on into parts of at most ``part`` ids so that few large parts cannot decide a
window.  Pieces are dealt out by a hash of their document and place, so copies
and hot sources spread, and each task packs runs of at most CHUNK pieces.  In a
run, partial partitions into k windows are merged by largest difference first,
the largest sums of one with the least sums of the other, which gives windows
of nearly equal length.  k starts at the least possible count and rises until
the longest window is within capacity.

What a task holds is bounded by CHUNK pieces, whatever the input.  The deal and
the order inside a task depend on the rows only, so a task that runs again
gives the same sequences.

Defined results: a null or empty text is the end id alone.  Rows that repeat a
doc_id are packed once each.  A null doc_id stays null.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import documents, in_slices

CAPACITY, CHUNK, PART = 4096, 2048, 1024


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 .. k - 1) of each size."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    sums: list[np.ndarray | None] = []
    made: list[tuple[int, np.ndarray, int, np.ndarray] | None] = []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        row = np.zeros(k, np.int64)
        row[0] = s
        sums.append(row)
        made.append(None)
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]  # both run from the largest sum to the least
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        made.append((a, order, b, k - 1 - order))
        sums.append(total - total[-1])
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums) - 1))
    window = np.zeros(n, np.int64)
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    while place:  # from the last merge back to the sizes
        node, final = place.popitem()
        if made[node] is None:
            window[node] = final[0]
            continue
        a, at_a, b, at_b = made[node]
        for child, at in ((a, at_a), (b, at_b)):
            own = np.empty(k, np.int64)
            own[at] = final
            place[child] = own
    return window


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none over capacity."""
    k = max(1, math.ceil(sizes.sum() / capacity))
    while True:
        window = differencing(sizes, k)
        most = int(np.bincount(window, sizes, k).max()) if len(sizes) else 0
        if most <= capacity:
            return window
        k += max(1, min(math.ceil(k * (most - capacity) / capacity / 2), k))


def _pieces(path: str, capacity: int, part: int, with_ids: bool, cache: int):
    def run(batches):
        encode = tk.encoder(path, cache).encode
        for batch in in_slices(batches, limit=tk.SLICE_BYTES):
            rows = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(tk.END)).astype("<u4")
                whole = len(ids) // capacity * capacity
                rest = len(ids) - whole
                cuts = [*range(0, whole, capacity), *(whole + rest * j // -(-rest // part) for j in range(-(-rest // part)))] if rest else [*range(0, whole, capacity)]
                for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
                    rows["doc_id"].append(doc)
                    rows["start"].append(lo)
                    rows["length"].append(hi - lo)
                    rows["ids_crc32"].append(zlib.crc32(ids[lo:hi].tobytes()))
                    rows["doc_tokens"].append(len(ids))
                    rows["ids"].append(ids[lo:hi].astype(np.int32) if with_ids else None)
            kinds = {"ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()], names=list(rows))

    return run


def _packed(capacity: int, chunk: int):
    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table: pa.Table):
            nonlocal number
            size = table.column("length").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            full = size >= capacity
            sequence[full] = np.arange(full.sum())
            rest = np.flatnonzero(~full)
            if len(rest):
                window = pack(size[rest], capacity)
                order = np.argsort(window, kind="stable")
                w, s = window[order], size[rest][order]
                run_ = np.cumsum(s) - s
                first = np.r_[True, w[1:] != w[:-1]]
                offset[rest[order]] = run_ - np.repeat(run_[first], np.diff(np.r_[np.flatnonzero(first), len(w)]))
                sequence[rest] = full.sum() + window
            sequence += base + number
            number += int(sequence.max() - base - number) + 1
            out = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= 2 * chunk:  # what stays is at least a chunk, so no run is a small one
                table = pa.Table.from_batches(held)
                yield from flush(table.slice(0, chunk))
                held = table.slice(chunk).combine_chunks().to_batches()
                rows -= chunk
        if rows:
            yield from flush(pa.Table.from_batches(held))

    return run


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, chunk: int = CHUNK, part: int = PART, with_ids: bool = True, partitions: int | None = None, cache: int = tk.CACHE
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, ids (null without ``with_ids``), sequence_id, offset."""
    spark = docs.sparkSession
    texts = documents(docs, "doc_id", "text")
    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<int>"
    cut = texts.mapInArrow(_pieces(path or tk.vocabulary_path(), capacity, part, with_ids, cache), kinds)
    if partitions is None:
        partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(texts.select("doc_id").count() / chunk)))
    dealt = cut.repartition(partitions, F.xxhash64("doc_id", "start", "ids_crc32", F.pmod(F.monotonically_increasing_id(), F.lit(64))))  # rows that equal one another are dealt apart
    ordered = dealt.sortWithinPartitions("doc_id", "start", "length", "ids_crc32")
    return ordered.mapInArrow(_packed(capacity, chunk), f"{kinds}, sequence_id bigint, offset bigint")
