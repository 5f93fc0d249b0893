"""Vector codes by Lloyd's method with heaps (operator 12).

Vectors of integers are cut into PARTS parts, and each part position has a codebook of
ENTRIES entries.  Vectors lie in blocks, one row a block, and a block has a heap for each
entry of each position.  A part's key in the heap of its entry is its slack, the
distance to the second nearest entry less that to its own, plus the drift that the
entry had gathered when the part came in.  After the entries have moved, an entry's
drift grows by its own move and the greatest move of any other; a part whose key is
still above it can't have a nearer entry, so only the parts popped from the top of the
heap are compared with all entries again, exactly and in integers.

A round is one pass over the staged blocks.  It writes the blocks again with their
heaps and the sums of the parts that moved, and the sums of all blocks, ENTRIES x PARTS
small vectors, are the next codebooks.  Staged blocks outlive executors.

Defined results: rows are left out as in ``vectors.usable``, and the width must be a multiple
of PARTS (else ValueError).  Integers beyond LARGEST in magnitude are a ValueError, as squared
distances must stay in 64 bits.  A null vec_id comes after all others; equal vec_ids
are ordered by their vectors.  With fewer than ENTRIES vectors, codebooks are
that much smaller.  Repeated rows get equal results.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .vectors import matrix, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors in a block, and the largest magnitude of a component.
BLOCK, LARGEST = 4096, 1 << 28
#: Distances are doubles; a part with a slack of less than this counts as violated.
CLOSE = 1e-6

_STATE = "ids binary, no_id binary, labels binary, no_label binary, x binary, codes binary, keys binary, moved binary"


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, in integers."""
    d = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        e = x[:, j, None] - book[None, :, j]
        d += e * e
    return d


def rescan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (the first of equals), and its slack."""
    d = squared(x, book)
    own = d.argmin(1)
    best = d[np.arange(len(x)), own]
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64)) if len(book) > 1 else np.full(len(x), np.inf)
    return own, second - np.sqrt(best.astype(np.float64))


def heaps(codes: np.ndarray, keys: np.ndarray, entries: int) -> list[list[tuple[float, int]]]:
    """A heap an entry of (key, row) of the rows assigned to it."""
    order = np.lexsort((keys, codes))  # a sorted list is a heap
    cuts = np.searchsorted(codes[order], np.arange(entries + 1))
    k, o = keys[order].tolist(), order.tolist()
    return [list(zip(k[a:b], o[a:b])) for a, b in zip(cuts, cuts[1:])]


def violated(heap: list[tuple[float, int]], drift: float) -> list[int]:
    """Rows popped from the heap whose keys the drift has reached."""
    out = []
    while heap and heap[0][0] <= drift + CLOSE:
        out.append(heapq.heappop(heap)[1])
    return out


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each position and entry: its own move and the greatest of the others'."""
    move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))
    if move.shape[1] < 2:
        return move
    order = np.sort(move, 1)
    other = np.repeat(order[:, -1:], move.shape[1], axis=1)
    other[np.arange(len(move)), move.argmax(1)] = order[:, -2]
    return move + other


def _first(v: DataFrame, width: int, entries: int, parts: int) -> np.ndarray:
    rows = v.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # the first codebooks
    whole = np.floor(256.0 * np.array([r.v for r in rows]))
    return _integers(whole).reshape(len(rows), parts, width // parts).transpose(1, 0, 2)


def _integers(x: np.ndarray) -> np.ndarray:
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"components over {LARGEST} in magnitude")
    return x.astype(np.int64)


def _blocks(v: DataFrame, width: int, parts: int) -> DataFrame:
    """Staged blocks of vectors as integers, without codes yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _integers(np.floor(256.0 * matrix(part.column(1), width)))
                ids, labels = part.column(0), part.column(2)
                cells = [ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), labels.fill_null(0).to_numpy().astype(np.int32), labels.is_null().to_numpy(zero_copy_only=False), x.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in cells), *(pa.array([b""], pa.binary()) for _ in range(3))], names=[c.split()[0] for c in _STATE.split(", ")])

    return staged(v.select("vec_id", "v", "label").mapInArrow(run, _STATE), "vector-blocks")


def _round(blocks: DataFrame, books: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """Blocks with new codes and keys, and the sums of what moved; ``drift`` None: nothing is assigned yet."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda i: batch.column(i)[row].as_buffer()  # noqa: B023, E731
                x = np.frombuffer(cell(4), np.int32).reshape(-1, parts, width).astype(np.int64)
                n = len(x)
                codes, keys = np.zeros((parts, n), np.uint8), np.full((parts, n), -np.inf)
                if drift is not None:
                    codes, keys = np.frombuffer(cell(5), np.uint8).reshape(parts, n).copy(), np.frombuffer(cell(6), np.float64).reshape(parts, n).copy()
                moved = np.zeros((parts, entries, width + 1), np.int64)
                for p in range(parts):
                    if drift is None:
                        stale = np.arange(n)
                    else:
                        stale = np.array([i for e, heap in enumerate(heaps(codes[p], keys[p], entries)) for i in violated(heap, drift[p, e])], np.int64)
                    if not len(stale):
                        continue
                    own, slack = rescan(x[stale, p], books[p])
                    wide = np.concatenate([x[stale, p], np.ones((len(stale), 1), np.int64)], 1)
                    if drift is not None:
                        np.subtract.at(moved[p], codes[p, stale], wide)
                    np.add.at(moved[p], own, wide)
                    codes[p, stale] = own
                    keys[p, stale] = slack + (0.0 if drift is None else drift[p, own])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, 1) for i in range(5)), *(pa.array([a.tobytes()], pa.binary()) for a in (codes, keys, moved))], names=batch.schema.names)

    return staged(blocks.mapInArrow(run, _STATE), "vector-codes")


def _sums(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The moved sums of all blocks: one small array a task, then one in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.frombuffer(batch.column(0)[i].as_buffer(), np.int64).reshape(shape)
        flat = total.reshape(-1)
        held = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(flat[held])], names=["at", "n"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.select("moved").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(shape)


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    parts, entries, width = books.shape
    two = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, none, labels, no_label, x, codes = (np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in enumerate((np.int64, bool, np.int32, bool, np.int32, np.uint8)))
                x, codes = x.reshape(-1, parts, width).astype(np.int64), codes.reshape(parts, -1)
                error = np.zeros(len(x), np.int64)
                for p in range(parts):
                    e = x[:, p] - books[p][codes[p]]
                    error += (e * e).sum(1)
                text = ["".join(c) for c in two[codes.T]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(labels, mask=no_label), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.select("ids", "no_id", "labels", "no_label", "x", "codes").mapInArrow(run, "vec_id bigint, label int, code string, error bigint")


def compress(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every usable row; codebooks by part, entry and component)."""
    v, width = usable(vectors)
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    if not width:
        return v.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = _first(v, width, entries, parts)
    blocks = _blocks(v, width, parts)
    drift, sums = None, np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for k in range(rounds + 1):
        after = _round(blocks, books, drift)
        release(blocks)
        blocks = after
        if k == rounds:
            break
        sums += _sums(blocks, sums.shape)
        count = sums[..., -1:]
        new = np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), books)
        drift = drifts(books, new) + (0.0 if drift is None else drift)
        books = new
    return _coded(blocks, books), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: error summed over the rows of a label, null labels together.

    Sums by label are pre-aggregated and join by label, so a label with a third of all rows is no group of its own.
    """
    coded = staged(coded, "coded")
    key = [F.coalesce("label", F.lit(0)).alias("_l"), F.col("label").isNull().alias("_n")]
    sums = coded.groupBy(*key).agg(F.sum("error").alias("label_error"))
    return coded.select("*", *key).join(sums, ["_l", "_n"]).drop("_l", "_n")


ORACLE_SQL = """
WITH raw AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT r, p, list_transform(embedding[p * d + 1:p * d + d], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM (SELECT r, embedding, len(embedding) // 16 AS d, unnest(range(0, 16)) AS p FROM raw)),
b0 AS (SELECT p, r - 1 AS e, v AS c FROM part WHERE r <= 64),
a0 AS (SELECT r, p, any_value(v) AS v, arg_min(e, {'d': d, 'e': e}) AS e FROM (SELECT r, p, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN b0 USING (p)) GROUP BY r, p),
m0 AS (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS f FROM (SELECT p, e, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM a0) GROUP BY p, e, i) GROUP BY p, e),
b1 AS (SELECT p, e, coalesce(m0.c, b0.c) AS c FROM b0 LEFT JOIN m0 USING (p, e)),
a1 AS (SELECT r, p, any_value(v) AS v, arg_min(e, {'d': d, 'e': e}) AS e FROM (SELECT r, p, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN b1 USING (p)) GROUP BY r, p),
m1 AS (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS f FROM (SELECT p, e, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM a1) GROUP BY p, e, i) GROUP BY p, e),
b2 AS (SELECT p, e, coalesce(m1.c, b1.c) AS c FROM b1 LEFT JOIN m1 USING (p, e)),
a2 AS (SELECT r, p, arg_min(e, {'d': d, 'e': e}) AS e, min(d) AS d FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN b2 USING (p)) GROUP BY r, p),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, unnest(c) AS x, unnest(range(0, len(c))) AS i FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM raw JOIN o USING (r), h
"""
