"""Token-id output in training order (operator 1).

Each task joins the ids of its documents (each closed by an end id) into
sequences of ``length`` ids; a task's last sequence is padded with the end id.
The sequences are written once, compressed, to the shared folder.  Counts by
task, one number each, give every sequence a dense number 0 .. N - 1, and a keyed
Feistel permutation with cycle-walking turns it into its global slot.  Slots
are cut into ranges of ``per_shard``; each shard is a file of records of a fixed
stride, so record ``slot`` stands at byte ``(slot mod per_shard) * stride`` of
shard ``slot div per_shard``, and reading resumes from a slot alone.

Slots are dealt to the writing tasks by ranges of shards, so every task writes as
many, one after another.  This is done in GROUPS ranges of all slots, so that the
shuffle files of one are gone before the next begins.  A shard is written under a
temporary name and then renamed; a task that runs again writes the same bytes.  A
writing task holds one record at a time.

Defined results: a null or empty text is the end id alone; repeated rows and
null ids are kept; an empty table gives no shards.  Extra columns are ignored.
Records have 16 bits an id: a vocabulary of more than 65,536 ids is a ValueError.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from . import textvec as tv
from .common import documents, in_slices, release, staged

LENGTH, PER_SHARD, ROUNDS, GROUPS = 2048, 2048, 6, 2
#: Shards that a writing task may have beyond one for each of the shuffle's partitions.
PER_TASK = 8


def _step(x: np.ndarray, half: int, key: int) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(ROUNDS):
        turn = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & ((1 << 64) - 1))
        left, right = right, left ^ (tv.mix64(tv.mix64(right ^ turn) + turn) & mask)
    return (left << np.uint64(half)) | right


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each index, a keyed permutation of 0 .. n - 1."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    x = _step(np.asarray(index, np.uint64), half, key)
    while True:  # values outside walk on along their cycle until they are inside
        out = np.flatnonzero(x >= np.uint64(n))
        if not len(out):
            return x.astype(np.int64)
        x[out] = _step(x[out], half, key)


def _sequences(path: str, length: int):
    def run(batches):
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=1).compress
        encode = tk.encoder(path).encode
        task, number = TaskContext.get().partitionId(), 0
        held, have, parts = [], 0, []

        def record():
            nonlocal number, held, have, parts
            ids = np.concatenate(held)
            head, rest = ids[:length], ids[length:]
            own, left, at = [], [], 0
            for doc, start, size in parts:
                inside = min(size, length - at) if at < length else 0
                if inside:
                    own.append({"doc_id": doc, "start": start, "length": inside, "offset": at})
                if size > inside:
                    left.append((doc, start + inside, size - inside))
                at += inside
            full = np.full(length, tk.END, np.uint32)
            full[: len(head)] = head
            small = full.astype("<u2")
            row = (task, number, squeeze(small.tobytes()), zlib.crc32(small.tobytes()), own)
            number += 1
            held, have, parts = [rest], len(rest), left
            return row

        def batch_of(rows):
            piece = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())]))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), piece]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["task", "number", "body", "crc32", "pieces"])

        for batch in in_slices(batches, limit=tk.SLICE_BYTES):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(tk.END))
                held.append(ids)
                parts.append((doc, 0, len(ids)))
                have += len(ids)
                while have >= length:
                    rows.append(record())
            if rows:
                yield batch_of(rows)
        if have:
            yield batch_of([record()])

    return run


def _write(folder: str, length: int, per_shard: int):
    def run(batches):
        from zstandard import ZstdDecompressor

        expand = ZstdDecompressor().decompress
        fs, root = pafs.FileSystem.from_uri(folder)
        out, shard, at = None, None, 0
        trial = TaskContext.get().taskAttemptId()

        def close():
            out.close()
            fs.move(f"{root}/.part-{shard}-{trial}", f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            slots, bodies = batch.column(0).to_pylist(), batch.column(1)
            for slot, body in zip(slots, bodies):
                if slot // per_shard != shard:
                    if out is not None:
                        close()
                    shard, at = slot // per_shard, 0
                    out = fs.open_output_stream(f"{root}/.part-{shard}-{trial}")
                if slot % per_shard != at:
                    raise ValueError(f"slot {slot} is out of order")
                out.write(expand(body.as_py(), max_output_size=2 * length))
                at += 1
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([c for n, c in zip(names, batch.columns) if n != "body"], names=[n for n in names if n != "body"])
        if out is not None:
            close()

    return run


def write_shards(docs: DataFrame, folder: str, key: int = 20240229, length: int = LENGTH, per_shard: int = PER_SHARD, path: str | None = None) -> DataFrame:
    """Write the shards and a manifest; one row per piece of a document in a sequence.

    Rows: doc_id, start, length, slot, shard, offset (ids before it in its
    sequence), byte_at (of the sequence in its shard) and sequence_crc32.
    """
    path = path or tk.vocabulary_path()
    if tk.encoder(path).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of this vocabulary don't fit 16 bits")
    spark = docs.sparkSession
    kinds = "task int, number bigint, body binary, crc32 bigint, pieces array<struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint>>"
    made = staged(documents(docs, "doc_id", "text").mapInArrow(_sequences(path, length), kinds), "sequences")
    counts = sorted((r.task, r.n) for r in made.groupBy("task").agg(F.count("*").alias("n")).collect())  # one number a task
    tasks, sizes = np.array([t for t, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
    before, total = np.cumsum(sizes) - sizes, int(sizes.sum())

    def place(lo: int, hi: int):
        def run(batches):
            for batch in batches:
                own = np.searchsorted(tasks, batch.column(0).to_numpy())
                slot = permute(before[own] + batch.column(1).to_numpy(), total, key)
                out = pa.RecordBatch.from_arrays([pa.array(slot), batch.column(2), batch.column(3), batch.column(4)], names=["slot", "body", "crc32", "pieces"])
                yield out.filter(pa.array((slot >= lo) & (slot < hi)))

        return run

    n_shards = max(1, -(-total // per_shard))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = "slot bigint, body binary, crc32 bigint, pieces array<struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint>>"
    table, groups = None, max(1, min(GROUPS, n_shards))
    for g in range(groups):
        first, last = g * n_shards // groups, (g + 1) * n_shards // groups
        placed = made.mapInArrow(place(first * per_shard, last * per_shard), rows)
        n_tasks = min(last - first, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (last - first) // PER_TASK))
        task = F.expr(f"cast((slot div {per_shard} - {first}) * {n_tasks} div {last - first} as int)")
        dealt = placed.repartitionById(n_tasks, task).sortWithinPartitions("slot")
        own = staged(dealt.mapInArrow(_write(folder, length, per_shard), rows.replace("body binary, ", "")), f"slots-{g}")
        table = own if table is None else table.unionAll(own)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "per_shard": per_shard, "dtype": "<u2", "key": key, "shards": n_shards if total else 0}).encode())
    release(made)
    one = table.select("slot", "crc32", F.explode("pieces").alias("p"))
    return one.select(
        F.col("p.doc_id").alias("doc_id"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        "slot",
        F.expr(f"slot div {per_shard}").alias("shard"),
        F.col("p.offset").alias("offset"),
        (F.pmod("slot", F.lit(per_shard)) * 2 * length).alias("byte_at"),
        F.col("crc32").alias("sequence_crc32"),
    )


def read_slots(folder: str, first: int = 0, count: int | None = None):
    """Sequences from slot ``first`` on, in order; a reader that stopped resumes with its next slot."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["sequences"] if count is None else min(m["sequences"], first + count)
    stride = 2 * m["length"]
    while first < stop:
        shard, at = divmod(first, m["per_shard"])
        n = min(stop - first, m["per_shard"] - at)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            for _ in range(n):
                yield np.frombuffer(f.read(stride), m["dtype"])
        first += n
