"""Sinks: tables, JSON, digests, and the guards of output folders."""

from __future__ import annotations

import hashlib
import json
import logging
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("densitylab")


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Columns in the given order; an existing folder is an error.  An empty table without named columns is one too."""
    if columns is None and df.isEmpty():
        raise ValueError("an empty table has no columns to write by")
    df.select(*(columns or df.columns)).write.mode(mode).csv(path, sep="\t", header=True)


def write_json(value: object, path: str) -> None:
    """UTF-8, indented, no NaN; replaced as a whole, so that no reader sees a part of it."""
    text = json.dumps(value, indent=2, allow_nan=False, ensure_ascii=False) + "\n"
    part = f"{path}.part"
    Path(part).write_text(text, encoding="utf-8")
    os.replace(part, path)


def new_folder(path: str) -> Path:
    """K8: the output folder must be new."""
    Path(path).mkdir(parents=True, exist_ok=False)
    return Path(path)


def resume(path: str, identity: dict) -> Path:
    """K9: a folder may go on only under the identity it was begun with."""
    out = Path(path)
    out.mkdir(parents=True, exist_ok=True)
    at = out / "identity.json"
    if at.exists():
        if json.loads(at.read_text(encoding="utf-8")) != json.loads(json.dumps(identity)):
            raise ValueError(f"{path} belongs to another run")
    else:
        write_json(identity, str(at))
    return out


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def digest(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


BLOCK = 8 << 20


def file_digests(spark: SparkSession, paths: Sequence[str], known: dict[str, dict] | None = None) -> dict[str, dict]:
    """{path: sha256, tree, bytes, mtime_ns} of files on shared paths, read in tasks.

    ``tree`` is the digest of the digests of blocks of BLOCK bytes, which tasks make side by side; ``sha256`` is
    that of a file of one block, else null.  A file in ``known`` with the same size and time isn't read again.
    """
    known, out, ranges = known or {}, {}, []
    for p in paths:
        s = os.stat(p)
        old = known.get(p)
        if old and old.get("bytes") == s.st_size and old.get("mtime_ns") == s.st_mtime_ns:
            out[p] = old
            continue
        out[p] = {"bytes": s.st_size, "mtime_ns": s.st_mtime_ns}
        ranges += [(p, k, k * BLOCK) for k in range(max(1, -(-s.st_size // BLOCK)))]
    if ranges:
        size = BLOCK

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                found = []
                for path, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    with open(path, "rb") as f:
                        f.seek(at)
                        found.append(hashlib.sha256(f.read(size)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["path", "k", "digest"])

        slices = min(len(ranges), 4 * spark.sparkContext.defaultParallelism)
        work = spark.createDataFrame(ranges, "path string, k bigint, at bigint").repartition(slices)
        blocks: dict[str, dict[int, str]] = {}
        for r in work.mapInArrow(run, "path string, k bigint, digest string").toLocalIterator():
            blocks.setdefault(r.path, {})[r.k] = r.digest
        for p, own in blocks.items():
            listed = [own[k] for k in sorted(own)]
            out[p] |= {"tree": text_digest("".join(listed)), "sha256": listed[0] if len(listed) == 1 else None}
    return out


def input_digests(spark: SparkSession, paths: Sequence[str], cache: str) -> dict[str, str]:
    """Name (path, where names repeat) and tree digest of each input, for a run's identity; ``cache``: a JSON file of what was read before."""
    known = json.loads(Path(cache).read_text(encoding="utf-8")) if Path(cache).exists() else {}
    found = file_digests(spark, paths, known)
    Path(cache).parent.mkdir(parents=True, exist_ok=True)
    write_json(found, cache)
    names = [Path(p).name for p in found]
    return {n if names.count(n) == 1 else p: d["tree"] for n, (p, d) in zip(names, found.items())}


def plain_digests(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """SHA-256 of whole files, a task a file, as manifests record them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(p, BLOCK) for p in batch.column(0).to_pylist()])], names=["path", "digest"])

    if not paths:
        return {}
    work = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return {r.path: r.digest for r in work.mapInArrow(run, "path string, digest string").collect()}


def markdown(df: DataFrame, title: str, notes: Sequence[str] = ()) -> str:
    """A small result table as Markdown."""
    rows = df.collect()
    cell = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), "", *(f"- {n}" for n in notes)]) + "\n"
