"""VCF folders as studies (S13): samples from the headers, records by byte ranges, markers numbered in genome order.

A folder may hold any number of files, in any order of names and records: text, gzip, or
block gzip, told apart by their first bytes.  Text and block gzip are read in ranges of
SPLIT bytes, a task a range; a plain gzip stream can't be entered in the middle and is one task.
A record belongs to the range in which the line before it ends, so each is read once.

Defined results: records count if they are SNPs with one alternative allele, on ``contigs``, and
pass (PASS or .); others go whole.  A call is the first field of a sample, if FORMAT begins with GT:
0/0, 0/1 and 1/1, phased or not, are 0, 1 and 2, and any other call is missing.  All files must have the
same samples in the same order, and every record as many calls; repeated records are an error.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import variant_id
from ..operators import validate as va
from ..operators.ordering import ranked
from ..operators.stage import Stage
from .readers import MARKER_VEC, SourceError

CONTIGS = ("1", "2", "3", "4", "5")
SPLIT = 32 << 20
#: Bytes of text that are decoded, and of lines that are handed on, at a time.
PIECE, BATCH = 1 << 20, 4 << 20
#: First bytes of a block of block gzip: the gzip magic with an extra field of six bytes, of which BC names the block's size.
_MAGIC, _EXTRA = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"


def files(spark: SparkSession, path: str, pattern: str = "*.vcf*") -> DataFrame:
    """path, length of the files that aren't empty in a folder, or of one file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length").filter("length > 0")


def _opened(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    fs, at = pafs.FileSystem.from_uri(quote(path, safe="/:@"))
    return fs.open_input_file(at)


def _next_block(f, at: int, size: int) -> int:
    """Where the first block at ``at`` or later begins; ``size`` if none does."""
    while at < size:
        f.seek(at)
        part = f.read(PIECE + 16)
        i = -1
        while (i := part.find(_MAGIC, i + 1)) >= 0 and i < PIECE:
            if part[i + 10 : i + 16] == _EXTRA:
                return at + i
        at += PIECE
    return size


def pieces(f, size: int, lo: int, hi: int) -> Iterator[tuple[bytes, bool]]:
    """Text from the first piece that begins in [lo, hi) to the end of the file, each with whether it begins before ``hi``."""
    f.seek(0)
    head, at = f.read(18), lo
    if head[:2] != _MAGIC[:2]:
        while at < size:
            f.seek(at)
            part = f.read(min(PIECE, hi - at) if at < hi else PIECE)
            yield part, at < hi
            at += len(part)
    elif head[:4] != _MAGIC or head[10:16] != _EXTRA:
        if lo == 0:
            f.seek(0)
            stream = gzip.GzipFile(fileobj=f)
            while part := stream.read(PIECE):
                yield part, True
    else:
        at = _next_block(f, lo, size)
        while at < size:
            f.seek(at)
            length = int.from_bytes(f.read(18)[16:18], "little") + 1
            f.seek(at)
            yield zlib.decompress(f.read(length), 31), at < hi
            at += length


def chunks(parts: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[bytes]:
    """Whole lines of a range: those after its first line end (from the start in a file's first range), up to the first line end beyond it."""
    held, skip = [], not first
    for part, own in parts:
        if not own:
            if skip:
                return
            cut = part.find(b"\n")
            if cut < 0:
                held.append(part)
                continue
            yield b"".join([*held, part[:cut]])
            return
        if skip:
            cut = part.find(b"\n")
            if cut < 0:
                continue
            part, skip = part[cut + 1 :], False
        cut = part.rfind(b"\n")
        if cut < 0:
            held.append(part)
            continue
        yield b"".join([*held, part[:cut]])
        held = [part[cut + 1 :]]
    if any(held):
        yield b"".join(held)


def _values(lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])


def lines(spark: SparkSession, path: str, pattern: str = "*.vcf*", split: int | None = None) -> DataFrame:
    """The lines of all files but those of headers, as value."""
    split = split or SPLIT
    ranges = files(spark, path, pattern).select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint"))).alias("lo"))

    def run(batches):
        for batch in batches:
            for name, size, lo in zip(*(c.to_pylist() for c in batch.columns)):
                out, held = [], 0
                with _opened(name) as f:
                    for chunk in chunks(pieces(f, size, lo, min(size, lo + split)), lo == 0):
                        out += [x.rstrip(b"\r") for x in chunk.split(b"\n") if x.strip() and not x.startswith(b"#")]
                        held += len(chunk)
                        if held >= BATCH:
                            yield _values(out)
                            out, held = [], 0
                yield _values(out)

    tasks = max(1, min(ranges.count(), 64 * spark.sparkContext.defaultParallelism))
    return ranges.repartition(tasks, "path", "lo").mapInArrow(run, "value string")


def samples(spark: SparkSession, path: str, pattern: str = "*.vcf*") -> DataFrame:
    """sample_id, sample_idx of the headers, which must agree."""

    def run(batches):
        for batch in batches:
            found = []
            for name, size in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(name) as f:
                    heads = (x for chunk in chunks(pieces(f, size, 0, size), True) for x in chunk.split(b"\n"))
                    head = next((x for x in heads if x.startswith(b"#CHROM") or not x.startswith(b"#")), b"")
                if not head.startswith(b"#CHROM"):
                    raise SourceError(f"{name} has no line of column names")
                found.append(head.rstrip(b"\r").decode().split("\t")[9:])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["ids"])

    own = files(spark, path, pattern)
    heads = own.repartition(max(1, min(own.count(), 1000))).mapInArrow(run, "ids array<string>").distinct().limit(2).collect()
    if len(heads) != 1:
        raise SourceError(f"{path}: files of different samples" if heads else f"{path}: no VCF files")
    out = spark.createDataFrame([(s, i) for i, s in enumerate(heads[0].ids)], "sample_id string, sample_idx int")
    va.check_samples(out)
    return out


def records(text: DataFrame, n_samples: int | None = None, contigs: Sequence[str] = CONTIGS) -> DataFrame:
    """chrom, pos, ref, alt, g (dosages by sample) of lines in ``value``; the calls of records that go are never cut."""
    head = F.split("value", "\t", 10)
    f = F.col("f")
    base = "^[ACGT]$"
    rows = text.select(head.alias("f")).filter(f[0].isin(list(contigs)) & f[3].rlike(base) & f[4].rlike(base) & (f[3] != f[4]) & f[6].isin("PASS", "."))

    def dosage(call):
        gt = F.substring_index(call, ":", 1)
        return F.when(gt.isin("0/0", "0|0"), 0).when(gt.isin("0/1", "1/0", "0|1", "1|0"), 1).when(gt.isin("1/1", "1|1"), 2).cast("tinyint")

    calls = F.when(F.size("f") > 9, F.split(F.get("f", F.lit(9)), "\t")).otherwise(F.array().cast("array<string>"))
    typed = F.coalesce(F.split(F.get("f", F.lit(8)), ":")[0] == "GT", F.lit(False))
    g = F.when(typed, F.transform(calls, dosage)).otherwise(F.transform(calls, lambda _: F.lit(None).cast("tinyint")))
    out = rows.select(f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), g.alias("g"))
    if n_samples is None:
        return out
    wrong = F.raise_error(F.concat_ws(" ", F.lit(f"not {n_samples} calls at"), "chrom", "pos"))
    return out.withColumn("g", F.when(F.size("g") == n_samples, F.col("g")).otherwise(wrong))


def of_samples(vec: DataFrame, positions: Sequence[int]) -> DataFrame:
    """``vec`` with the dosages at ``positions``, in that order."""
    pick = np.asarray(positions, np.int64)

    def run(batches):
        for batch in batches:
            g, k = batch.column(1), batch.num_rows
            offsets = g.offsets.to_numpy()[:-1].astype(np.int64)
            flat = g.values.take(pa.array((offsets[:, None] + pick).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * len(pick), pa.int32()), flat)], names=["marker_idx", "g"])

    return vec.select("marker_idx", "g").mapInArrow(run, MARKER_VEC)


def markers(spark: SparkSession, path: str, stage: Stage, contigs: Sequence[str] = CONTIGS, pattern: str = "*.vcf*", split: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, variants, marker_vec), with markers numbered from 0 by contig (in the given order), position and alleles.

    Records are parsed once and staged; the names of markers alone are sorted, by ranges.
    """
    people = samples(spark, path, pattern)
    place = F.array_position(F.array(*map(F.lit, contigs)), F.col("chrom"))
    parsed = stage.put(records(lines(spark, path, pattern, split), people.count(), contigs), "records")
    key = ["chrom", "pos", "ref", "alt"]
    va.none_of(va.repeated(parsed, *key), "Repeated variants")
    order = stage.put(ranked(parsed.select(*key, place.alias("place")), "place", "pos", "ref", "alt", name="marker_idx"), "variants")
    variants = order.select("marker_idx", *key, variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("marker_id"))
    return people, variants, parsed.join(order.select("marker_idx", *key), key).select("marker_idx", "g")


def write(vec: DataFrame, variants: DataFrame, ids: Sequence[str], path: str, contigs: Sequence[str] = CONTIGS) -> None:
    """A folder of VCF text files, each with a header, of ranges of the genome."""
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + list(ids))]
    calls = F.transform("g", lambda x: F.when(x == 0, "0/0").when(x == 1, "0/1").when(x == 2, "1/1").otherwise("./."))
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(calls, "\t"))
    place = F.array_position(F.array(*map(F.lit, contigs)), F.col("chrom"))
    rows = vec.join(variants, "marker_idx").select(place.alias("place"), "pos", "ref", "alt", line.alias("value"))
    order = ["place", "pos", "ref", "alt"]

    def run(batches):
        yield _values([x.encode() for x in head])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").mapInArrow(run, "value string").write.text(path)
