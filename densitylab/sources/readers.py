"""Sources: delimited text, arrays, wide Parquet, configuration and published figures.

Genotypes become ``marker_vec(marker_idx INT, g ARRAY<TINYINT>)``, one row a
marker, element i the dosage of the sample with sample_idx i; missing is null.
"""

from __future__ import annotations

import io
import json
import tomllib
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER_VEC = T.StructType([T.StructField("marker_idx", T.IntegerType()), T.StructField("g", T.ArrayType(T.ByteType()))])


class SourceError(ValueError):
    pass


def delimited(spark: SparkSession, path: str, required: Sequence[str] = (), sep: str = "\t") -> DataFrame:
    """All columns as text; an error unless the required ones are there."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, nullValue="\0", emptyValue="")
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise SourceError(f"{path} lacks {', '.join(lacking)}")
    return df.na.fill("")


def tsv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    return delimited(spark, path, required)


def csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    return delimited(spark, path, required, ",")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows of a file numbered from 0 in its order: their place in their partition after the sizes of those before, one number a partition."""
    at = F.monotonically_increasing_id()
    sizes = df.select(F.shiftright(at, 33).alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()
    first, before = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        first[r.part], before = before, before + r.n
    starts = F.create_map(*[F.lit(x) for part, n in first.items() for x in (part, n)]) if first else F.lit(None).cast("map<bigint,int>")
    out = df.withColumn("_at", at)
    return out.withColumn(name, (starts[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_at")


def column_blocks(n: int, size: int) -> list[tuple[int, int]]:
    if size < 1:
        raise SourceError("a block holds a column at least")
    return [(lo, min(n, lo + size)) for lo in range(0, n, size)]


def _dosage_rows(index: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """values: markers x samples; checks the domain and turns -1 (int8) or NaN into null."""
    if values.dtype == np.int8:
        missing = values == -1
        wrong = (values < -1) | (values > 2)
    else:
        values = values.astype(np.float64)
        missing = np.isnan(values)
        wrong = ~missing & (values != 0) & (values != 1) & (values != 2)
    if wrong.any():
        raise SourceError("dosages are 0, 1, 2 or missing")
    flat = pa.array(np.where(missing, 0, values).astype(np.int8).ravel(), mask=missing.ravel())
    at = np.arange(0, flat.__len__() + 1, values.shape[1], dtype=np.int32) if values.shape[1] else np.zeros(len(index) + 1, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), flat)], names=["marker_idx", "g"])


def npy(spark: SparkSession, path: str, marker_axis: int = 1, samples: Sequence[int] | None = None, block: int = 1024) -> DataFrame:
    """marker_vec of a dense ``.npy`` file on a shared path; tasks map it and copy only their strips.

    ``samples`` projects sample positions, in the given order; others are never read out.
    """
    shape = np.load(path, mmap_mode="r", allow_pickle=False).shape
    pick = None if samples is None else np.asarray(samples, np.int64)

    def run(batches):
        raw = np.load(path, mmap_mode="r", allow_pickle=False)
        for batch in batches:
            for lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                strip = raw[lo:hi] if marker_axis == 0 else raw[:, lo:hi].T
                yield _dosage_rows(np.arange(lo, hi), np.ascontiguousarray(strip if pick is None else strip[:, pick]))

    strips = column_blocks(shape[marker_axis], block)
    return spark.createDataFrame(strips, "lo bigint, hi bigint").repartition(max(1, len(strips))).mapInArrow(run, MARKER_VEC)


def wide_parquet(spark: SparkSession, path: str, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(samples, marker_vec) of a file with an id column and one column a marker.

    The wide schema stays out of the planner: each task reads its own columns.
    """
    import pyarrow.parquet as pq

    names = pq.ParquetFile(path).schema_arrow.names
    ids = pq.read_table(path, columns=names[:1]).column(0).to_pylist()
    samples = spark.createDataFrame([(str(s), i) for i, s in enumerate(ids)], "sample_id string, sample_idx int")
    markers = names[1:]

    def run(batches):
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                table = pq.read_table(path, columns=markers[lo : lo + block])
                values = np.stack([c.to_numpy().astype(np.float64) for c in table.columns])
                if not np.isfinite(values).all():
                    raise SourceError("genotypes must be complete")
                at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(values), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel()))], names=["marker_idx", "g"])

    n = -(-len(markers) // block)
    kinds = T.StructType([T.StructField("marker_idx", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
    return samples, spark.range(0, n * block, block, max(1, n)).mapInArrow(run, kinds)


def phenotypes_of(spark: SparkSession, path: str, trait: str, ids: DataFrame, id_column: str = "acid") -> DataFrame:
    """sample_id, value: projection and semi join at the scan, rounded to 32-bit floats."""
    from ..functions.scalars import single_rounded

    table = spark.read.parquet(path).select(F.col(id_column).cast("string").alias("sample_id"), single_rounded(F.col(trait)).alias("value"))
    return table.join(ids.select("sample_id"), "sample_id", "left_semi")


def development_labels(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Labels of development samples alone; sealed ones never reach a plan."""
    return labels.join(splits.filter(F.col("partition") == "development").select("sample_id"), "sample_id", "left_semi")


def config(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    return tomllib.loads(text) if path.endswith(".toml") else json.loads(text)


def published_folds(text: DataFrame, folds: int = 10) -> DataFrame:
    """fold, mse, rmse, pcc, mae from lines like ``PCC per fold: [0.7, np.float64(0.71), ...]``.

    ``text`` has a whole report a row in the column value; other columns go along.
    """
    along = [c for c in text.columns if c != "value"]

    def values(name: str):
        inside = F.regexp_extract("value", rf"{name} per fold: \[([^\]]*)\]", 1)
        return F.from_json(F.concat(F.lit("["), F.regexp_replace(inside, r"np\.float64\(([^)]*)\)", "$1"), F.lit("]")), "array<double>")

    rows = text.select(*along, values("PCC").alias("pcc"), values("RMSE").alias("rmse"), values("MAE").alias("mae"))
    checked = rows.select(*along, *[F.when(F.size(c) == folds, F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: not {folds} folds"))).alias(c) for c in ("pcc", "rmse", "mae")])
    out = checked.select(*along, F.posexplode(F.arrays_zip("pcc", "rmse", "mae")).alias("fold", "m"))
    return out.select(*along, "fold", (F.col("m.rmse") * F.col("m.rmse")).alias("mse"), F.col("m.rmse").alias("rmse"), F.col("m.pcc").alias("pcc"), F.col("m.mae").alias("mae"))


def demo_arrays(seed: int = 20260922, n: int = 60, p: int = 160) -> dict:
    """The synthetic study: homozygous dosages with 2 % missing, three groups, five chromosomes, one trait of two markers."""
    rng = np.random.default_rng(seed)
    # the draws' order fixes the study: frequencies, dosages, noise, gaps; effects are multiplied in single precision
    frequency = rng.uniform(0.08, 0.5, p)
    x = (2 * rng.binomial(1, frequency, size=(n, p))).astype(np.float32)
    y = 1.4 * x[:, 5] - 0.9 * x[:, 35] + rng.normal(size=n)
    x[rng.random((n, p)) < 0.02] = np.nan
    per = p // 5
    return {
        "genotypes": x,
        "samples": [(f"synthetic_{i:03d}", f"G{i % 3}") for i in range(n)],
        "variants": [(str(j // per + 1), (j % per + 1) * 1000, "A", "G") for j in range(p)],
        "phenotypes": [(f"synthetic_{i:03d}", "synthetic", float(v)) for i, v in enumerate(y)],
    }


def write_demo(folder: str) -> None:
    d, out = demo_arrays(), Path(folder)
    out.mkdir(parents=True)
    np.save(out / "genotypes.npy", d["genotypes"])
    (out / "dataset.json").write_text(json.dumps({"synthetic": True, "seed": 20260922}, indent=2) + "\n", encoding="utf-8")
    for name, head in (("samples", "accession_id\tgenetic_group"), ("variants", "chromosome\tposition\tref\talt"), ("phenotypes", "accession_id\ttrait_id\tvalue")):
        with io.open(out / f"{name}.tsv", "w", encoding="utf-8") as f:
            f.write("\n".join([head, *("\t".join(map(str, r)) for r in d[name])]) + "\n")
