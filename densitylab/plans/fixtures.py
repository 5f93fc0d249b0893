"""Genotype-like views of the driver tables, so that every operator has rows and an oracle.

embeddings: a vector is a sample, a dimension a marker; values become dosages
0, 1, 2 or missing.  The label is the group and the outer fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .study import Study

LOW, HIGH = -0.06, 0.06


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, label, marker_idx, g."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("m", "e"))
    x = F.col("e").cast("double")
    g = F.when((F.col("vec_id") * 31 + F.col("m") * 17) % 50 == 0, F.lit(None)).when(x < LOW, 0).when(x < HIGH, 1).otherwise(2)
    return e.select(F.col("vec_id").alias("sample_idx"), "label", F.col("m").alias("marker_idx"), g.cast("int").alias("g"))


#: The same view for DuckDB.
DOSAGE_SQL = """dosage AS (SELECT vec_id AS sample_idx, label, (m - 1)::INTEGER AS marker_idx,
 CASE WHEN (vec_id * 31 + (m - 1) * 17) % 50 = 0 THEN NULL WHEN e::DOUBLE < -0.06 THEN 0 WHEN e::DOUBLE < 0.06 THEN 1 ELSE 2 END AS g
 FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS m FROM embeddings))"""

VARIANT_SQL = """variant AS (SELECT m::INTEGER AS marker_idx, (m // 13 + 1)::VARCHAR AS chrom, (m % 13 + 1) * 400000 AS pos,
 concat_ws(':', (m // 13 + 1)::VARCHAR, ((m % 13 + 1) * 400000)::VARCHAR, 'A', 'G') AS marker_id FROM (SELECT DISTINCT unnest(range(0, len(embedding))) AS m FROM embeddings))"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker a component of the vectors."""
    every = table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("n")).filter("n > 0").distinct().select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("id")).distinct()
    v = every.select(F.col("id").alias("marker_idx"), F.expr("cast(id div 13 + 1 as string)").alias("chrom"), ((F.col("id") % 13 + 1) * 400000).cast("bigint").alias("pos"))
    return v.select("*", F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.lit("A"), F.lit("G")).alias("marker_id"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker a part, spread over five chromosomes."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("marker_idx"), F.expr("cast(p_partkey % 5 + 1 as string)").alias("chrom"), ((F.col("p_partkey").cast("bigint") * 7919) % 50_000_000 + 1).alias("pos"))
    return p.select("*", F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.lit("A"), F.lit("G")).alias("marker_id"))


#: The same for DuckDB.
CATALOGUE_SQL = """catalogue AS (SELECT p_partkey::INTEGER AS marker_idx, (p_partkey % 5 + 1)::VARCHAR AS chrom, (p_partkey::BIGINT * 7919) % 50000000 + 1 AS pos,
 concat_ws(':', (p_partkey % 5 + 1)::VARCHAR, ((p_partkey::BIGINT * 7919) % 50000000 + 1)::VARCHAR, 'A', 'G') AS marker_id FROM part)"""


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_idx"), (10 * (1.4 * e["embedding"][5].cast("double") - 0.9 * e["embedding"][35].cast("double"))).alias("y"))


def vectors(long: DataFrame) -> DataFrame:
    """marker_vec of sample_idx, marker_idx, g: dosages in sample order.

    A call travels as one number, the sample's (below 2^61) times 4 plus the dosage (3: missing), which sorts by sample.
    """
    call = F.shiftleft("sample_idx", 2).bitwiseOR(F.coalesce("g", F.lit(3)).cast("bigint"))
    g = lambda x: x.bitwiseAND(F.lit(3))
    ordered = F.array_sort(F.collect_list(call))
    return long.groupBy("marker_idx").agg(ordered.alias("v")).select("marker_idx", F.transform("v", lambda x: F.when(g(x) < 3, g(x).cast("tinyint"))).alias("g"))


def study(spark: SparkSession, sf_dir: str) -> tuple[Study, np.ndarray]:
    """The whole table as a study, and each sample's label; dosages stay in tasks, and what a sample has here are a few numbers in arrays."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_idx"), "label").join(phenotype(spark, sf_dir), "sample_idx").orderBy("sample_idx").toArrow()
    of = t.column("sample_idx").to_numpy()
    named = lambda x, head, width: np.array([f"{head}{i:0{width}d}" for i in x.tolist()], dtype=str)
    vec = vectors(dosage(spark, sf_dir).select("sample_idx", "marker_idx", "g")).cache()
    return Study(named(of, "", 6), t.column("y").to_numpy(), vec, variants(spark, sf_dir).cache(), named(of // 5, "b", 5)), t.column("label").to_numpy()
