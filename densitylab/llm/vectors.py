"""Usable rows of an embeddings table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns

_KINDS = {"vec_id": T.LongType(), "embedding": T.ArrayType(T.FloatType()), "label": T.IntegerType()}


def usable(df: DataFrame, zero: bool = True) -> tuple[DataFrame, int]:
    """(vec_id, v, label) of finite vectors, and their length (0: there are none).

    Vectors that are null or hold a null or a component that isn't finite are left out, and
    zero vectors too unless ``zero``.  Vectors of another length than the most frequent one
    (the shortest of ties) can't be compared and are left out.  Components are doubles.
    """
    v = columns(df, _KINDS).select("vec_id", F.col("embedding").alias("v"), "label")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", odd), F.lit(True)))
    if not zero:
        v = v.filter(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return v.withColumn("v", F.col("v").cast("array<double>")), 0
    # x + 0.0 makes -0.0 equal to 0.0
    return v.filter(F.size("v") == sizes.n).withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0))), sizes.n


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), width)
