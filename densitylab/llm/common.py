"""Shared pieces: staged tables, Arrow plumbing, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Shuffle files go with the query that made them; batches to Python stay small where texts are long.
_WHILE_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def columns(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """The named columns, cast; one that is missing is null.

    A name is taken as it is written, else the first that differs from it in case alone, and
    columns are picked by position, so that extra columns of clashing names do no harm.
    """
    at = {}
    for name in kinds:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        at[name] = same[0] if same else None
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[(F.lit(None) if at[n] is None else F.col(f"_{at[n]}")).cast(kind).alias(n) for n, kind in kinds.items()])


def documents(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of documents; extra columns go."""
    kinds = {f.name: f.dataType for f in DOCUMENT}
    return columns(df, {n: kinds[n] for n in names})


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a session inside one machine may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="densitylab-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/densitylab-{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, label: str, into: DataFrame | None = None, **options: str) -> DataFrame:
    """``df`` written to the shared folder, with the writer's ``options``, and read back; behind the rows of ``into``, a staged table, if given.

    It cuts lineage with files that outlive executors, and Spark drops the
    shuffle files behind it at once.  The files go when the driver exits.
    """
    spark = df.sparkSession
    path = into.stage_path if into is not None else new_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in _WHILE_STAGING}
    for k, v in _WHILE_STAGING.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("errorifexists" if into is None else "append").options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if into is None:
        atexit.register(forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        if getattr(df, "stage_path", None):
            forget(df.sparkSession, df.stage_path)


def labelled(docs: DataFrame, labels: DataFrame, mark: str, held: Column, most: int, size: int, also: str | None = None) -> DataFrame:
    """doc_id, text, y: one text, the least, of each labelled document that isn't ``held``.

    It is a sample by hash of about ``most`` documents and ``size`` bytes of text, if there are more; a text
    larger than that alone is no part of it.  y is the greatest of a document's labels; ``also``: a further
    mark of the same documents, null where it has none.
    """
    kinds = {"doc_id": T.LongType(), mark: T.IntegerType()} | ({also: T.IntegerType()} if also else {})
    extra = [also] if also else []
    marks = columns(labels, kinds).toDF("doc_id", "y", *extra).filter("doc_id is not null and y is not null")
    marks = marks.filter(~held).groupBy("doc_id").agg(F.max("y").alias("y"), *[F.max(c).alias(c) for c in extra])
    share = lambda name, part: F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << 30)) < int((1 << 30) * part)
    n = marks.count()
    if n > most:
        marks = marks.filter(share("rows", most / n))
    rows = documents(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id")  # about ``most`` pairs of numbers
    out = staged(rows.groupBy("doc_id", "y", *extra).agg(F.min("text").alias("text")), f"labelled-{mark}")
    out = out.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= size)
    total = out.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return out.filter(share("bytes", size / total)) if total > size else out


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column's strings take about ``limit`` bytes each."""
    from . import textvec as tv

    for batch in batches:
        _, offsets = tv.buffers(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in tv.spans(offsets, limit):
            yield batch.slice(lo, hi - lo)


#: Edges of which one task finds the components.
FEW_EDGES = 1 << 14


def _least_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """node, component (its least node) for the undirected edges (a, b) of longs.

    Up to ``FEW_EDGES`` edges are joined in one task.  Of more, least labels move along edges and then along labels, until none changes.
    Every round is an aggregation and a join; no neighbourhood is collected.
    """
    if edges.count() <= FEW_EDGES:
        return staged(edges.select("a", "b").coalesce(1).mapInArrow(_least_nodes, "node bigint, component bigint"), f"{label}-few")
    both = staged(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{label}-0")
    k = 0
    while True:
        k += 1
        at = now.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        hop = now.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = staged(step.join(hop, "component").select("node", F.least("component", "up").alias("component"), "old"), f"{label}-{k}")
        changed = not new.filter(F.col("component") != F.col("old")).isEmpty()
        release(now)
        path, now = new.stage_path, new.select("node", "component")
        now.stage_path = path
        if not changed:
            release(both)
            return now


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``label`` (node, component) after links (a, b): only components that a link joins are looked at again."""
    if label is None:
        return None if links.isEmpty() else components(links)
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = named.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).filter("a <> b").distinct()
    edges = staged(edges, "joined")
    if edges.isEmpty():
        return label
    new = components(edges)
    moved = label.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = staged(moved.unionAll(new.join(label.select("node"), "node", "left_anti").select("node", "component")), "label")
    release(edges, label, new)
    return out
