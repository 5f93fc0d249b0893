"""Tables that cut a plan: written once, read back, deleted when nobody needs them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class Stage:
    """A folder of staged tables, in ``path``, else in spark.checkpoint.dir, which executors share.

    What is read back has a scan for a plan, whatever came before, and its files outlive executors.
    ``close`` deletes the folder; so does the end of the driver.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        if path is None:
            path = spark.conf.get("spark.checkpoint.dir", None)
            if not path:
                if spark.sparkContext.master.split("[")[0] != "local":
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
                path = tempfile.mkdtemp(prefix="densitylab-")
                spark.conf.set("spark.checkpoint.dir", path)
        self.spark, self.path, self.held = spark, f"{path.rstrip('/')}/stage-{uuid.uuid4().hex}", []
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """``df`` as a staged table; with ``keep`` executors also hold it, as it is read again and again."""
        at = f"{self.path}/{len(self.held)}-{name}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        if keep:
            out = out.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(out)
        out.stage_path = at
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """Staged tables of one schema as one scan, however many they are."""
        return self.spark.read.schema(frames[0].schema).parquet(*[f.stage_path for f in frames])

    def close(self) -> None:
        with contextlib.suppress(Exception):
            for df in self.held:
                df.unpersist()
            self.held.clear()
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.close()
