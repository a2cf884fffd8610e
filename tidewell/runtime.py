"""Session plumbing: the package on Python workers, written tables for loops."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors once per application, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix=f"{root.name}-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.relpath(p, root.parent))
    sc.addPyFile(f.name)
    atexit.register(Path(f.name).unlink, missing_ok=True)
    _shipped.add(sc.applicationId)


def spread(table: DataFrame, key: str) -> DataFrame:
    """A scanned table, dealt out by ``key`` if it comes in fewer partitions than there
    are cores (a small file, or one of a single row group); larger ones stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)


def broadcast_if_few(df: DataFrame, counted: DataFrame | None = None, rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if ``counted`` (itself by default), which bounds it, has at most ``rows`` rows."""
    few = (df if counted is None else counted).limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset, a temporary one with a
    local master, whose executors share it; an error with any other."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='scratch-')}")
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


class Tables:
    """Written tables that cut the lineage of loops; they survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[str, DataFrame]] = {}
        atexit.register(self._at_exit)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def alias(self, df: DataFrame, of: DataFrame) -> None:
        """``drop(df)`` deletes the table of ``of``."""
        self.paths[id(df)] = (self.paths[id(of)][0], df)

    def drop(self, df: DataFrame) -> None:
        held = self.paths.pop(id(df), None)
        if held:
            self._delete(held[0])

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _at_exit(self) -> None:
        sc = SparkContext._active_spark_context
        if sc is not None and sc._jsc is not None:
            try:
                self._delete(self.root)
            except Exception:  # the session is going down; the tables are scratch
                pass
