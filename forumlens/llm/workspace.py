"""Tables written to the cluster's shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local folder of our own only where all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="forumlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


BATCH_ROWS = 2000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts of at most ``BATCH_ROWS`` rows: both ends of a Python task hold a batch."""
    held = int(spark.conf.get(_BATCHES))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows with different values or nulls apart, whatever the values."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """Workspaces opened inside are deleted at the end; what reads them must have been written by then."""
    opened: list[Workspace] = []
    token = _scratch.set(opened)
    try:
        yield
    finally:
        _scratch.reset(token)
        for work in opened:
            work.drop()


class Workspace:
    """Intermediate tables of one query, each written once as Parquet and read back.

    A table that a returned DataFrame still reads must stay; ``drop`` removes the others as soon as
    they have been used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/forumlens-{uuid.uuid4().hex}"
        opened = _scratch.get()
        if opened is not None:
            opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """A table, after which all others of the workspace are deleted."""
        out = self.table(df, name)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        others = [f for f in (x.getPath().getName() for x in system.listStatus(root)) if f != name]
        if others:
            self.drop(*others)
        return out

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or the whole workspace."""
        for place in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
