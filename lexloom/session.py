"""Session helpers: the shared folder for intermediate tables, and their removal."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ready: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where driver and executors are one process, a temporary folder stands in for an absent setting; on a
    cluster its absence is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    if context.applicationId not in _ready:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="lexloom-")
        _ready[context.applicationId] = folder
    return _ready[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet below the shared folder and read again with its own schema; it stays there."""
    return _write(df, f"{shared_dir(df.sparkSession)}/lexloom-{name}-{uuid.uuid4().hex}")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run of an operator, below one folder of the shared one.

    ``keep`` writes a table (which also cuts its lineage, and survives lost executors), ``drop`` deletes tables nobody reads any more, and
    ``close`` all of them. What an operator returns must be ``stored`` or kept elsewhere before ``close``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        table = _write(df, path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.tables if any(t is x for x in tables)]:
            self._delete(path)
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in tables)]

    def close(self) -> None:
        self.tables.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.sweep()

    def sweep(self) -> None:
        """Lets Spark's cleaner find the shuffles of plans that are gone, here and in the JVM."""
        gc.collect()
        self.spark._jvm.java.lang.System.gc()
