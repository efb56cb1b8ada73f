"""Access to the input tables and helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(named(col), F.lit(""))


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def picked(rows: int, n: int, *columns: str | Column) -> Column:
    """Whether a row is among about ``rows`` of ``n``, by a hash of ``columns``; 63 bits, so it picks some at any ``n``."""
    return F.lit(True) if n <= rows else F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit((rows << 63) // n)


#: Rows of one bigint column up to which a list of ids is sent to all executors (about 16 MB); beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` as the small side of a join: broadcast behind a check of its size, or a merge join beyond that."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(ids) if few else ids.hint("merge")


_held: dict[Any, Any] = {}


def worker_cache(name: Any, make: Callable[[], Any] = lambda: None) -> Any:
    """What a Python worker keeps from task to task: one thing at a time.

    Another name gives up what was held before, so workers that serve several operators in turn don't add up their caches.
    """
    if name not in _held:
        _held.clear()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: freed memory is then returned when it likes
            pass
        _held[name] = make()
    return _held[name]


#: Rows of an Arrow batch: with texts of some thousand bytes a batch stays at some MB on either side of the pipe.
BATCH_ROWS = 1_024


def arrow_map(rows: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows (a smaller setting of the session stays).

    Batches go by position: input columns whose names Spark would read as paths get plain names on the way in.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if any("." in c or "`" in c for c in rows.columns):
        rows = rows.toDF(*(f"_{i}" for i in range(len(rows.columns))))
    return rows.mapInArrow(run, schema)
