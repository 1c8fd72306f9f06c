"""Tables written to the shared checkpoint folder.

A staged table has no lineage to replay, survives the loss of executors, and its
file sizes let Spark choose broadcast or shuffle joins by what was really written.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_counter = itertools.count()

# Paths of the innermost scope of this thread; threads that run in a copied context share it.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it may be unset, one
    beside the session's tables. On a cluster such a folder would be the driver's own, so an
    unset one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, after a failure too, but for those of
    ``stage_result``. Scopes of different threads do not see each other."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage_result(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for a table that outlives the scope it is made in."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path under the checkpoint folder that no other run uses."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}/{next(_counter)}-{name}"


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path that is removed with the scope it is made in."""
    path = fresh_path(spark, name)
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    return path


def stage(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write a table as parquet and read it back."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
