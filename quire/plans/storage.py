"""Intermediate tables in the folder that a cluster shares.

A table written here cuts the lineage of what is read back from it and survives the loss of
executors, since every executor sees the folder. The folder is the one named by
``spark.checkpoint.dir``; only where that setting is absent and driver and executors are one process
(tests, a laptop) is a temporary folder of this process used, which goes with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables; raises on a cluster that names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


_written: list[str] = []
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark reaches, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete_folder(spark, path)
        _written.remove(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that this process has written, for when no result that reads them is needed any more; their number."""
    n = len(_written)
    _remove(spark, list(_written))
    return n


def discard(table: DataFrame) -> None:
    """Removes one table that ``durable`` has returned, for when nothing that reads it is needed any more."""
    if (path := _places.get(table)) in _written:
        _remove(table.sparkSession, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes on leaving all tables that were written inside, but those that the given function was called with."""
    before, kept = set(_written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_places[table])
        return table

    yield keep
    _remove(spark, [p for p in _written if p not in before and p not in kept])


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there."""
    path = f"{shared_folder(df.sparkSession)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[table] = path
    return table
