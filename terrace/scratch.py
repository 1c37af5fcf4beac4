"""Tables written once to the folder that all executors share, to cut lineage and to reuse results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []  # for each open scope the folders made in it
#: With it Spark deletes a query's shuffle files as the query ends; else they stay until the driver happens to collect its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (as in tests) a temporary one, but only if executors run in the driver's process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="terrace-"))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/terrace/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return f"{path}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it survives lost executors and is computed once."""
    return write_to(df, new_path(df.sparkSession, name))


def write_to(df: DataFrame, path: str) -> DataFrame:
    """df, written and read again; what it shuffled is deleted when it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP, None)
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_SHUFFLE_CLEANUP) if before is None else conf.set(_SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are deleted at the end; what is to stay goes to a path made outside. Of use in one thread."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
