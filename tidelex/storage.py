"""The shared folder, and tables written there to end a lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share. Where it is unset in local mode, a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        folder = _LOCAL[application] = _LOCAL.get(application) or tempfile.mkdtemp(prefix="tidelex-")
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end. What is made of them has to be written by then:
    a result that is still to be computed reads them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted at the end of the scope it is made in."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected the plan they belong to, which may be long after the
    table made of them was ``stored``. To be called between large steps, so that they don't all lie on disk at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
