"""Tables written once to the folder that driver and executors share.

A plan whose result is read several times, or whose lineage should end, is
written as Parquet and read back.  Unlike cached blocks these files outlive
any executor, and unlike ``checkpoint()`` they are columnar and computed once.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
#: Paths that go when the innermost ``settled`` is done.
_passing: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, deleted when the driver ends, or with the ``settled`` that it is for."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    if (passing := _passing.get()) is not None:
        passing.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway may already be gone at exit
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; all that was stored for it meanwhile is deleted.

    So ``make`` must not hand out other tables that it wrote, nor plans that read them.
    """
    own: list[tuple[SparkSession, str]] = []
    outer = _passing.get()
    _passing.set(own)
    try:
        found = make()
        _passing.set(outer)  # the result is for whoever asked for it
        return written(found, name)
    finally:
        _passing.set(outer)
        for spark, path in own:
            _delete(spark, path)
