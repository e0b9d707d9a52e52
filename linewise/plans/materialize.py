"""Lineage cuts and who owns them.

Each two-level scan reads its input twice (local window and chunk summary), so a chain
of scans grows the plan tree geometrically. Between scans we therefore write the
intermediate table as Parquet under the cluster's shared ``spark.checkpoint.dir`` and
continue from the files: plans stay small, recomputation after a lost executor stops
at the last written table, and later steps get column pruning and predicate pushdown.

All tables of an application lie in one folder, which is removed when the application
ends or by ``release``. ``with owned(spark):`` gives the work inside a folder of its own
that goes at the end of the block; results must be written or collected inside it.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from linewise.session import checkpoint_dir

_OPEN: list[str] = []
_BASES: dict[str, str] = {}


def application_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _BASES:
        _BASES[app] = f"{checkpoint_dir(spark).rstrip('/')}/linewise/{app}"
        atexit.register(_quietly_release, spark)
    return _BASES[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate data, owned by the current block or the application."""
    base = application_folder(spark)
    return f"{_OPEN[-1] if _OPEN else base}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of the application; DataFrames over them end."""
    path = _BASES.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


def _quietly_release(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended by now
        if spark.sparkContext._jsc is not None:
            release(spark)


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[str]:
    path = new_folder(spark, "run")
    _OPEN.append(path)
    try:
        yield path
    finally:
        _OPEN.remove(path)
        _delete(spark, path)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get("linewise.cut.enabled", "true") == "false":
        return df
    path = new_folder(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
