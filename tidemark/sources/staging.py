"""Tables that several later steps read are written once.

A plan that uses a table in many places would compute it in each of them, and
planning itself would grow with every use.  A staged table is Parquet in the
folder that the session names in ``spark.checkpoint.dir`` (a temporary one
where that is unset and all of Spark is one process); a lost executor reads it
again.  Within ``scope()`` staged tables are deleted at its end, but for those
that are kept.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
    return _OWN[app]


def staged(table: DataFrame) -> DataFrame:
    """``table`` as written to the shared folder."""
    path = f"{folder(table.sparkSession)}/stage-{uuid.uuid4().hex}"
    table.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append((table.sparkSession, path))
    return table.sparkSession.read.schema(table.schema).parquet(path)


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scope():
    """Deletes the tables staged within; yields a function that stages one that stays."""
    _SCOPES.append([])

    def kept(table: DataFrame) -> DataFrame:
        mine = _SCOPES.pop()
        try:
            return staged(table)
        finally:
            _SCOPES.append(mine)

    try:
        yield kept
    finally:
        for spark, path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
