"""Lineage cutting through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


class BoundExceeded(RuntimeError):
    """A table that must be small (a configuration table, say) is larger than its documented bound."""


#: Paths given out since the last clean-up.
_written: list[str] = []
#: Folders of local sessions, by application; deleted when the process ends.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests), whose one process is all there is, may leave it unset and gets a folder of its own. On a cluster the
    folder has to be one that all executors share, so that raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        folder = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[app] = "file://" + folder
    return _local[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/sightline/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote to the shared folder; to be called when the results of its queries are stored. Returns their number."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it again.

    The result survives the loss of any executor, takes a fraction of the space of serialized rows, and can be
    read several times without computing its input again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int = 20_000, what: str = "table") -> list[Row]:
    """Rows of a configuration-sized table on the driver; raises BoundExceeded rather than collecting more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise BoundExceeded(f"{what} has more than {limit} rows")
    return rows
