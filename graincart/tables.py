"""Tables that are written once and read by several jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table of a few plain columns may have to be broadcast.
BROADCAST_ROWS = 200_000
_own_folders: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session, all of one process, may go without and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="graincart-")
    return _own_folders[app]


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once: its rows are written and read back, and a lost executor costs nothing of it. ``drop`` deletes them."""
    path = f"{shared_folder(df.sparkSession)}/graincart-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def path_of(table: DataFrame) -> str:
    """Where a table of ``written`` is; it is then not deleted by ``drop``."""
    return _paths.pop(table)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` once all that was read from them is done."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows, which are counted; else unchanged."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
