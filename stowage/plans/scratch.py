"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode, and an error on a cluster, whose executors share none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="stowage-")
        atexit.register(__import__("shutil").rmtree, _OWN["dir"], True)
    return f"file://{_OWN['dir']}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_home(spark)}/{uuid.uuid4().hex}/{label}"


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stowage-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialise`, if it is one."""
    path = getattr(df, "_scratch_path", None)
    if path is not None:
        _delete(df.sparkSession, path.rpartition("/")[0])


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application, once no result that reads them is needed any more."""
    _delete(spark, _home(spark))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, in any store that Spark reads, is a folder; an error if it does not exist."""
    store, p = _opened(spark, path)
    return store.getFileStatus(p).isDirectory()


def _opened(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _delete(spark: SparkSession, folder: str) -> None:
    store, p = _opened(spark, folder)
    store.delete(p, True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when it holds at most ``most_rows`` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
