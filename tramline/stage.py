"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[int, str] = {}
_left: list[tuple[SparkSession, str]] = []


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder it lies in, whatever the working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = id(spark.sparkContext)
        if key not in _folders:
            _folders[key] = f"file://{tempfile.mkdtemp(prefix='tramline-')}"
        named = _folders[key]
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                dropped(spark, path)
        except Exception:  # the session has ended; its files stay for the folder's owner
            return
