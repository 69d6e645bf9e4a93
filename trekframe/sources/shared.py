"""Where jobs may write intermediate tables, and how this package reaches Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in this process, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trekframe-"))
        path = sc.getCheckpointDir()
    return path


def materialised(df):
    """df as a Parquet table in the shared folder: what is used several times is computed once, and lineage ends there."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what was written for a while only."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the application's Python workers, once, so that they need no shared installation."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="trekframe-code-")
        shutil.copytree(top, f"{folder}/code/{top.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", f"{folder}/code"))
