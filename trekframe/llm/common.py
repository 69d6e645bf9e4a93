"""Helpers shared by the corpus operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regular expression of the white space that separates words.
WS = r"[\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` for fn that sees at most batch_rows rows at once. What Spark sends at once is the session's affair, 64 MB by default; ``small_batches`` lowers it."""
    ship(df.sparkSession)

    def run(batches):
        def slices():
            for batch in batches:
                if batch.num_rows <= batch_rows:
                    yield batch
                    continue
                for at in range(0, batch.num_rows, batch_rows):
                    # Copied, not sliced: some of Arrow's functions (ascii_lower) read arrays with an offset wrongly.
                    rows = pa.array(range(at, min(at + batch_rows, batch.num_rows)))
                    yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns], schema=batch.schema)

        yield from fn(slices())

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches stay small inside, also when texts are long; the session's settings are as before afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_KEPT: dict = {}


def kept(key, make: Callable):
    """make(), kept in this process for its later tasks; what another operator's tasks have kept goes, so a worker that serves several holds one at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in this process, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trekframe-"))
        path = sc.getCheckpointDir()
    return path


_TABLES: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that isn't needed any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Removes at its end the tables that ``written`` made inside: for callers that have stored their result by then."""
    start = len(_TABLES)
    try:
        yield
    finally:
        for path in _TABLES[start:]:
            remove(spark, path)
        del _TABLES[start:]


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation of what came before."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once a row, also where fn uses it inside lambdas."""
    return F.transform(F.array(value), fn)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
