"""Responses of outside services, landed as files, as a Python data source for batch and streaming reads.

Whoever may call a service lands its responses as text files of JSON lines, in a
folder a service: ``<path>/service=<name>/...``. A line has key (what was asked),
attempt (from 1), status, body (text) and error. The source plans partitions of
whole files by size, reads only the folders of the services that a filter names,
and turns lines that aren't such records into rows with an error, so nothing is
lost. As a stream it hands out files in the order in which they landed.

Files are reached through Arrow's file systems, so local folders and the stores
that Arrow knows (hdfs, s3, gs) work.

Defined cases: empty lines are skipped; a line that isn't a JSON object with a
key has null key and error "malformed", its text as body; missing members are
null; an empty folder gives no rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from trekframe.sources.shared import ship

SCHEMA = "service string, key string, attempt int, status int, body string, error string, file string"
_ARROW = pa.schema([("service", pa.string()), ("key", pa.string()), ("attempt", pa.int32()), ("status", pa.int32()), ("body", pa.string()), ("error", pa.string()), ("file", pa.string())])

#: Bytes of files in a partition, about; rows of a batch.
PART_BYTES, BATCH = 32 << 20, 5_000


def _files(path: str) -> list[tuple[int, str, int, str]]:
    """(time of landing, path, bytes, service) of the files below a path, oldest first."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        folders = f.path.split("/")
        if f.type == fs.FileType.File and not folders[-1].startswith(("_", ".")):
            service = next((x.split("=", 1)[1] for x in reversed(folders[:-1]) if x.startswith("service=")), "")
            out.append((f.mtime_ns, f.path, f.size, service))
    return sorted(out)


class _Files(InputPartition):
    def __init__(self, path: str, files: list[tuple[str, str]]):
        self.path, self.files = path, files


def _partitions(path: str, files: list[tuple[int, str, int, str]], part_bytes: int) -> list[_Files]:
    out, held, size = [], [], 0
    for _, name, n, service in files:
        if held and size + n > part_bytes:
            out.append(_Files(path, held))
            held, size = [], 0
        held.append((name, service))
        size += n
    return [*out, _Files(path, held)] if held else out


def record(line: str, service: str, file: str) -> tuple:
    try:
        x = json.loads(line)
    except ValueError:
        x = None
    if not isinstance(x, dict) or x.get("key") is None:
        return service, None, None, None, line, "malformed", file
    number = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return service, str(x["key"]), number(x.get("attempt")), number(x.get("status")), text(x.get("body")), text(x.get("error")), file


def _read(partition: _Files) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    path = partition.path
    where = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    held = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
    for name, service in partition.files:
        with where.open_input_stream(name) as raw:
            for line in io.BufferedReader(raw):
                text = line.decode("utf-8", "replace").strip()
                if text:
                    held.append(record(text, service, name))
                if len(held) == BATCH:
                    yield batch()
                    held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))
        self.services: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Takes equalities on the service, which choose folders; the rest is for Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("service",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.services = wanted if self.services is None else self.services & wanted
            else:
                yield f

    def partitions(self):
        files = [f for f in _files(self.path) if self.services is None or f[3] in self.services]
        return _partitions(self.path, files, self.part_bytes) or [_Files(self.path, [])]

    def read(self, partition):
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets name the last file by time of landing and path."""

    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))

    def initialOffset(self):
        return {"time": 0, "file": ""}

    def latestOffset(self):
        files = _files(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start, end):
        after, upto = (start["time"], start["file"]), (end["time"], end["file"])
        return _partitions(self.path, [f for f in _files(self.path) if after < f[:2] <= upto], self.part_bytes)

    def read(self, partition):
        return _read(partition)


class LandedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedResponses)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """service, key, attempt, status, body, error and file of all landed responses."""
    register(spark)
    return spark.read.format("landed_responses").option("path", path).load()


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of what lands."""
    register(spark)
    return spark.readStream.format("landed_responses").option("path", path).load()


def land(responses: DataFrame, path: str) -> None:
    """Writes responses (service and the members of a line) in the landing layout."""
    from pyspark.sql import functions as F

    members = [c for c in responses.columns if c not in ("service", "line")]
    line = F.col("line") if "line" in responses.columns else F.lit(None).cast("string")  # a raw line as it stands
    responses.select("service", F.coalesce(line, F.to_json(F.struct(*members))).alias("value")).write.partitionBy("service").mode("append").text(path)
