"""Message folders as a Spark data source: spark.read.format("mail_folders") lists the files below a path, a folder a row of
files, and spark.readStream reads what is new, in the order of (time, key).

Tasks list the folders themselves, PREFIXES of them each; the driver lists only the names of the first level. A stream's
offset is a place in the order of modification time and key. Files show up late where a store is slow to list them, so that
a batch ends `lag` seconds before now: a file that shows up within that span after its time is read, and read once. Any
store that pyarrow.fs knows by URI will do.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from postloom.sources.tables import BATCH_BYTES

PREFIXES, LAG_S = 64, 5.0
NAMES = 4096  # of a batch
SCHEMA = "folder string, inner string, name string, size long, modified timestamp, path string"


class Prefixes(InputPartition):
    def __init__(self, names: list[str], after: tuple[int, str] | None = None, upto: tuple[int, str] | None = None):
        self.names, self.after, self.upto = names, after, upto


@functools.cache
def _store(uri: str):
    import pyarrow.fs as fs

    if ":" in uri.split("/")[0]:
        # Spark also writes file:/folder
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), os.path.abspath(uri)


def _folders(uri: str) -> list[str]:
    import pyarrow.fs as fs

    store, root = _store(uri)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)


def _files(uri: str, folder: str) -> Iterator[tuple[tuple[int, str], tuple]]:
    """The files of a folder with their places in the order of time and key."""
    import pyarrow.fs as fs

    store, root = _store(uri)
    base = f"{root.rstrip('/')}/{folder}"
    for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File:
            inner = f.path[len(base) + 1 :]
            yield (f.mtime_ns, f"{folder}/{inner}"), (folder, inner, f.base_name, f.size, datetime.fromtimestamp(f.mtime_ns / 1e9, UTC), f.path)


def _hidden(inner: str) -> bool:
    """Whether Spark's own readers leave a file out by a name on its way."""
    return any(n.startswith(".") or (n.startswith("_") and "=" not in n) or n.endswith("._COPYING_") for n in inner.split("/"))


def reachable(uri: str) -> bool:
    """Whether pyarrow.fs sees a folder under this URI."""
    import pyarrow.fs as fs

    try:
        store, root = _store(uri)
        return store.get_file_info(root).type == fs.FileType.Directory
    except Exception:  # noqa: BLE001  unknown stores, URIs and rights may fail in any way
        return False


def _entries(uri: str) -> Iterator[tuple[str, bool]]:
    """The names of the first level and whether each is a folder, without holding them all where the store is a local one."""
    import pyarrow.fs as fs

    store, root = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as found:
            yield from ((e.name, e.is_dir()) for e in found)
    else:
        yield from ((f.base_name, f.type == fs.FileType.Directory) for f in store.get_file_info(fs.FileSelector(root)))


def files(spark: SparkSession, uri: str) -> DataFrame:
    """Every file below a folder that is reachable(): path, folder, inner, name, size, modificationTime. A task gives the names
    of the first level, one after the other; they are dealt to tasks that list each folder, so that the driver holds none."""
    base = uri.rstrip("/")

    def first_level(batches):
        import pyarrow as pa

        for _ in batches:
            entries = _entries(uri)
            while held := list(itertools.islice(entries, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.string()), pa.array([d for _, d in held], pa.bool_())], ["name", "is_folder"])

    def below(batches):
        import pyarrow as pa

        shape = pa.schema([("path", pa.string()), ("folder", pa.string()), ("inner", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])

        def rows():
            store, root = _store(uri)
            for b in batches:
                for name, is_folder in zip(b["name"].to_pylist(), b["is_folder"].to_pylist(), strict=True):
                    if is_folder:
                        yield from ((f"{base}/{name}/{r[1]}", *r[:5]) for _, r in _files(uri, name) if not _hidden(f"{name}/{r[1]}"))
                    elif not _hidden(name):
                        f = store.get_file_info(f"{root.rstrip('/')}/{name}")
                        yield f"{base}/{name}", name, name, name, f.size, datetime.fromtimestamp(f.mtime_ns / 1e9, UTC)

        found = rows()
        while held := list(itertools.islice(found, NAMES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), shape.types, strict=True)], schema=shape)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = spark.range(0, 1, 1, 1).mapInArrow(first_level, "name string, is_folder boolean").repartition(tasks, "name")
    return names.mapInArrow(below, "path string, folder string, inner string, name string, size long, modificationTime timestamp")


def contents(uri: str):
    """A function of a path of files() that gives its bytes, read in tasks, some BATCH_BYTES at a time."""
    base = uri.rstrip("/")

    @F.pandas_udf("binary")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        store, root = _store(uri)
        for paths in batches:
            held: list[bytes] = []
            size = 0
            for path in paths:
                with store.open_input_file(root.rstrip("/") + path[len(base) :]) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return read


def _dealt(names: list[str], size: int, *span) -> list[Prefixes]:
    return [Prefixes(names[i : i + size], *span) for i in range(0, len(names), size)] or [Prefixes([])]


class _Reader:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.uri, self.size, self.lag = options["path"], int(options.get("prefixes", PREFIXES)), float(options.get("lag", LAG_S))

    def read(self, partition: Prefixes) -> Iterator[tuple]:
        for folder in partition.names:
            for place, row in _files(self.uri, folder):
                if (partition.after is None or place > partition.after) and (partition.upto is None or place <= partition.upto):
                    yield row


class FolderReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Prefixes]:
        return _dealt(_folders(self.uri), self.size)


class FolderStream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": 0, "key": ""}

    def latestOffset(self) -> dict:
        """Every file that is older than the lag: none of a later time has been read, so that none of this time is missed."""
        return {"time": time.time_ns() - int(self.lag * 1e9), "key": "\U0010ffff"}

    def partitions(self, start: dict, end: dict) -> list[Prefixes]:
        return _dealt(_folders(self.uri), self.size, (start["time"], start["key"]), (end["time"], end["key"]))

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing is held between batches


class FolderSource(DataSource):
    """Options: path; prefixes, how many folders a task lists; lag, in seconds, for streams."""

    @classmethod
    def name(cls) -> str:
        return "mail_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
