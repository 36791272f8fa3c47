"""Media manifest (object key, size, last modified) of an object tree.

The reference lists an object store by prefix, one page of at most 1,000 keys
per call. Here the listing is a data source of its own: the driver sees the
first-level prefixes (``trips/``, ``itineraries/``, ``banners/``, ...) alone, and
each prefix below is listed by an executor, which hands its keys on in Arrow batches.
No list of objects is held by the driver, and no file is opened.

Objects are reached through Arrow's file systems (``file``, ``s3``, ``gs``,
``hdfs`` URIs), with the credentials of the executors' environment."""

from __future__ import annotations

import re
import sys
from urllib.parse import urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "key string, size bigint, last_modified timestamp"
BATCH = 10_000  # keys in a batch


class Prefix(InputPartition):
    """A prefix to list: everything below it, or the objects in it alone."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _file_system(root: str):
    from pyarrow import fs
    if not urlparse(root).scheme:
        root = "file://" + root
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


class MediaReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        from pyarrow import fs
        system, path = _file_system(self.root)
        first = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [Prefix(path, False), *(Prefix(f.path, True) for f in sorted(first, key=lambda f: f.path)
                                       if f.type == fs.FileType.Directory)]

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import fs
        system, base = _file_system(self.root)
        todo, rows = [partition.path], []
        kind = pa.schema([("key", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC"))])

        def batch():
            out = pa.RecordBatch.from_pylist(rows, schema=kind)
            rows.clear()
            return out
        while todo:  # one folder at a time
            for f in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                if f.type == fs.FileType.Directory and partition.deep:
                    todo.append(f.path)
                elif f.type == fs.FileType.File:
                    rows.append({"key": f.path[len(base) + 1:], "size": f.size, "last_modified": f.mtime})
                if len(rows) >= BATCH:
                    yield batch()
        if rows:
            yield batch()


class MediaSource(DataSource):
    """``spark.read.format("caravan_media").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "caravan_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"])


def media_manifest(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(key, size, last_modified) for every object under ``root``; ``key`` is
    relative to ``root`` (e.g. ``trips/spiti_ab12.jpg``). ``glob`` keeps the keys
    whose last part fits (``*`` and ``?``). A root that is not there gives no rows."""
    spark.dataSource.register(MediaSource)
    found = spark.read.format("caravan_media").load(root)
    if glob:
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob)
        found = found.where(found["key"].rlike(f"(^|/){pattern}\\z"))
    return found
