"""A Python data source for small files chosen by a name rule, also those that Spark's file sources hide (``_SUCCESS_...``).

Reading lists a folder on the executors: every partition lists it, keeps the names of its own share (by hash) that match the rule, and reads
their bodies, so neither names nor bodies pass through the driver. Writing puts each row in a file of its own, under its final name only when it is
complete: a repeated task writes the same file again. Folders are local (shared) paths, or URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Executors get this module with the source: they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "named_files"
SCHEMA = "path string, name string, length long, modified timestamp, body string"
#: Rows of an Arrow batch, and partitions of a listing.
BATCH, SHARDS = 1_000, 8


def _open(path: str):
    """pyarrow file system and path in it."""
    from pyarrow import fs

    if re.match(r"file:/", path):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.rstrip("/"))
    return fs.LocalFileSystem(), path.rstrip("/")


@dataclass
class Share(InputPartition):
    number: int
    of: int


class NamedFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rule = re.compile(options.get("pattern", ""))
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.bodies = options.get("bodies", "true").lower() == "true"
        self.shards = max(1, int(options.get("shards", SHARDS)))

    def partitions(self):
        return [Share(i, self.shards) for i in range(self.shards)]

    def _files(self, share: Share):
        from pyarrow import fs

        system, base = _open(self.path)
        for f in system.get_file_info(fs.FileSelector(base, recursive=self.recursive)):
            name = f.path[len(base):].lstrip("/")
            if f.type == fs.FileType.File and zlib.crc32(name.encode("utf-8", "surrogateescape")) % share.of == share.number and self.rule.search(name):
                body = None
                if self.bodies:
                    with system.open_input_stream(f.path) as s:
                        body = s.read().decode("utf-8", "replace")
                yield f.path, name, f.size, f.mtime, body

    def read(self, partition):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
        names, rows = ["path", "name", "length", "modified", "body"], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for row in self._files(partition):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class NamedFilesWriter(DataSourceWriter):
    """Rows (name, body) as files of the folder; files of other names stay."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator):
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        for row in iterator:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"not a file name: {row['name']!r}")
            part = f"{base}/.{row['name']}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as s:
                s.write((row["body"] or "").encode())
            system.move(part, f"{base}/{row['name']}")
        return WriterCommitMessage()


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NamedFilesReader(dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("named_files only adds files: use mode('append')")
        return NamedFilesWriter(dict(self.options))


def read_named(spark: SparkSession, path: str, pattern: str = "", recursive: bool = False, bodies: bool = True, shards: int = SHARDS) -> DataFrame:
    """path, name (relative to the folder), length, modified and body of the files whose name has a match of ``pattern``."""
    spark.dataSource.register(NamedFiles)
    r = spark.read.format(FORMAT).option("pattern", pattern).option("recursive", str(recursive).lower()).option("bodies", str(bodies).lower())
    return r.option("shards", str(shards)).load(path)


def write_named(files: DataFrame, path: str) -> None:
    """Each row (name, body) of ``files`` as a file of the folder."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "body").write.format(FORMAT).mode("append").save(path)
