"""Files that are read as streams in the workers: archives and members of any size, a megabyte at a time.

Spark lists the files; a worker opens a path itself, through Arrow's file systems (local and shared folders, HDFS,
object stores), as a whole file in one row would have to fit twice in memory and can't be over 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes read at once.
BUFFER = 1 << 20


def listed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of the files at or below a path; their content isn't read. Each is a task of its own later on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)
    return files.select("path", "length")


def opened(path: str) -> BinaryIO:
    """A file that can be read and sought in, by the path that Spark lists it with."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def read_each(files: DataFrame, fn: Callable[[str], Iterator[tuple]], schema: str, rows: int = 10_000) -> DataFrame:
    """Rows of ``schema`` that ``fn`` gives for each path, passed on ``rows`` at a time while the file is being read."""
    shape = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), shape.types, strict=True)], names=shape.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                out: list[tuple] = []
                for made in fn(path):
                    out.append(made)
                    if len(out) >= rows:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    return files.select("path").repartition("path").mapInArrow(run, schema)


def digest(stream: BinaryIO, keep: bool = False) -> tuple[int, str, bytes]:
    """(bytes read, sha256, what was read if it is to be kept) of a stream, to its end."""
    hashed, size, kept = hashlib.sha256(), 0, []
    while part := stream.read(BUFFER):
        hashed.update(part)
        size += len(part)
        if keep:
            kept.append(part)
    return size, hashed.hexdigest(), b"".join(kept)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files at or below a path."""

    def one(name: str) -> Iterator[tuple]:
        with opened(name) as f:
            size, sha, _ = digest(f)
        yield name, size, sha

    return read_each(listed(spark, path), one, "path string, bytes long, sha256 string").select(F.substring_index("path", "/", -1).alias("path"), "bytes", "sha256")
