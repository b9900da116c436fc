"""``.npz`` files as a Spark data source, to read and to write.

Reading plans one partition for each file.  Parts of a file's name are columns (``pattern``
has named groups), and filters on them drop files while the read is planned; filters on
``member`` tell which arrays are decoded, and no other member of a file is unpacked.
Writing gives a file for each value of ``file``, whole or not at all.

Paths are opened by Arrow's file systems on the executors (local, HDFS, S3 and the like);
``sources.read_npz`` reads through Spark where these can't reach.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

MEMBER = [T.StructField("member", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("texts", T.ArrayType(T.StringType()))]


def _groups(pattern: str) -> list[str]:
    return sorted(re.compile(pattern).groupindex, key=re.compile(pattern).groupindex.get)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    local = path.startswith(("/", "file:"))
    return (pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if local else pafs.FileSystem.from_uri(path)


@dataclass
class _File(InputPartition):
    path: str
    size: int
    keys: tuple


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.names = path, re.compile(pattern), _groups(pattern)
        self.asked: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in (*self.names, "member"):
                self.asked[name] = self.asked[name] & values if name in self.asked else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, base = _open(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
            match = self.pattern.search(info.base_name) if info.is_file and info.extension == "npz" else None
            if match and all(match[n] in self.asked.get(n, {match[n]}) for n in self.names):
                found.append(_File(info.path, info.size, tuple(match[n] for n in self.names)))
        return sorted(found, key=lambda f: f.path)

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:  # no file was planned
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            for entry in sorted(archive.namelist()):
                member = entry.removesuffix(".npy")
                if "member" in self.asked and member not in self.asked["member"]:
                    continue
                a = np.load(io.BytesIO(archive.read(entry)), allow_pickle=False)
                text = a.dtype.kind in "US"
                values = None if text else [None if np.isnan(v) else float(v) for v in a.astype(float).ravel()]
                yield (partition.path, *partition.keys, member, list(a.shape), values, [str(x) for x in a.ravel()] if text else None)


@dataclass
class _Written(WriterCommitMessage):
    files: list  # (written, to be named)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        arrays: dict[str, dict[str, np.ndarray]] = {}
        for row in iterator:
            a = np.array(row.texts) if row.values is None and row.texts is not None else np.array([np.nan if v is None else v for v in row.values or []], float)
            arrays.setdefault(row.file, {})[row.member] = a.reshape(row.shape) if row.shape is not None else a
        files = []
        for name, members in arrays.items():
            content = io.BytesIO()
            np.savez_compressed(content, **members)
            beside = f"{base}/.{name}.{self.job}-{uuid.uuid4().hex}.part"
            with fs.open_output_stream(beside) as out:
                out.write(content.getvalue())
            files.append((beside, f"{base}/{name}"))
        return _Written(files)

    def commit(self, messages: list) -> None:
        """Files get their names when all tasks have written theirs."""
        fs, _ = _open(self.path)
        for message in messages:
            for beside, place in message.files if message else []:
                fs.move(beside, place)

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for message in messages:
            for beside, _ in message.files if message else []:
                fs.delete_file(beside)


class NpzSource(DataSource):
    """Options: ``pattern``, a regular expression whose named groups become columns of
    text.  Columns: path, these, member, shape, values (numbers, NaN as null) or texts.
    To write, rows have file, member, shape, values and texts, and all rows of a file are
    in one partition (``repartition("file")``)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        keys = [T.StructField(n, T.StringType()) for n in _groups(self.options.get("pattern", ""))]
        return T.StructType([T.StructField("path", T.StringType()), *keys, *MEMBER])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", ""))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``format("npz")`` known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzSource)
