"""Merging parts of which some may be damaged.

Writers leave parts in a folder, and a part may be cut short.  A job over all of them would
fail at the damaged one, or read half of it.  ``audited`` lists the parts and tries each by
itself, where an error stays with its part; ``merged`` reads the good parts, holds what was
read against what was listed, and gives the skipped parts beside the merged rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import kept
from ..operators.selection import keep_last

#: Bytes of a part up to which a task may hold it whole.
LARGE = 32 << 20


def _count_parquet(content: bytes) -> int:
    import pyarrow.parquet as pq

    # Every page is decoded, a row group at a time; a footer alone may be whole.
    return sum(batch.num_rows for batch in pq.ParquetFile(io.BytesIO(content)).iter_batches())


def _count_csv(content: bytes) -> int:
    rows = csv.reader(io.StringIO(content.decode("utf-8"), newline=""), strict=True)
    return _whole_rows(rows)


def _whole_rows(rows) -> int:
    """Rows below the header of a CSV reader, which must all be as wide."""
    width = len(next(rows, ()))
    if not width:
        raise ValueError("no header")
    n = 0
    for row in rows:
        if row and len(row) != width:
            raise ValueError(f"line {rows.line_num}: {len(row)} fields, not {width}")
        n += bool(row)
    return n


def _name(path: Column) -> Column:
    """A local path has one slash or three, as it comes from a store or a reader."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def listed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, bytes) of every part below ``path``, as the store lists them; a reader may
    pass over some of these, such as empty files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    found = []
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if name.endswith(f".{kind}") and name[0] not in "._":
            found.append((status.getPath().toString(), status.getLen()))
    return spark.createDataFrame(found, "path string, bytes long").withColumn("path", _name(F.col("path")))


_COUNT = {"parquet": _count_parquet, "csv": _count_csv}


def _count_lines(lines: Iterator[bytes]) -> int:
    """As ``_count_csv``, of a part that comes line by line."""
    return _whole_rows(csv.reader((line.decode("utf-8") + "\n" for line in lines), strict=True))


def _count_large(spark: SparkSession, path: str, kind: str) -> tuple[int | None, str | None]:
    """Rows of a part, or what is wrong with it, by a job of its own: Spark's reader goes
    over all columns of a Parquet part, cut over tasks; lines of a CSV part, of which a
    quote may take several, are one stream.  Nothing of the part is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            found = (_count_lines(bytes(v) for pdf in batches for v in pdf["value"]), None)
        except Exception as e:  # noqa: BLE001
            found = (None, f"{type(e).__name__}: {e}"[:500])
        yield pd.DataFrame([found], columns=["rows", "error"]).astype({"rows": "Int64"})

    try:
        if kind == "csv":
            lines = spark.read.option("ignoreCorruptFiles", False).text(path).select(F.col("value").cast("binary")).coalesce(1)
            return tuple(lines.mapInPandas(run, "rows long, error string").first())
        seen = Observation()
        part = spark.read.option("ignoreCorruptFiles", False).parquet(path).observe(seen, F.count(F.lit(1)).alias("rows"))
        part.write.format("noop").mode("overwrite").save()
        return seen.get["rows"], None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"[:500]


def audited(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(path, bytes, rows, error) of every part below ``path``: ``rows`` if it can be read
    to its end, else what is wrong with it.  What is tried is held against what the store
    lists, so that no part goes unnamed.  Parts are read where Spark puts them, one at
    a time in memory; one of more than ``LARGE`` bytes is a job of its own and never whole
    in memory.  An empty folder gives no rows."""
    count = _COUNT[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    found.append((file, len(content), count(content), None))
                except Exception as e:  # noqa: BLE001
                    found.append((file, len(content), None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(found, columns=["path", "bytes", "rows", "error"]).astype({"rows": "Int64"})

    every = kept(listed(spark, path, kind))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).load(path).where(F.col("length") <= LARGE)
    tried = files.select(_name(F.col("_metadata.file_path")).alias("path"), "content").mapInPandas(run, "path string, bytes long, rows long, error string").drop("bytes")
    large = [(r.path, *_count_large(spark, r.path, kind)) for r in every.where(F.col("bytes") > LARGE).collect()]
    if large:
        tried = tried.unionByName(spark.createDataFrame(large, "path string, rows long, error string"))
    both = every.join(tried, "path", "left")
    return both.withColumn("error", F.when(F.col("rows").isNull(), F.coalesce("error", F.lit("nothing to read"))))


def merged(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[Column], kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """The last row of each key by ``order`` over all good parts, and (path, bytes, error)
    of the parts that were skipped.

    ``schema`` is what rows should have; a part that lacks a column gives nulls.  The column
    ``part`` (a row's file) may be used in ``order``.  Of each good part as many rows must be
    read as were counted; a part that changed meanwhile is named among the skipped ones,
    and its rows are left out."""
    audit = kept(audited(spark, path, kind))
    good = audit.where("error is null").select(F.col("path").alias("part"), F.col("rows").alias("_listed"))
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").option("ignoreCorruptFiles", True)
    # A header may differ from file to file, so that columns go by name there.
    reader = reader.option("header", True).option("enforceSchema", False) if kind == "csv" else reader
    rows = reader.format(kind).load(path).withColumn("part", _name(F.col("_metadata.file_path")))
    rows = kept(rows.join(good.select("part"), "part", "left_semi"))
    read = rows.groupBy("part").agg(F.count("*").alias("_read"))
    changed = kept(good.join(read, "part", "left").where(F.coalesce("_read", F.lit(0)) != F.col("_listed")).select("part"))
    skipped = audit.where(F.col("error").isNotNull()).select("path", "bytes", "error")
    other = audit.join(changed, F.col("path") == F.col("part")).select("path", "bytes", F.lit("read and counted rows differ").alias("error"))
    return keep_last(rows.join(changed, "part", "left_anti"), keys, order), skipped.unionByName(other)


def merge_into(new: DataFrame, target: str, keys: list[str], order: list[Column], by: str) -> DataFrame:
    """Lay rows over a table that is partitioned by ``by``: the last row of each key by
    ``order`` stays.  Only partitions that new rows fall into are read and written again;
    gives these (by, rows).  A key must not move between partitions."""
    spark = new.sparkSession
    new = kept(new)
    touched = new.select(by).distinct()
    try:
        old = spark.read.parquet(target)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        whole = new
    else:
        whole = old.join(F.broadcast(touched), by, "left_semi").unionByName(new, allowMissingColumns=True)
    # Written aside first: what is replaced is also what is read.
    whole = kept(keep_last(whole, keys, order))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(target)
    return whole.groupBy(by).agg(F.count("*").alias("rows"))
