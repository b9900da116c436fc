"""Readers and writers of experiment files.

Paths are read by Spark, so any store that it reaches will do; contents that need
Python (YAML, npz) arrive as binary rows and are parsed where they are."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null
from ..operators.scan import interpolated


def read_config(spark: SparkSession, path: str) -> dict:
    """One YAML file (or JSON, which is YAML) as a mapping; anything else fails."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path}: a mapping is needed")
    return config


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; columns of numbers that are no numbers become null, as do
    NaN.  Only ``columns`` are parsed if given."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nanValue", "nan")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.select(*columns) if columns else df
    return nan_to_null(df)


def untyped_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strings as doubles, null where they are none."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def first_existing(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """The first of the paths (merged file, then shards) that is there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        found = jvm.org.apache.hadoop.fs.Path(path)
        matches = found.getFileSystem(conf).globStatus(found)
        if matches is not None and len(matches):
            return read_table(spark, path, schema)
    raise FileNotFoundError(", ".join(paths))


def is_directory(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    return status.isDirectory()


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str, pattern: str = "sweep_*", pointer: str = "LATEST") -> str:
    """The folder that the pointer file names, else the last one by name that fits the
    pattern; fails if there is neither."""
    place, fs = _hadoop(spark, f"{path}/{pointer}")
    if fs.exists(place):
        name = spark.read.text(f"{path}/{pointer}", wholetext=True).first().value.strip()
        return name if "/" in name else f"{path}/{name}"
    matches = fs.globStatus(_hadoop(spark, f"{path}/{pattern}")[0])
    if matches is None or not len(matches):
        raise FileNotFoundError(f"{path}/{pattern}")
    return max(m.getPath().toString() for m in matches)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """One small file that is there whole: written beside its place under a name of its
    own, then renamed over what was there.  A stop before the rename leaves the old file;
    the rename is one step where the store has such a step."""
    place, fs = _hadoop(spark, path)
    beside = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.part")[0]
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _rename_over(spark, beside, place)


def _rename_over(spark: SparkSession, beside, place) -> None:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, place, how)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of .npz files as rows (path, name, shape, values); flags that mark a
    missing value (``none__k``) become a null ``values`` under the name k."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in sorted(arrays.files):
                        a = arrays[name]
                        if name.startswith("none__"):
                            rows.append((file, name.removeprefix("none__"), [], None, None))
                        elif a.dtype.kind in "US":
                            rows.append((file, name, list(a.shape), None, [str(x) for x in a.ravel()]))
                        else:
                            rows.append((file, name, list(a.shape), a.astype(float).ravel().tolist(), None))
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "values", "texts"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, name string, shape array<int>, values array<double>, texts array<string>")


def read_wide_text(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers without a header: (file, line, pos, value)."""
    name = F.input_file_name().alias("file")
    lines = spark.read.text(path).select(name, F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("v")).where("v[0] <> ''")
    return lines.select("file", "line", F.posexplode("v").alias("pos", "value")).withColumn("value", F.col("value").try_cast("double"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``label : value``: (file, label, value)."""
    parts = F.split("value", r"\s*:\s*", 2)
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    return rows.select(F.input_file_name().alias("file"), F.trim(parts[0]).alias("label"), F.trim(parts[1]).alias("value"))


def read_manifest(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Runs of shard manifests, with the manifest's own fields.  A file is one
    manifest, or one a line."""
    return spark.read.option("multiLine", whole_files).json(path).select("*", F.explode("runs").alias("run")).drop("runs")


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    r"""Names and values of ``\newcommand{\name}{value}`` lines."""
    pattern = r"\\newcommand\{\\(\w+)\}\{(.*)\}\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("value"))


def append_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to a Parquet table; what is committed is whole, by batch."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def macro_lines(df: DataFrame, name: str, value: Column) -> DataFrame:
    r"""``\newcommand`` lines for named values, one column ``value``."""
    return df.select(F.concat(F.lit("\\newcommand{\\"), F.col(name), F.lit("}{"), value, F.lit("}")).alias("value"))


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat(F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns]), F.lit(r" \\")).alias("value"))


def scientific(c: Column, digits: int = 2) -> Column:
    """Mantissa and exponent, as in 1.25e-03."""
    e = F.floor(F.log10(F.abs(c)))
    return F.when(c == 0, "0").otherwise(F.concat(F.format_number(c / F.pow(F.lit(10.0), e), digits), F.lit("e"), e.cast("string")))


def to_records(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def cached_reference(spark: SparkSession, path: str, key: dict, build) -> DataFrame:
    """A reference table kept under its parameters; built again if they differ."""
    name = "-".join(f"{k}={json.dumps(v)}" for k, v in sorted(key.items())).replace('"', "").replace(" ", "")
    place = f"{path}/{name}"
    try:
        return spark.read.parquet(place)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("errorifexists").parquet(place)
    return spark.read.parquet(place)


def cross_check(built: DataFrame, reference: DataFrame, run: list[str], x: str, value: str, tolerance: float = 5e-2) -> DataFrame:
    """One row: nodes compared, largest deviation, and whether it is tolerable.

    The reference is interpolated at the nodes that were built, run by run; its own nodes
    may lie anywhere, and beyond its ends its end values count."""
    at = interpolated(built.select(*run, x, F.col(value).alias("_a"), F.lit(None).cast("double").alias(value)), reference, run, x, value)
    both = at.where(F.col(value).isNotNull() & F.col("_a").isNotNull())
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col(value))).alias("deviation")).withColumn("ok", (F.col("n") > 0) & (F.col("deviation") <= tolerance))


def required_reference(built: DataFrame, reference: DataFrame, run: list[str], x: str, value: str, tolerance: float = 5e-2) -> DataFrame:
    """``cross_check`` that fails the query where no node is there to compare; a
    deviation beyond the tolerance is reported (``ok``) and does not fail."""
    checked = cross_check(built, reference, run, x, value, tolerance)
    return checked.where(F.assert_true(F.col("n") > 0, F.lit("the reference has no node in common")).isNull())
