"""Choosing and reshaping: ranks, safety filters, merges of shards, pivots, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_target(configs: DataFrame, target: str, config: str, metrics: list[str], safe: Column | None = None) -> DataFrame:
    """Rank configurations in each target by metrics, then by id.

    Only safe ones compete where a target has any; where none is safe, all do.
    Adds ``passed``, ``rank`` (null outside the pool) and ``selected``."""
    df = configs.withColumn("passed", F.lit(True) if safe is None else F.coalesce(safe, F.lit(False)))
    pool = F.col("passed") | ~F.max("passed").over(Window.partitionBy(target))
    order = Window.partitionBy(target, "_pool").orderBy(*[F.col(m).asc_nulls_last() for m in metrics], config)
    df = df.withColumn("_pool", pool).withColumn("rank", F.when(F.col("_pool"), F.row_number().over(order)))
    return df.withColumn("selected", F.coalesce(F.col("rank") == 1, F.lit(False))).drop("_pool")


def top_k(df: DataFrame, metric: str, config: str, k: int = 20) -> DataFrame:
    """The k rows of least metric, ties by id, with ``rank`` from 1."""
    least = df.orderBy(F.col(metric).asc_nulls_last(), config).limit(k)
    # k rows: one task is enough to number them.
    return least.withColumn("rank", F.row_number().over(Window.orderBy(F.col(metric).asc_nulls_last(), config)))


def best_and_worst(medians: DataFrame, keys: list[str], config: str, metric: str) -> DataFrame:
    c = F.struct(metric, config)
    return medians.groupBy(*keys).agg(F.min_by(config, c).alias("best"), F.min(metric).alias("best_value"), F.max_by(config, c).alias("worst"), F.max(metric).alias("worst_value"))


def keep_last(parts: list[DataFrame] | DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last one by ``order``.  A list of parts is put together by
    column names; what a part lacks is null."""
    df = parts if isinstance(parts, DataFrame) else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exactly_one(df: DataFrame, **equal) -> DataFrame:
    """The row with these values; the query fails unless there is one and only one."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    picked = df.groupBy().agg(F.count("*").alias("_n"), F.first(F.struct("*")).alias("_row"))
    # The filter needs the check's value, so it is never pruned.
    return picked.where(F.assert_true(F.col("_n") == 1, F.concat(F.lit("rows found: "), F.col("_n").cast("string"))).isNull()).select("_row.*")


def heatmap(df: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """Least metric of each cell, with one column a value."""
    return df.groupBy(row).pivot(column, values).agg(F.min(metric))


def stack_seeds(df: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """Values by seed as an array, and the seeds in the same order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seed).alias("seed"), F.col(value).alias("value"))))
    return df.groupBy(*keys).agg(ordered.alias("_a")).select(*keys, F.col("_a.seed").alias("seeds"), F.col("_a.value").alias("values"))


def series_to_rows(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays of a run record as rows with their ``pos``."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_v")).select(*keys, "pos", "_v.*")


def rows_to_profile(df: DataFrame, keys: list[str], node: str, value: str) -> DataFrame:
    """Grid rows as one array a profile, ordered by node."""
    a = F.array_sort(F.collect_list(F.struct(F.col(node), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(a.alias("_a")).select(*keys, F.col("_a.v").alias(value))


def project_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])
