"""Planning of runs: grids, batches, shards, resumption, status."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compact_number


def expand_grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values.  The product is made by exploding one
    row, so it is the size of the plan and nothing is joined."""
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def cross_with(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Rows of ``df`` (configurations) times the axes' values (methods, seeds)."""
    return reduce(lambda d, a: d.withColumn(a[0], F.explode(F.array(*map(F.lit, a[1])))), axes.items(), df)


def config_id(parts: list[str]) -> Column:
    """Readable id of a configuration: name=value pairs."""
    return F.concat_ws("_", *[F.concat(F.lit(p + "="), _text(p)) for p in parts])


def _text(name: str) -> Column:
    """Numbers without trailing zeros, other values as they are."""
    c = F.col(name)
    number = F.try_to_number(c.cast("string"), F.lit("S999999999D999999"))
    # Formatting turns a missing number into text, so it is asked for first.
    return F.coalesce(F.when(number.isNotNull(), compact_number(number)), c.cast("string"), F.lit("null"))


def config_hash(columns: list[str], digits: int = 12) -> Column:
    """md5 of the columns as JSON with sorted names."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(columns)))), 1, digits)


def remaining(specs: DataFrame, *done: DataFrame, key: str = "run_id") -> DataFrame:
    """Specs that no completed table lists."""
    completed = reduce(lambda a, b: a.union(b), [d.select(key) for d in done]).distinct()
    return specs.join(completed, key, "left_anti")


def chosen(specs: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Specs whose configuration an earlier stage has selected."""
    return specs.join(selected.select(key).distinct(), key, "left_semi")


def batches(specs: DataFrame, signature: list[str], order: list[str], size: int) -> DataFrame:
    """Chunks of ``size`` among specs of one signature: ``batch`` counts from 0."""
    n = F.row_number().over(Window.partitionBy(*signature).orderBy(*order)) - 1
    return specs.withColumn("batch", F.floor(n / size).cast("long"))


def stride_shards(specs: DataFrame, group: list[str], order: list[str], shards: int) -> DataFrame:
    """Deal specs of each group to shards in turn."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return specs.withColumn("shard", F.pmod(n, F.lit(shards)))


def greedy_shards(groups: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Largest group first to the least loaded shard (lowest number among equals).
    Groups are batches of a plan: a list that the driver made itself."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, shard = heapq.heappop(loads)
        out[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def merged_config(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, nested mappings key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overrides(arguments: list[str]) -> dict:
    """Nested mapping of ``a.b=value`` arguments; values are read as YAML, later ones
    win.  Lay it over a configuration by ``merged_config``."""
    import yaml

    out: dict = {}
    for argument in arguments:
        path, found, value = argument.partition("=")
        if not found or not path:
            raise ValueError(f"{argument}: name=value is needed")
        nested = yaml.safe_load(value)
        for name in reversed(path.split(".")):
            nested = {name: nested}
        out = merged_config(out, nested)
    return out


def gate(checks: DataFrame) -> DataFrame:
    """Pass the checks (name, ok) on, or fail the query naming those that did not."""
    bad = checks.agg(F.concat_ws(", ", F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"))
    return checks.crossJoin(F.broadcast(bad)).where(F.assert_true(F.col("failed") == "", F.concat(F.lit("failed: "), "failed")).isNull()).drop("failed")
