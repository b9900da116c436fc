"""Random choice in relational form: subsets, weighted draws, birth and death.

Randomness is a hash of seed and row id, so a task that runs again draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: str, *ids: str) -> Column:
    """A number in (0, 1) from the md5 of the seed and the ids: 52 bits."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *ids)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def random_subset(df: DataFrame, group: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group without replacement."""
    order = Window.partitionBy(*group).orderBy(uniform(seed, key), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def weighted_subset(df: DataFrame, group: list[str], key: str, weight: str, k: int, seed: str) -> DataFrame:
    """k rows of each group without replacement, by weight: the k least of
    -log(u) / w.  Rows without weight are never drawn."""
    order = Window.partitionBy(*group).orderBy(-F.log(uniform(seed, key)) / F.col(weight), key)
    return df.where(F.col(weight) > 0).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def weighted_draws(df: DataFrame, key: str, weight: str, draws: DataFrame, u: str, group: list[str]) -> DataFrame:
    """For every draw u in (0, 1) of a group, the row whose part of the group's total
    weight holds it: with replacement.  Draws and parts are merged in one sort, from
    the last end to the first, and each draw takes the part that came last before it:
    the time is that of the sort."""
    w = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(*group))
    parts = df.where(F.col(weight) > 0).select(*group, (F.sum(weight).over(w) / total).alias("_at"), F.col(key).alias("_row"), F.lit(None).cast(draws.schema["draw"].dataType).alias("draw"))
    asked = draws.select(*group, F.col(u).alias("_at"), F.lit(None).cast(df.schema[key].dataType).alias("_row"), "draw")
    back = Window.partitionBy(*group).orderBy(F.desc("_at"), F.desc_nulls_first("draw"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    both = parts.unionByName(asked).withColumn("_hit", F.last("_row", ignorenulls=True).over(back))
    return both.where("draw is not null").select(*group, "draw", F.col("_hit").alias(key))


def deaths(df: DataFrame, probability: Column, seed: str, key: str) -> DataFrame:
    return df.withColumn("dies", uniform(seed, key) < probability)


def refilled(df: DataFrame, group: list[str], key: str, dies: Column, cloned: Column, seed: str) -> DataFrame:
    """Who goes on after a resampling, as many in each group as before: survivors and
    clones, a random subset of them if there are too many, further draws among the
    survivors if there are too few.  (group, key of the source, ``how``: kept or drawn)"""
    marked = df.select(*group, key, dies.alias("_dies"), cloned.alias("_cloned"))
    copies = F.concat(F.when(F.col("_dies"), F.array().cast("array<int>")).otherwise(F.array(F.lit(0))), F.when(F.col("_cloned"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    pool = marked.withColumn("_copy", F.explode(copies))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(uniform(seed, key, "_copy"), key, "_copy"))
    size = marked.groupBy(*group).agg(F.count("*").alias("_n"), F.count_if(~F.col("_dies")).alias("_alive"), (F.count_if(~F.col("_dies")) + F.count_if("_cloned")).alias("_pool"))
    kept = pool.withColumn("_rank", rank).join(size, group).where("_rank <= _n").select(*group, key, F.lit("kept").alias("how"))
    # Empty places are few, and each looks up one survivor by its place among them.
    lacking = size.where("_pool < _n and _alive > 0").withColumn("_slot", F.explode(F.expr("sequence(1L, _n - _pool)")))
    lacking = lacking.withColumn("_at", F.floor(uniform(seed, *group, "_slot") * F.col("_alive")).cast("long"))
    place = (F.row_number().over(Window.partitionBy(*group).orderBy(key)) - 1).cast("long")
    alive = marked.where("not _dies").withColumn("_at", place).select(*group, "_at", key)
    return kept.union(lacking.join(alive, [*group, "_at"]).select(*group, key, F.lit("drawn").alias("how")))
