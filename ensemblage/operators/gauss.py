"""Fast Gauss transform: kernel sums at nodes from moments of boxes of particles.

With d = sqrt(2) width and v, u the distances of particle and node from a box's middle in
units of d, the kernel is exp(-(u-v)^2) = exp(-u^2) sum_n (2u)^n / n! * v^n exp(-v^2).  So
a box needs only its moments sum w v^n exp(-v^2), which are plain sums over particles, and
a node adds up the boxes near it: the work is that of particles plus nodes, not of their
product, and nothing of a particle is sent to a node.

Boxes have the side d/4, so |v| <= 1/8.  What the series leaves out after ``TERMS`` terms is
at most max_u exp(-u^2) (|u|/4)^TERMS / TERMS! < 1e-22 of a particle's weight, and less than
2e-9 of its true contribution even at |u| = ``REACH``; boxes beyond ``REACH`` would add less
than exp(-REACH^2) < 1e-31 of each weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import same

TERMS, REACH, SIDE = 16, 8.5, 0.25


def moments(particles: DataFrame, keys: list[str], x: str, weights: dict[str, Column], width: float) -> DataFrame:
    """(keys, box, a column of moments for each weight).  Null positions and weights
    add nothing."""
    d = math.sqrt(2) * width
    rows = particles.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), *[w.cast("double").alias(f"_w_{n}") for n, w in weights.items()])
    rows = rows.withColumn("_box", F.floor(F.col("_x") / (SIDE * d)).cast("long"))
    rows = rows.withColumn("_v", F.col("_x") / d - (F.col("_box") + 0.5) * SIDE).withColumn("_e", F.exp(-F.col("_v") * F.col("_v")))
    term = lambda n, k: F.coalesce(F.sum(F.col(f"_w_{n}") * F.col("_e") * (F.pow("_v", F.lit(float(k))) if k else F.lit(1.0))), F.lit(0.0))
    return rows.groupBy(*keys, "_box").agg(*[F.array(*[term(n, k) for k in range(TERMS)]).alias(n) for n in weights])


def sums_at(nodes: DataFrame, at: Column, found: DataFrame, keys: list[str], names: list[str], width: float) -> DataFrame:
    """The nodes with a column for each weight: its kernel sum at ``at``, without the
    kernel's norm.  Nodes and moments meet by (keys, box), keys may be null."""
    d = math.sqrt(2) * width
    reach = math.ceil(REACH / SIDE) + 1
    rows = nodes.select(F.struct("*").alias("_node"), *keys, at.cast("double").alias("_t")).withColumn("_id", F.struct(*[f"_node.`{c}`" for c in nodes.columns], "_t"))
    middle = F.floor(F.col("_t") / (SIDE * d)).cast("long")
    near = rows.select("_id", *keys, "_t").distinct().withColumn("_box", F.explode(F.sequence(middle - reach, middle + reach)))
    met = same(near, found, [*keys, "_box"])
    u = F.col("_t") / d - (F.col("_box") + 0.5) * SIDE

    def series(name: str) -> Column:
        total = F.get(name, F.lit(TERMS - 1))
        for n in range(TERMS - 2, -1, -1):
            total = total * (2 * F.col("_u") / (n + 1)) + F.get(name, F.lit(n))
        return F.exp(-F.col("_u") * F.col("_u")) * total

    near_sums = met.withColumn("_u", u).groupBy("_id").agg(*[F.sum(series(n)).alias(n) for n in names])
    return same(rows.select("_node", "_id"), near_sums, ["_id"], "left").select("_node.*", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
