"""Exact quantiles of many groups and metrics by distributed selection.

A value is mapped to a long that keeps its order (the bits of the double), and a histogram
over the highest bits of these is summed in every task before it moves.  Every quantile of
every group and metric asks for one or two order statistics; the histogram tells in which
bucket each lies and how many values stand before it there.  The next pass counts, in the
same way and for all of them at once, the next bits of the values in those buckets alone.
As soon as no bucket asked for holds more than ``FEW`` values, the last pass counts whole
values.  So two to four passes find every quantile, and no task sees more of a group than
a histogram: no group is gathered or sorted, however large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import kept

#: Values in a bucket that the last pass may count one by one.
FEW = 1 << 16
#: Bits below the digits of each pass.
SHIFTS = (48, 32, 16, 0)
#: Buckets asked for that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_TWO52 = 1 << 52


@F.pandas_udf(T.LongType())
def ordered_bits(c: pd.Series) -> pd.Series:
    """A long for each finite double, in the same order: the bits of its magnitude with
    its sign.  Both zeros are 0; what is not finite is null.  Bits are read as they stand
    in Arrow's memory, which costs less than logarithms and powers."""
    v = c.to_numpy(dtype="float64", na_value=np.nan)
    bits = np.abs(v).view("int64")
    return pd.Series(pd.arrays.IntegerArray(np.where(v < 0, -bits, bits), ~np.isfinite(v)))


def from_ordered_bits(k: Column) -> Column:
    """The double that ``ordered_bits`` was made of."""
    m = F.abs(k)
    fraction = m.bitwiseAND(F.lit(_TWO52 - 1)).cast("double") / float(_TWO52)
    normal = (fraction + 1) * F.pow(F.lit(2.0), (F.shiftright(m, 52) - 1023).cast("double"))
    a = F.when(m < _TWO52, m.cast("double") * 2.0**-537 * 2.0**-537).otherwise(normal)
    return F.when(k < 0, -a).otherwise(a)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the keys come from the left side."""
    both = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(both, on, how).drop(*[f"_right_{k}" for k in keys]) if keys else left.crossJoin(F.broadcast(both))


def _asked(total: Column, shares: list[float]) -> Column:
    """Places of the order statistics on both sides of each quantile."""
    at = [F.lit(float(q)) * (total - 1) for q in shares]
    return F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))


def order_statistics(df: DataFrame, keys: list[str], metrics: list[str], shares: list[float], few: int = FEW) -> DataFrame:
    """(keys, metric, total, place, value): for each group and metric with a finite value,
    those that the quantiles ``shares`` lie between; ``place`` counts from 0."""
    bits = df.select(*keys, *[ordered_bits(F.col(m).cast("double")).alias(f"_k{i}") for i, m in enumerate(metrics)])
    unpivot = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_k{i}").alias("k")) for i, m in enumerate(metrics)])).alias("_m")
    values = bits.select(*keys, unpivot).select(*keys, "_m.metric", "_m.k").where("k is not null")
    group = [*keys, "metric"]
    asked: DataFrame | None = None
    shift, before = SHIFTS[0], None
    while True:
        if asked is None:
            rows, place = values, group
        else:
            buckets = asked.select(*group, "bucket").distinct()
            side = F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets
            rows = same(values.withColumn("bucket", F.shiftright("k", before)), side, [*group, "bucket"])
            place = [*group, "bucket"]
        counts = rows.groupBy(*place, F.shiftright("k", shift).alias("next")).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*place)
        running = counts.withColumn("_end", F.sum("n").over(w.orderBy("next").rowsBetween(Window.unboundedPreceding, 0)))
        if asked is None:
            running = running.withColumn("total", F.sum("n").over(w))
            wanted = running.withColumn("asks", F.transform(_asked(F.col("total"), shares), lambda i: F.struct(i.alias("place"), i.alias("rest"))))
        else:
            asks = asked.groupBy(*place, "total").agg(F.collect_list(F.struct("place", "rest")).alias("asks"))
            wanted = same(running, asks, place)
        start = F.col("_end") - F.col("n")
        inside = F.filter("asks", lambda a: (a["rest"] >= start) & (a["rest"] < F.col("_end")))
        found = wanted.select(*group, "total", "n", F.col("next").alias("bucket"), start.alias("_start"), F.explode(inside).alias("_a"))
        found = found.select(*group, "total", "n", "bucket", F.col("_a.place").alias("place"), (F.col("_a.rest") - F.col("_start")).alias("rest"))
        if shift == 0:
            return found.select(*group, "total", "place", from_ordered_bits(F.col("bucket")).alias("value"))
        asked = kept(found)
        most = asked.agg(F.max("n")).first()[0]
        before = shift
        shift = 0 if most is None or most <= few else next(s for s in SHIFTS if s < shift)


def exact_quantiles(df: DataFrame, keys: list[str], metrics: list[str], shares: list[float], few: int = FEW) -> DataFrame:
    """(keys, metric, n, quantiles): linear interpolation between neighbours in order,
    over finite values.  Null keys are groups; a group without a finite value of a metric
    has no row for it; an empty table gives no rows."""
    stats = order_statistics(df, keys, metrics, shares, few)
    by = stats.groupBy(*keys, "metric").agg(F.first("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_at"))

    def quantile(q: float) -> Column:
        h = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.element_at("_at", F.floor(h).cast("long")), F.element_at("_at", F.ceil(h).cast("long"))
        return low + (high - low) * (h - F.floor(h))

    return by.select(*keys, "metric", "n", F.array(*[quantile(q) for q in shares]).alias("quantiles"))
