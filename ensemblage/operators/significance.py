"""Paired tests and bootstrap intervals as plans over all comparisons at once.

A comparison may have any number of pairs: ranks come from counts of distinct values,
the exact law of the signed-rank sum from an array that grows rank by rank, and a
bootstrap from draws that every row makes by itself, whose medians are found by counts of
the ranks drawn near the middle.  Python is used for Student's law alone, on one
row for each comparison."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finite
from . import scan
from .quantiles import same

#: Pairs up to which the law of the signed-rank sum is exact, if no two sizes tie.
EXACT_UP_TO = 50
#: Fixed values of the draws: a prime, and the factors of row, resample and seed.
PRIME, OF_ROW, OF_RESAMPLE, OF_SEED = 2147483647, 1664525013, 1013904243, 69069131
#: Distance from the middle, in roots of n, within which ranks drawn are counted one by one;
#: a resample's median has a deviation of half a root.
REACH = 4.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, dof: int) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    known = [x is not None and not math.isnan(x) and k >= 1 for x, k in zip(t, dof)]
    return pd.Series([t_p_value(x, int(k)) if ok and math.isfinite(x) else (0.0 if ok else None) for x, k, ok in zip(t, dof, known)], dtype="float64")


def paired_t_test(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, t_p): two-sided p-value of the paired t test over finite pairs.  Null
    below two pairs and where all differences are 0; 0 where all are equal and not 0."""
    ok = pairs.where(finite(F.col("base").cast("double")) & finite(F.col("value").cast("double")))
    d = F.col("base").cast("double") - F.col("value").cast("double")
    sums = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    error = F.col("_s") / F.sqrt(F.col("n").cast("double"))
    t = F.when(F.col("_s") > 0, F.col("_m") / error).when(F.col("_m") != 0, math.inf)
    return sums.withColumn("_t", F.when(F.col("n") >= 2, t)).select(*keys, "n", F.nanvl(_t_p_udf("_t", F.col("n") - 1), F.lit(None).cast("double")).alias("t_p"))


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0: a series of positive terms below 3,
    a continued fraction from its far end above."""
    square = x * x
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda s, k: F.struct((s["term"] * 2 * square / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * square / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda t, k: x + k / 2 / t)
    return F.when(x < 3, 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series).otherwise(F.exp(-square) / math.sqrt(math.pi) / fraction)


def signed_rank_ways(n: Column) -> Column:
    """For each sum of ranks 1..n, the number of subsets that have it."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    grow = lambda ways, k: F.zip_with(F.concat(ways, zeros(k)), F.concat(zeros(k), ways), lambda x, y: x + y)
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), grow)


def signed_rank_test(pairs: DataFrame, keys: list[str], exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """(keys, wilcoxon_n, w_plus, wilcoxon_p): two-sided signed-rank test of base - value
    over finite pairs, zeros dropped, tied sizes at their mean rank.  Exact without ties
    for few pairs, else the normal approximation with its correction for ties.  Null below
    two pairs and where all differences are 0."""
    ok = pairs.where(finite(F.col("base").cast("double")) & finite(F.col("value").cast("double")))
    d = F.col("base").cast("double") - F.col("value").cast("double")
    differences = ok.select(*keys, d.alias("_d"))
    known = differences.groupBy(*keys).agg(F.count("*").alias("_pairs"))
    # Sizes are counted first, so that a tie is one row and ranks need no row's order.
    sizes = differences.where("_d <> 0").groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count("*").alias("c"), F.count_if(F.col("_d") > 0).alias("plus"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    doubled = F.col("plus") * (2 * F.col("_before") + F.col("c") + 1)
    c = F.col("c").cast("double")
    ranks = sizes.withColumn("_before", before).groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(doubled).alias("_plus2"), F.sum(c * c * c - c).alias("_ties"), F.max("c").alias("_most"))
    n = F.col("n").cast("double")
    least2 = F.least(F.col("_plus2"), F.col("n") * (F.col("n") + 1) - F.col("_plus2"))
    ways = F.slice(signed_rank_ways(F.col("n")), 1, (least2 / 2).cast("int") + 1)
    exact = F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda t, w: t + w) / F.pow(F.lit(2.0), n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    normal = erfc(F.abs(least2 / 2 - n * (n + 1) / 4) / F.sqrt(2 * variance))
    p = F.when((F.col("n") <= exact_up_to) & (F.col("_most") == 1), exact).otherwise(normal)
    out = same(known, ranks, keys, "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("wilcoxon_n"), (F.col("_plus2") / 2).alias("w_plus"), F.when(F.col("_pairs") >= 2, p).alias("wilcoxon_p"))


def draw(row: Column, resample: Column, seed: int, n: Column) -> Column:
    """Which of n rows (from 0) a row (from 1) draws in a resample: a permutation
    polynomial of degree 25 modulo a prime, in longs that any engine can follow."""
    z = (row * F.lit(OF_ROW) + resample * F.lit(OF_RESAMPLE) + F.lit(seed * OF_SEED % PRIME)) % PRIME

    def fifth(x: Column) -> Column:
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    z = fifth((fifth(z) + resample) % PRIME) * n
    return F.rint((z - z % PRIME) / PRIME).cast("long")


def bootstrap_medians(values: DataFrame, keys: list[str], value: str, resamples: int = 2000, seed: int = 0, blocks: int | None = None, reach: float = REACH) -> DataFrame:
    """(keys, resample, median) of resamples with replacement, over finite values.

    Every row draws once in each resample, by a function of seed, resample and its rank,
    so the multiplicities of all rows are those of a bootstrap and the same whenever a
    task runs again.  A resample's median is one or two order statistics of the ranks
    drawn.  These stand near n/2, so in one pass draws are counted where they are made: by
    rank within ``reach`` sqrt(n) of the middle, in one number on either side.  Resamples
    whose median stands farther off are drawn again with eight times the reach."""
    rows = values.where(finite(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = scan.ranked(rows, keys, ["_v"], "_rank", blocks)
    rows = scan.kept(rows)
    size = rows.groupBy(*keys).agg(F.max("_rank").alias("_n"))
    session = rows.sparkSession
    # The rows are few for what is made of them, so that their number of tasks is set.
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    each = same(rows.select(*keys, "_rank"), size, keys).repartition(tasks, "_rank")
    asked = each.withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    group, found = [*keys, "resample"], []
    while True:
        drawn = asked.select(*group, "_n", draw(F.col("_rank"), F.col("resample"), seed, F.col("_n")).alias("_drawn"))
        far = F.lit(float(reach)) * F.sqrt(F.col("_n").cast("double")) + 1
        at = F.when(F.col("_drawn") < F.col("_n") / 2 - far, -1).when(F.col("_drawn") > F.col("_n") / 2 + far, F.col("_n")).otherwise(F.col("_drawn"))
        counts = drawn.groupBy(*group, "_n", at.alias("_at")).agg(F.count("*").alias("c"))
        upto = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        ends = counts.withColumn("_end", F.sum("c").over(upto)).withColumn("_inside", (F.col("_at") >= 0) & (F.col("_at") < F.col("_n")))
        # The places are (n - 1) // 2 and n // 2, from 0.
        place = lambda p: F.max(F.when(F.col("_inside") & (F.col("_end") - F.col("c") <= p) & (p < F.col("_end")), F.col("_at")))
        middle = scan.kept(ends.groupBy(*group).agg(place(F.floor((F.col("_n") - 1) / 2)).alias("_low"), place(F.floor(F.col("_n") / 2)).alias("_high")))
        found.append(middle.where("_low is not null and _high is not null"))
        missed = middle.where("_low is null or _high is null").select(*group)
        if missed.isEmpty():
            break
        asked, reach = same(each, missed, keys) if keys else each.crossJoin(missed), 8 * reach
    middle = reduce(DataFrame.unionByName, found).select(*group, F.explode(F.array("_low", "_high")).alias("_rank")).withColumn("_rank", F.col("_rank") + 1)
    return same(middle, rows, [*keys, "_rank"]).groupBy(*group).agg(F.avg("_v").alias("median"))


def bootstrap_interval(values: DataFrame, keys: list[str], value: str, resamples: int = 2000, seed: int = 0, level: float = 0.95, blocks: int | None = None) -> DataFrame:
    """(keys, low, high): the middle ``level`` of the medians of resamples."""
    ends = F.percentile("median", F.array(F.lit(0.5 * (1 - level)), F.lit(0.5 * (1 + level)))).alias("_q")
    medians = bootstrap_medians(values, keys, value, resamples, seed, blocks)
    return medians.groupBy(*keys).agg(ends).select(*keys, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def paired_tests(pairs: DataFrame, keys: list[str], resamples: int = 2000, seed: int = 0) -> DataFrame:
    """n, p-values of the paired t and signed-rank tests of base - value, and the
    bootstrap interval of the median percent gain, for each comparison."""
    both = same(paired_t_test(pairs, keys), signed_rank_test(pairs, keys).select(*keys, "wilcoxon_p"), keys)
    base, value = F.col("base").cast("double"), F.col("value").cast("double")
    gains = pairs.where(finite(base) & finite(value) & (base != 0)).select(*keys, (100 * (base - value) / base).alias("gain"))
    interval = bootstrap_interval(gains, keys, "gain", resamples, seed).withColumnsRenamed({"low": "gain_low", "high": "gain_high"})
    return same(both, interval, keys, "left")
