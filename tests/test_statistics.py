import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblage.operators import quantiles, scan, significance, tabular

ODD = [0.0, -0.0, 1.0, -1.0, 1e-320, -1e-320, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 8.0, 7.999999999999999, 8.000000000000002, 2.0**-1022, 2.0**1023]


def test_ordered_bits_keep_order_and_value(spark):
    rng = random.Random(1)
    values = ODD + [rng.uniform(-1, 1) * 10 ** rng.uniform(-320, 308) for _ in range(3000)] + [float(2**k) for k in range(-60, 61)] + [math.nextafter(2.0**k, 0) for k in range(-60, 61)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.ordered_bits(F.col("v")).alias("k"))
    rows = df.withColumn("back", quantiles.from_ordered_bits(F.col("k"))).collect()
    assert all(r.back == r.v for r in rows)
    rows.sort(key=lambda r: r.k)
    assert [r.v for r in rows] == sorted(values)


def test_ordered_bits_are_read_and_not_computed(spark):
    df = spark.createDataFrame([(v,) for v in [*ODD, None, math.nan, math.inf, -math.inf]], "v double")
    df = df.select("v", quantiles.ordered_bits(F.col("v")).alias("k"))
    # One call for each batch of values, and no logarithm or power for each value.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LOG2" not in plan.upper() and "POWER" not in plan.upper()
    for r in df.collect():
        if r.v is None or not math.isfinite(r.v):
            assert r.k is None
        else:
            assert r.k == (-1 if r.v < 0 else 1) * int(np.float64(abs(r.v)).view("int64"))


@pytest.mark.parametrize("few", [1, 3, 1 << 16])
def test_quantiles_of_many_groups_and_metrics(spark, few):
    rng = random.Random(2)
    rows = []
    for g in ["a", "b", None, "ties", "one", "missing"]:
        for _ in range({"one": 1, "missing": 3}.get(g, 400)):
            x = 7.5 if g == "ties" else rng.choice(ODD + [rng.gauss(0, 100) for _ in range(8)])
            rows.append((g, None if g == "missing" else x if abs(x) < 1e300 else math.inf, rng.choice([None, math.nan, rng.random()])))
    df = spark.createDataFrame(rows, "g string, x double, y double")
    shares = [0.0, 0.25, 0.5, 0.975, 1.0]
    got = {(r.g, r.metric): (r.n, r.quantiles) for r in quantiles.exact_quantiles(df, ["g"], ["x", "y"], shares, few).collect()}
    for g in {r[0] for r in rows}:
        for at, m in ((1, "x"), (2, "y")):
            ok = [r[at] for r in rows if r[0] == g and r[at] is not None and math.isfinite(r[at])]
            if not ok:
                assert (g, m) not in got
                continue
            n, q = got[g, m]
            assert n == len(ok)
            np.testing.assert_allclose(q, np.quantile(ok, shares), rtol=1e-12, atol=1e-300)
    assert quantiles.exact_quantiles(df.where("false"), ["g"], ["x"], shares).collect() == []
    (whole,) = quantiles.exact_quantiles(df, [], ["y"], [0.5]).collect()
    assert whole.quantiles[0] == pytest.approx(np.median([r[2] for r in rows if r[2] is not None and math.isfinite(r[2])]))


def test_summary_counts_missing_and_null_groups(spark):
    rows = [(None, 1.0), (None, math.nan), ("a", None), ("a", math.inf), ("b", 3.0), ("b", 5.0)]
    out = {r.g: r for r in tabular.config_summary(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"]).collect()}
    assert (out[None].n, out[None].v_median, out[None].v_missing) == (2, 1.0, 0.5)
    assert (out["a"].n, out["a"].v_median, out["a"].v_missing) == (2, None, 1.0)
    assert (out["b"].v_q25, out["b"].v_iqr) == (3.5, 1.0)


def brute_signed_rank(d):
    d = [x for x in d if x]
    size = sorted(abs(x) for x in d)
    rank = {s: np.mean([i + 1 for i, x in enumerate(size) if x == s]) for s in size}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    n = len(d)
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= 12 and len(set(size)) == n:
        sums = [sum(k for k, take in zip(range(1, n + 1), signs) if take) for signs in itertools.product([0, 1], repeat=n)]
        return min(1.0, 2 * sum(s <= least for s in sums) / 2**n)
    ties = sum(size.count(s) ** 3 - size.count(s) for s in set(size))
    return math.erfc(abs(least - n * (n + 1) / 4) / math.sqrt(2 * (n * (n + 1) * (2 * n + 1) / 24 - ties / 48)))


def test_signed_rank(spark):
    rng = random.Random(3)
    groups = {f"g{k}": [rng.gauss(0.3, 1) for _ in range(rng.choice([2, 5, 9, 12]))] for k in range(12)}
    groups |= {"ties": [1, -1, 2, 2, -3, 0, 0], "large": [rng.gauss(0.01, 1) for _ in range(300)], "far": [rng.gauss(3, 1) for _ in range(100)], "twenty": [float(x) for x in range(1, 21)]}
    rows = [(g, float(x), 0.0) for g, d in groups.items() for x in d] + [("zeros", 1.0, 1.0)] * 4 + [("single", 2.0, 1.0), ("nan", math.nan, 1.0), (None, 1.0, 0.0), (None, 3.0, 1.0)]
    got = {r.g: r for r in significance.signed_rank_test(spark.createDataFrame(rows, "g string, base double, value double"), ["g"]).collect()}
    for g, d in groups.items():
        want = 2 / 2**20 if g == "twenty" else brute_signed_rank(d)
        assert got[g].wilcoxon_p == pytest.approx(want, rel=1e-9), g
    assert got["zeros"].wilcoxon_p is None and got["single"].wilcoxon_p is None and "nan" not in got
    assert got[None].wilcoxon_p == 0.5


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.5, 1.0, 2.9, 2.999999, 3.0, 3.1, 5.0, 10.0, 26.0]
    got = [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(significance.erfc(F.col("x")).alias("e")).collect()]
    for x, e in zip(xs, got):
        assert e == pytest.approx(math.erfc(x), rel=1e-10)


def test_t_test(spark):
    rows = [("a", float(x), 0.0) for x in (1, 2, 3, 4)] + [("one", 1.0, 0.0)] + [("zero", 1.0, 1.0)] * 3 + [("same", 2.0, 1.0)] * 3
    got = {r.g: r.t_p for r in significance.paired_t_test(spark.createDataFrame(rows, "g string, base double, value double"), ["g"]).collect()}
    assert got["a"] == pytest.approx(0.030466291662, abs=1e-9)
    assert got["one"] is None and got["zero"] is None and got["same"] == 0.0
    assert significance.t_p_value(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)


def test_bootstrap_draws_like_a_bootstrap(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 101)
    rows = [("x", float(v)) for v in x] + [("one", 3.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    medians = significance.bootstrap_medians(df, ["g"], "v", 1000).collect()
    mine = np.array([r.median for r in medians if r.g == "x"])
    assert len(mine) == 1000
    theirs = np.median(x[rng.integers(0, 101, (4000, 101))], axis=1)
    assert abs(mine.std() / theirs.std() - 1) < 0.1 and abs(mine.mean() - theirs.mean()) < 0.02
    assert {r.median for r in medians if r.g == "one"} == {3.0}
    # Two rows: both, or one of them twice.
    pair = [r.median for r in medians if r.g is None]
    assert set(pair) == {1.0, 1.5, 2.0} and 420 < pair.count(1.5) < 580
    again = significance.bootstrap_interval(df, ["g"], "v", 1000, blocks=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, significance.bootstrap_interval(df.repartition(7), ["g"], "v", 1000).collect()))
    assert significance.bootstrap_interval(df.where("false"), ["g"], "v", 10).collect() == []


@pytest.mark.parametrize("reach", [0.01, 4.0])
def test_bootstrap_medians_are_those_of_all_draws(spark, reach):
    p, rng = significance.PRIME, random.Random(6)
    groups = {g: sorted(rng.gauss(0, 1) for _ in range(n)) for g, n in (("odd", 201), ("even", 60), (None, 3), ("one", 1))}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "g string, v double")
    # Medians beyond the reach are found as well.
    got = {(r.g, r.resample): r.median for r in significance.bootstrap_medians(df, ["g"], "v", 40, seed=5, reach=reach).collect()}
    draw = lambda k, r, n: pow((pow((k * significance.OF_ROW + r * significance.OF_RESAMPLE + 5 * significance.OF_SEED) % p, 5, p) + r) % p, 5, p) * n // p
    want = {(g, r): float(np.median([x[draw(k, r, len(x))] for k in range(1, len(x) + 1)])) for g, x in groups.items() for r in range(40)}
    assert got == want


def test_draws_are_spread(spark):
    n = 50
    df = spark.range(1, n + 1).withColumnRenamed("id", "i").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(1999)).cast("array<bigint>")))
    got = df.select("r", significance.draw(F.col("i"), F.col("r"), 7, F.lit(n)).alias("at")).groupBy("r", "at").count().collect()
    assert {r["at"] for r in got} == set(range(n))
    # Multiplicities are near Poisson's: mean 1 over all rows, variance 1 - 1/n.
    square = sum(r["count"] ** 2 for r in got) / (2000 * n)
    assert abs(square - (2 - 1 / n)) < 0.03


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(5)
    rows = [(g, k, rng.choice([None, rng.random()]) if g == "n" else rng.gauss(0, 1)) for g, size in (("long", 5000), ("short", 3), ("n", 40), (None, 500)) for k in range(size)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k int, v double").repartition(6)


@pytest.mark.parametrize("blocks", [1, 8])
def test_scans_of_runs_over_blocks(walk, blocks):
    rows, df = walk
    runs = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        runs.setdefault(g, []).append((k, v))
    sums = {(r.g, r.k): r for r in scan.ranked(scan.running_sums(df, ["g"], ["k"], {"s": F.col("v")}, blocks), ["g"], ["k"], "rank", blocks).collect()}
    before = {(r.g, r.k): r for r in scan.previous(df, ["g"], ["k"], {"p": "v", "pk": "k"}, blocks).collect()}
    for g, run in runs.items():
        total = 0.0
        for at, (k, v) in enumerate(run):
            total += v or 0.0
            assert sums[g, k].s == pytest.approx(total, abs=1e-9) and sums[g, k].rank == at + 1
            assert (before[g, k].pk, before[g, k].p) == ((run[at - 1][0], run[at - 1][1]) if at else (None, None))


@pytest.mark.parametrize("keep", [0.9, 0.5, 0.9999, 1e-6, 0.0])
def test_moving_averages_over_blocks(walk, keep):
    rows, df = walk
    df = df.where("v is not null")
    runs = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            runs.setdefault(g, []).append((k, v))
    series = {(r.g, r.k): r.ema for r in scan.decayed(df, ["g"], ["k"], "v", keep, 2.0, blocks=8).collect()}
    last = {r.g: r for r in scan.decayed_last(df, ["g"], ["k"], "v", keep, 2.0, "ema", blocks=8).collect()}
    first = {r.g: r for r in scan.decayed_last(df, ["g"], ["k"], "v", keep, None, "ema", blocks=8).collect()}
    for g, run in runs.items():
        t, f = 2.0, run[0][1]
        for k, v in run:
            t, f = keep * t + (1 - keep) * v, keep * f + (1 - keep) * v
            assert series[g, k] == pytest.approx(t, rel=1e-9, abs=1e-12)
        assert last[g].ema == pytest.approx(t, rel=1e-9) and first[g].ema == pytest.approx(f, rel=1e-9) and last[g].n == len(run)


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "g string, k int, v double")
    assert scan.running_sums(df, ["g"], ["k"], {"s": F.col("v")}).collect() == []
    assert scan.decayed(df, ["g"], ["k"], "v", 0.9).collect() == []
    assert tabular.ema(df, "g", ["k"], "v", 0.1).collect() == []
