import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblage import sources
from ensemblage.operators import gauss, grid, intervals, sampling, scan


def test_gauss_transform_is_the_sum_over_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.gauss(0, 30), rng.random()) for _ in range(400)] + [("a", None, 1.0), ("a", 0.0, None), ("b", 1e6, 1.0)]
    nodes = [(g, float(t)) for g in ("a", None, "b", "none") for t in (-200, -3.3, 0, 0, 12.5, 80, 1e6)]
    df, at = spark.createDataFrame(rows, "g string, x double, w double"), spark.createDataFrame(nodes, "g string, t double")
    for width in (0.5, 7.0, 100.0):
        found = gauss.moments(df, ["g"], "x", {"one": F.lit(1.0), "w": F.col("w")}, width)
        got = gauss.sums_at(at, F.col("t"), found, ["g"], ["one", "w"], width).collect()
        assert len(got) == len(nodes)
        for r in got:
            k = [(math.exp(-0.5 * ((r.t - x) / width) ** 2), w) for g, x, w in rows if g == r.g and x is not None]
            assert r.one == pytest.approx(sum(e for e, _ in k), rel=1e-9, abs=1e-25)
            assert r.w == pytest.approx(sum(e * w for e, w in k if w is not None), rel=1e-9, abs=1e-25)


def test_gauss_plans_make_no_pairs(spark):
    p = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.lit(1.0).alias("v"))
    plan = grid.kernel_regression(p, grid.grid(spark, 0, 100, 11), "x", "v", 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert grid.kernel_density(p.where("false"), grid.grid(spark, 0, 100, 11), "x", 3.0, 0.0, 100.0).collect() == []


@pytest.mark.parametrize("closed", [(True, True), (True, False), (False, True), (False, False)])
def test_interval_join_of_mixed_widths(spark, closed):
    rng = random.Random(2)
    points = [(k, rng.choice([None, math.nan, 0.0, 8.0, -8.0, rng.uniform(-100, 100), rng.uniform(-1e9, 1e9)]), rng.choice(["a", None])) for k in range(300)]
    spans = []
    for k in range(200):
        low = rng.choice([0.0, 8.0, -8.0, rng.uniform(-100, 100), rng.uniform(-1e9, 1e9)])
        spans.append((k, low, low + rng.choice([0.0, 1e-12, 1.0, 16.0, rng.expovariate(0.1), 1e8]), rng.choice(["a", None])))
    spans += [(900, 5.0, 1.0, "a"), (901, None, 3.0, "a"), (902, -math.inf, 3.0, "a"), (903, 0.0, math.nan, "a"), (904, -8.0, 8.0, "a")]
    p = spark.createDataFrame(points, "p int, x double, g string")
    s = spark.createDataFrame(spans, "s int, low double, high double, g string")
    met = intervals.within(p, F.col("x"), s, F.col("low"), F.col("high"), ["g"], closed)
    assert met.columns == ["p", "x", "g", "s", "low", "high"]
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    ok = lambda x, low, high: (x > low or (closed[0] and x == low)) and (x < high or (closed[1] and x == high))
    want = {(i, k) for i, x, g in points if x is not None for k, low, high, h in spans if None not in (low, high) and math.isfinite(low) and math.isfinite(high) and low <= high and g == h and ok(x, low, high)}
    got = [(r.p, r.s) for r in met.collect()]
    assert set(got) == want and len(got) == len(want) > 500
    assert intervals.within(p, F.col("x"), s.where("false"), F.col("low"), F.col("high"), ["g"], closed).collect() == []


@pytest.mark.parametrize("most", [2, intervals.BROADCAST_ROWS])
def test_few_intervals_go_to_the_points(spark, monkeypatch, most):
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", most)
    p = spark.range(1000).select("id", (F.col("id") % 50).cast("double").alias("x")).repartition(3)
    bins = spark.createDataFrame([(float(c), 5.0) for c in (5, 15, 60)], "center double, half double")
    met = intervals.within(p, F.col("x"), bins, F.col("center") - F.col("half"), F.col("center") + F.col("half"))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint=(strategy=broadcast)" in plan) == (most > 2)
    assert {r.center: r["count"] for r in met.groupBy("center").count().collect()} == {5.0: 220, 15.0: 220}


@pytest.mark.parametrize("closed", [(True, True), (True, False), (False, True), (False, False)])
def test_counts_of_intervals_are_those_of_their_join(spark, closed):
    rng = random.Random(5)
    points = [(k, rng.choice([None, math.nan, math.inf, 0.0, -0.0, 8.0, -8.0, rng.uniform(-100, 100), float(rng.randrange(20))])) for k in range(400)]
    spans = []
    for k in range(150):
        low = rng.choice([0.0, -0.0, 8.0, -8.0, rng.uniform(-100, 100), float(rng.randrange(20))])
        spans.append((k, low, low + rng.choice([0.0, 1.0, 8.0, 16.0, rng.expovariate(0.1), 1e8])))
    spans += [(900, 5.0, 1.0), (901, None, 3.0), (902, -math.inf, 3.0), (903, 0.0, math.nan), (904, -8.0, 8.0), (904, -8.0, 8.0)]
    p, s = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, low double, high double")
    got = intervals.counted(p, F.col("x"), s, F.col("low"), F.col("high"), closed, blocks=5)
    assert got.columns == ["s", "low", "high", "n", "least"]
    met = intervals.within(p, F.col("x"), s.dropDuplicates(), F.col("low"), F.col("high"), closed=closed)
    want = {r.s: (r.n, r.least) for r in met.groupBy("s").agg(F.count("*").alias("n"), F.min("x").alias("least")).collect()}
    rows = got.collect()
    assert {r.s: (r.n, r.least) for r in rows} == want and len(rows) == len(want) + 1
    assert intervals.counted(p.where("false"), F.col("x"), s, F.col("low"), F.col("high"), closed).collect() == []


@pytest.mark.parametrize("outside", [None, -1.0])
@pytest.mark.parametrize("blocks", [1, 8])
def test_interpolation_between_uneven_nodes(spark, outside, blocks):
    rng = random.Random(3)
    nodes = {g: sorted((float(x), rng.random()) for x in rng.sample(range(1000), n)) for g, n in (("a", 40), ("b", 1), (None, 7))}
    points = [(rng.choice(["a", "b", None, "none"]), rng.choice([None, -5.0, 1005.0, rng.uniform(0, 1000), *[x for x, _ in nodes["a"][:3]]]), k) for k in range(400)]
    n = spark.createDataFrame([(g, x, y) for g, xy in nodes.items() for x, y in xy] + [("a", None, 1.0), ("a", 3.5, None)], "g string, x double, y double")
    p = spark.createDataFrame(points, "g string, x double, y int")
    got = scan.interpolated(p.withColumnRenamed("y", "k"), n, ["g"], "x", "y", outside, blocks).collect()
    assert len(got) == len(points)
    for r in got:
        xy = nodes.get(r.g)
        if xy is None or r.x is None:
            assert r.y is None
            continue
        xs, ys = zip(*xy)
        inside = xs[0] <= r.x <= xs[-1]
        assert r.y == pytest.approx(np.interp(r.x, xs, ys) if inside or outside is None else outside, abs=1e-12)


def test_carried_values_over_blocks(spark):
    rng = random.Random(4)
    rows = [("r", k, rng.choice([None, None, None, None, rng.random()])) for k in range(500)] + [("none", k, None) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    got = {(r.g, r.k): r.v for r in scan.carried(df, ["g"], ["k"], ["v"], 8).collect()}
    last = None
    for g, k, v in rows[:500]:
        last = v if v is not None else last
        assert got[g, k] == last
    assert all(got["none", k] is None for k in range(9))


def test_weighted_draws_of_a_large_group(spark):
    n = 300_000
    parts = spark.range(n).select(F.lit("g").alias("g"), "id", (F.col("id") % 5).cast("long").alias("w"))
    draws = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("draw"), sampling.uniform("s", "id").alias("u"))
    got = sampling.weighted_draws(parts, "id", "w", draws, "u", ["g"]).join(draws, "draw").select("id", "u").collect()
    ends, total = [], 0
    for k in range(n):
        total += k % 5
        ends.append(total)
    assert len(got) == 2000
    for r in got:
        assert abs(bisect.bisect_left(ends, r.u * total) - r.id) <= 1 and r.id % 5


def test_a_whole_file_survives_a_stop(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/record.json"
    sources.write_whole(spark, path, "old")

    def stop(*args):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(sources, "_rename_over", stop)
        with pytest.raises(RuntimeError):
            sources.write_whole(spark, path, "new")
    assert (tmp_path / "record.json").read_text() == "old"
    sources.write_whole(spark, path, "new")
    assert (tmp_path / "record.json").read_text() == "new"


def test_cross_check_needs_common_ground(spark):
    built = spark.createDataFrame([("a", float(k), float(k * k)) for k in range(10)], "run string, x double, y double")
    reference = built.where("x % 3 = 0")
    (r,) = sources.cross_check(built, reference, ["run"], "x", "y", 2.5).collect()
    assert (r.n, r.deviation, r.ok) == (10, 2.0, True)
    assert not sources.cross_check(built, reference, ["run"], "x", "y", 1.5).first().ok
    with pytest.raises(Exception, match="no node in common"):
        sources.required_reference(built, reference.where("false"), ["run"], "x", "y").collect()
