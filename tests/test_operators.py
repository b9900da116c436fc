import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblage.functions import compact_number, iqr, quantile, strict_median
from ensemblage.operators import estimators, grid, models, particles, sampling, selection, simulate, tabular
from ensemblage.plans import orchestration

NAN = float("nan")


def test_missing_values_in_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("a", 10.0), ("a", NAN), ("a", None)], "k string, v double")
    row = df.agg(quantile(F.col("v"), 0.75).alias("q"), iqr(F.col("v")).alias("i"), strict_median(F.col("v")).alias("s")).first()
    assert row.q == 4.0 and row.i == 2.0 and math.isnan(row.s)


def test_pairs_ignore_missing_baselines_and_zero(spark):
    rows = [("abf", 1, NAN), ("abf", 2, 0.0), ("abf", 3, 2.0), ("fr", 1, 1.0), ("fr", 2, 1.0), ("fr", 3, 1.0), ("fr", 4, 1.0), ("fr", None, 1.0)]
    runs = spark.createDataFrame(rows, "method string, seed int, v double")
    got = tabular.pair_summary(tabular.matched_pairs(runs, "method", "abf", ["seed"], "v"), ["method"]).first()
    assert (got.n_pairs, got.wins, got.win_rate, got.median_gain) == (2, 1, 0.5, 50.0)


def test_single_run_has_no_standard_error(spark):
    runs = spark.createDataFrame([("abf", 1, 2.0), ("fr", 1, 1.0)], "method string, seed int, v double")
    row = tabular.paired_t(tabular.matched_pairs(runs, "method", "abf", ["seed"], "v"), ["method"]).first()
    assert row.n == 1 and row.se_diff is None and row.t_stat is None


def test_selection_falls_back_and_breaks_ties(spark):
    rows = [("t", "b", 1.0, False), ("t", "a", 1.0, False), ("u", "c", 1.0, False), ("u", "d", 2.0, True), ("u", "e", None, True)]
    df = spark.createDataFrame(rows, "target string, config string, m double, ok boolean")
    best = {r.target: r.config for r in selection.best_per_target(df, "target", "config", ["m"], F.col("ok")).where("selected").collect()}
    assert best == {"t": "a", "u": "d"}


def test_keep_last_over_shards_with_other_columns(spark):
    one = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id int, v string, part int")
    two = spark.createDataFrame([(1, 9, 1)], "id int, extra int, part int")
    got = {r.id: (r.v, r.extra) for r in selection.keep_last([one, two], ["id"], [F.col("part")]).collect()}
    assert got == {1: (None, 9), 2: ("y", None)}


@pytest.mark.parametrize("rows", [0, 2])
def test_exactly_one_fails_otherwise(spark, rows):
    df = spark.createDataFrame([(1, "a")] * rows, "k int, v string")
    with pytest.raises(Exception, match="rows found"):
        selection.exactly_one(df, k=1).collect()


def test_bins_at_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 9.99, 10.0, 10.1, 0.5, 1.5, 2.5)], "x double")
    rows = df.select("x", grid.closed_right_bin(F.col("x"), 0.0, 10.0, 5).alias("h"), grid.nearest_bin(F.col("x"), 0.0, 1.0, 11).alias("n"), grid.floor_bin(F.col("x"), 0.0, 1.0, 10).alias("f")).collect()
    assert [r.h for r in rows] == [None, 0, 4, 4, None, 0, 0, 1]
    assert [r.n for r in rows] == [0, 0, 10, 10, 10, 0, 2, 2]
    assert [r.f for r in rows] == [-1, 0, 9, -1, -1, 0, 1, 2]


def test_short_profiles(spark):
    df = spark.createDataFrame([("one", 0, 0.0, 2.0), ("two", 0, 0.0, 1.0), ("two", 1, 1.0, 3.0), ("gap", 0, 0.0, 1.0), ("gap", 1, 1.0, NAN)], "run string, j int, x double, y double")
    got = {r.run: r.integral for r in grid.trapezoid(df, ["run"], "x", "y").collect()}
    assert got == {"one": None, "two": 2.0, "gap": None}
    slope = {(r.run, r.j): r.slope for r in grid.finite_difference(df.where("run <> 'gap'"), ["run"], "x", "y").collect()}
    assert slope == {("one", 0): None, ("two", 0): 2.0, ("two", 1): 2.0}


def test_smoothing_matches_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.standard_normal(30)
    df = spark.createDataFrame([("r", j, float(v)) for j, v in enumerate(y)], "run string, j int, y double")
    for edge, unit, mode in (("reflect", "integral", "reflect"), ("replicate", "sum", "edge")):
        kernel = grid.gaussian_offsets(1.5, 1.0, unit=unit)
        r = kernel[-1][0]
        want = np.convolve(np.pad(y, r, mode=mode), [w for _, w in kernel], "valid")
        got = [x.y for x in grid.smooth(df, ["run"], "y", 30, kernel, edge).orderBy("j").collect()]
        assert got == pytest.approx(want.tolist())


def test_reference_profile_golden_values(spark):
    # Fixed values of the exact profile at beta 4: x, F, F', p.
    golden = [(-3.0, 14.893446, -21.863114, 6.623888e-35), (-1.5, -3.516205, -5.749531, 6.338006e-03), (0.0, -3.053417, 0.0, 9.954216e-04), (1.5, -3.516205, 5.749531, 6.338006e-03), (3.0, 14.893446, 21.863114, 6.623888e-35)]
    rows = {round(r.x, 6): r for r in models.reference_profile(spark).collect()}
    assert len(rows) == 401
    for x, f, fp, p in golden:
        assert rows[x].F == pytest.approx(f, abs=1e-6) and rows[x].Fprime == pytest.approx(fp, abs=1e-6) and rows[x].p == pytest.approx(p, rel=1e-6)


def test_potential_gradient_matches_differences(spark):
    v, h = models.POTENTIALS["two_channel"], 1e-5
    pts = spark.createDataFrame([(0.3, -0.4), (-1.2, 0.9), (2.0, 2.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    for r in pts.select(v.dx(x, y).alias("a"), ((v.value(x + h, y) - v.value(x - h, y)) / (2 * h)).alias("b"), v.dy(x, y).alias("c"), ((v.value(x, y + h) - v.value(x, y - h)) / (2 * h)).alias("d")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-6) and r.c == pytest.approx(r.d, abs=1e-6)


def test_trend_golden_values(spark):
    # Median paired gains by entropic share, slope and correlation.
    golden = {"estimated": ([13.0384, 4.7351, -9.7124, -8.1162, 12.6642], -8.2818, -0.2756), "uniform": ([13.0470, 6.0261, -14.3336, -0.5328, 12.8921], -4.9989, -0.1600), "oracle": ([-6.4806, -5.6968, 9.1687, 43.6645, 42.3648], 64.1406, 0.9400)}
    rows = [(m, x, g) for m, (gains, _, _) in golden.items() for x, g in zip((0, 0.25, 0.5, 0.75, 0.9), gains)]
    for r in tabular.trend(spark.createDataFrame([(m, float(x), g) for m, x, g in rows], "m string, x double, g double"), ["m"], "x", "g").collect():
        assert r.slope == pytest.approx(golden[r.m][1], abs=1e-3) and r.r == pytest.approx(golden[r.m][2], abs=1e-3)


def test_unpaired_gain_golden_value(spark):
    runs = spark.createDataFrame([("abf", 0.20982), ("fr", 0.09535)], "m string, v double")
    assert tabular.unpaired_gain(runs, "m", "abf", "v").first().gain == pytest.approx(0.5455541712, abs=1e-4)


def test_jarzynski_does_not_underflow(spark):
    w = spark.createDataFrame([("a", 5000.0), ("a", 5001.0)], "k string, w double")
    want = 5000 - math.log((1 + math.exp(-1)) / 2)
    assert estimators.jarzynski(w, ["k"], "w", 1.0).first().delta_f == pytest.approx(want)


def test_mbar_of_one_restraint_and_tolerance(spark):
    s = spark.createDataFrame([(0.1 * i, i % 2) for i in range(50)], "x double, home int")
    assert estimators.mbar(s, [1.0], "x", "home", 1.0, 1.0) == [1.0]
    z = estimators.mbar(s, [1.0, 3.0], "x", "home", 1.0, 1.0, rounds=200, tolerance=1e-10)
    again = estimators.mbar(s, [1.0, 3.0], "x", "home", 1.0, 1.0, rounds=400, tolerance=1e-12)
    assert z == pytest.approx(again, rel=1e-6)
    p = estimators.mbar_profile(s, [1.0, 3.0], z, "x", "home", 1.0, 1.0, F.floor("x")).collect()
    assert sum(r.p for r in p) == pytest.approx(1)


def test_oracle_guard():
    estimators.oracle_guard("oracle", profile=[1])
    with pytest.raises(ValueError):
        estimators.oracle_guard("estimated", profile=[1])


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 1.0), ("g", 3, 3.0)], "g string, id int, w double")
    draws = spark.range(400).select(F.lit("g").alias("g"), F.col("id").alias("draw")).withColumn("u", sampling.uniform("s", "draw"))
    got = [r.id for r in sampling.weighted_draws(df, "id", "w", draws, "u", ["g"]).collect()]
    assert len(got) == 400 and 1 not in got and 0.6 < got.count(3) / 400 < 0.9


def test_plans(spark):
    specs = orchestration.expand_grid(spark, {"eta": [0.5, 0.25], "seed": [0, 1, 2]})
    ids = [r[0] for r in specs.select(orchestration.config_id(["eta", "seed"])).collect()]
    assert len(set(ids)) == 6 and "eta=0.5_seed=0" in ids
    named = specs.withColumn("run_id", orchestration.config_id(["eta", "seed"]))
    assert orchestration.remaining(named, named.where("seed = 0"), named.where("seed = 1")).count() == 2
    assert orchestration.greedy_shards([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert orchestration.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    found = orchestration.overrides(["a.b=3", "a.c=[1, 2]", "d=text", "a.b=0.5"])
    assert found == {"a": {"b": 0.5, "c": [1, 2]}, "d": "text"}
    with pytest.raises(ValueError):
        orchestration.overrides(["a.b"])
    checks = spark.createDataFrame([("x", True), ("y", False)], "name string, ok boolean")
    with pytest.raises(Exception, match="failed: y"):
        orchestration.gate(checks).collect()
    assert spark.range(1).select(compact_number(F.lit(0.1))).first()[0] == "0.1"


def test_resampling_keeps_the_number_and_the_cap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        score = rng.standard_normal(200) * 5
        pool, events = simulate.resample(score, 1.0, 0.5, 0.1, rng)
        assert len(pool) == 200 and events <= 20
    pool, events = simulate.resample(score, 0.0, 0.5, 0.1, rng)
    assert events == 0 and pool.tolist() == list(range(200))
    pool, events = simulate.resample(score, 1.0, 0.5, 0.001, rng)
    assert events == 0 and pool.tolist() == list(range(200))


def test_all_resamplers_keep_the_number_of_particles():
    rng = np.random.default_rng(2)
    for name, make in simulate.RESAMPLERS.items():
        kill = make(200, rng) if name == "clocks" else make
        for _ in range(20):
            score = rng.standard_normal(200) * 5
            pool, events = kill(score, 1.0, 0.5, 0.1, rng)
            assert len(pool) == 200 and pool.min() >= 0 and pool.max() < 200
            assert name == "clocks" or events <= 20
        pool, events = kill(score, 0.0, 0.5, 0.1, rng)
        assert events == 0 and pool.tolist() == list(range(200))
        # Nobody to clone, or no event allowed.
        if name in ("weighted", "configurations"):
            assert kill(np.ones(200), 1.0, 0.5, 0.1, rng)[1] == 0
            assert kill(score, 9.0, 0.5, 0.004, rng)[1] == 0
    assert abs(simulate.recentred(np.array([9.0, 1, -2, -3]), 2).mean()) < 1e-12
    # Those who die are the over-represented ones, clones the others.
    score = np.repeat([3.0, -3.0], 100)
    for name in ("proportional", "weighted", "configurations"):
        pool, events = simulate.RESAMPLERS[name](score, 1.0, 0.5, 0.3, rng)
        assert events > 0 and (pool < 100).sum() < 100


def test_targets_and_leakage():
    grid_, p = np.linspace(-2, 2, 41), np.linspace(1, 3, 41)
    bias, average = np.cos(grid_), np.sin(grid_)
    step = grid_[1] - grid_[0]
    for method in ("uniform", "estimated", "self"):
        q = simulate.target_of(method, grid_, p, bias, average, 2.0)
        assert abs(simulate._integral(q, step) - 1) < 1e-9
        with pytest.raises(ValueError):
            simulate.target_of(method, grid_, p, bias, average, 2.0, reference=average)
    want = np.exp(-2 * (average - bias))
    assert np.allclose(simulate.target_of("oracle", grid_, p, bias, bias, 2.0, reference=average), want / simulate._integral(want, step))
    assert np.allclose(simulate.target_of("self", grid_, p, bias, bias, 2.0), p / simulate._integral(p, step))


def test_starts_and_surface():
    rng = np.random.default_rng(3)
    for kind, left in (("left", 1), ("right", 0), ("mixed", 0.5)):
        x = simulate.starting(kind, 100, -3, 3, rng)
        assert (x < 0).mean() == left and np.abs(x).min() > 0.5 and np.abs(x).max() < 2.5
    s, h = simulate.Surface(), 1e-5
    v = lambda x, y: 3 * np.exp(-x * x) * (np.exp(-((y - 1 / 3) ** 2)) - np.exp(-((y - 5 / 3) ** 2))) - 5 * np.exp(-y * y) * (np.exp(-((x - 1) ** 2)) + np.exp(-((x + 1) ** 2))) + 0.2 * x**4 + 0.2 * (y - 1 / 3) ** 4
    fx, fy = s.forces(0.7, -0.4)
    assert abs(fx + (v(0.7 + h, -0.4) - v(0.7 - h, -0.4)) / (2 * h)) < 1e-6 and abs(fy + (v(0.7, -0.4 + h) - v(0.7, -0.4 - h)) / (2 * h)) < 1e-6
    spec = {"run_id": "a", "method": "estimated", "seed": 1, "beta": 4.0, "n": 60, "steps": 200, "dt": 0.005, "rate": 1.0, "every": 5, "start": 40, "cap": 0.1}
    found = {(m, r, i): simulate.simulate_run({**spec, "model": m, "resampler": r, "init": i})[-1] for m in ("channel", "surface") for r in simulate.RESAMPLERS for i in ("well", "mixed")}
    assert all(1 <= r[8] <= 60 and 1 <= r[7] <= 60 and 0 <= r[10] <= 1 for r in found.values())
    assert len({r[5] for r in found.values()}) == len(found)


def test_runs_are_reproducible_and_isolated(spark):
    good = ("a", "uniform", 1, 4.0, 50, 100, 0.01, 1.0, 5, 20, 0.1)
    specs = spark.createDataFrame([good, ("b", "abf", 1, -4.0, 50, 100, 0.01, 1.0, 5, 20, 0.1)], simulate.SPEC)
    rows = simulate.simulate(specs).collect()
    assert [r.error is None for r in rows if r.run_id == "a"] == [True] * 10
    assert [r.error is None for r in rows if r.run_id == "b"] == [False]
    again = simulate.simulate(specs.where("run_id = 'a'")).collect()
    assert sorted(r for r in rows if r.run_id == "a") == sorted(again)
    assert all(1 <= r.ess <= 50 and r.events_fraction <= 0.1 for r in again)


def test_estimated_target_is_not_the_flat_one():
    spec = {"run_id": "a", "seed": 1, "beta": 4.0, "n": 100, "steps": 300, "dt": 0.01, "rate": 1.0, "every": 10, "start": 50, "cap": 0.1}
    flat, estimated, again = (simulate.simulate_run({**spec, "method": m}) for m in ("uniform", "estimated", "estimated"))
    assert estimated == again
    assert [r[3:] for r in flat[:1]] == [r[3:] for r in estimated[:1]]  # before resampling starts
    assert all(f[3:] != e[3:] for f, e in zip(flat[2:], estimated[2:]))


def test_simulate_methods_runs_every_method(spark):
    from ensemblage.plans import registry

    rows = registry.QUERIES["simulate_methods"](spark, "")
    runs = {(r.method, r.seed): r["count"] for r in rows.groupBy("method", "seed").count().collect()}
    assert runs == {(m, s): 10 for m in ("abf", "uniform", "estimated", "oracle", "self") for s in (0, 1, 2)}
    ids = spark.createDataFrame([("abf", 0.5), ("uniform", 0.5), (None, 1.0)], "method string, eta double").select(orchestration.config_id(["method", "eta"]))
    assert [r[0] for r in ids.collect()] == ["method=abf_eta=0.5", "method=uniform_eta=0.5", "method=null_eta=1"]


@pytest.mark.parametrize("members", [2, 1 << 16])
def test_particles_at_one_place_are_one_site(spark, monkeypatch, members):
    monkeypatch.setattr(particles, "MEMBERS", members)
    rng = random.Random(8)
    spots = [(rng.uniform(-3, 12), rng.uniform(0, 10)) for _ in range(12)]
    state = [(b, k, *rng.choice(spots[:6] if b == "dense" else spots)) for b in ("dense", "wide") for k in range(40)]
    df = spark.createDataFrame(state, "box string, id long, x double, y double")
    image = lambda d: d - 10 * round(d / 10)
    want, force, energy = {}, {}, {}
    for b, i, x, y in state:
        for _, j, u, v in [t for t in state if t[0] == b and t[1] > i]:
            dx, dy = image(x - u), image(y - v)
            r = math.hypot(dx, dy)
            if (i, j) == (0, 1):
                r = max(r, 1e-12)
                w = (r - 2 ** (1 / 6) - 0.5) / 0.5
                e, f = (1 - w * w) ** 2, 4 * w * (1 - w * w) / 0.5 / r
            else:
                if r <= 2.2:
                    want[b, i, j] = (dx, dy, r)
                if r > 2 ** (1 / 6):
                    continue
                six = (1 / max(r, 0.8)) ** 6
                e, f = 4 * (six * six - six) + 1, 24 / max(r, 0.8) ** 2 * (2 * six * six - six)
            energy[b] = energy.get(b, 0.0) + e
            for k, s in ((i, f), (j, -f)):
                a = force.get((b, k), (0.0, 0.0))
                force[b, k] = (a[0] + s * dx, a[1] + s * dy)
    rows = particles.neighbours(df, ["box"], 2.2, 10.0).collect()
    got = {(r.box, r.i, r.j): (r.dx, r.dy, r.r) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    e, f = particles.energies_and_forces(df, ["box"], 10.0, least=0.8)
    assert {r.box: r.energy for r in e.collect()} == pytest.approx(energy, rel=1e-9)
    got = {(r.box, r.id): (r.fx, r.fy) for r in f.collect()}
    assert got.keys() == force.keys()
    assert all(got[k] == pytest.approx(force[k], rel=1e-6, abs=1e-6) for k in force)
    # 40 particles of the dense box stand at six places.
    assert particles.sites(df.where("box = 'dense'"), ["box"]).select("x", "y").distinct().count() == 6


def test_pairs_of_a_crowded_cell_are_dealt_and_written_out_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(particles, "MEETINGS", 300)
    monkeypatch.setattr(particles, "CROWD", 3)
    rng = random.Random(4)
    spots = [(rng.uniform(4, 5), rng.uniform(4, 5)) for _ in range(8)]
    state = [("one", k, *rng.choice(spots)) for k in range(60)] + [("two", k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(60)] + [("three", k, 1.0, None) for k in range(3)]
    df = spark.createDataFrame(state, "box string, id long, x double, y double")
    image = lambda d: d - 10 * round(d / 10)
    near = lambda s, t: math.hypot(image(s[2] - t[2]), image(s[3] - t[3])) <= 1.3
    want = [(s[0], s[1], t[1]) for s in state for t in state if s[0] == t[0] != "three" and s[1] < t[1] and (s[1], t[1]) != (0, 1) and near(s, t)]
    pairs = particles.neighbours(df, ["box"], 1.3, 10.0)
    assert sorted((r.box, r.i, r.j) for r in pairs.collect()) == sorted(want)
    # The loop that writes pairs out would hold all pairs of a site, were the join in it.
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins, loops = (set(re.findall(rf"\*\((\d+)\) {node}", plan)) for node in (r"(?:SortMerge|BroadcastHash)Join", r"Generate explode\(ids[12]"))
    assert joins and loops and not joins & loops
    # All of the first box stands in one cell.
    assert pairs.where("box = 'one'").select(F.spark_partition_id()).distinct().count() > 4
