import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblage.operators import estimators, models
from ensemblage.operators import sampled_systems as systems

SPEC = {"run_id": "a", "seed": 1, "beta": 4.0, "n": 100, "dt": 0.005, "every": 10}


def test_box_forces_are_the_energy_s_slope():
    box, rng = systems.Box(3, 1.2), np.random.default_rng(1)
    q = box.start(1, rng)

    def energy(q):
        d = systems.minimum_image(q[0, :, None] - q[0, None], box.length)
        r = np.linalg.norm(d, axis=2)[np.triu_indices(box.n, 1)][1:]
        dimer = (box.dimer(q)[1][0] - box.rest - box.width) / box.width
        return (4 * (r**-12 - r**-6) + 1)[r <= box.rest].sum() + (1 - dimer**2) ** 2

    f = box.forces(q)
    assert np.abs(f.sum(1)).max() < 1e-9
    for particle, axis in ((0, 0), (1, 1), (4, 0), (7, 1)):
        up, down = q.copy(), q.copy()
        up[0, particle, axis] += 1e-6
        down[0, particle, axis] -= 1e-6
        assert f[0, particle, axis] == pytest.approx(-(energy(up) - energy(down)) / 2e-6, rel=1e-4, abs=1e-5)
    assert box.coordinate(q)[0] == pytest.approx(0, abs=1e-9)


def test_dimer_runs_repeat_and_resample():
    spec = SPEC | {"side": 3, "spacing": 1.3, "n": 20, "steps": 60, "dt": 0.0005, "rate": 20.0, "start": 10, "every": 5, "cap": 0.2}
    abf, flat, again = (systems.dimer_run({**spec, "method": m}) for m in ("abf", "uniform", "uniform"))
    assert flat == again and len(flat) == 5
    assert abf[-1][8] == 0 and abf[-1][9] == 20 and flat[-1][8] > 0 and 1 <= flat[-1][10] <= 20
    assert all(sum(r[5:8]) == pytest.approx(1) for r in abf + flat)


@pytest.mark.parametrize("dynamics", ["overdamped", "langevin"])
def test_constrained_forces_integrate_to_the_free_energy(spark, dynamics):
    centers = [round(-1.2 + 0.2 * k, 1) for k in range(13)]
    fields = [(f"{k}", k, "constrained", c, k) for k, c in enumerate(centers)]
    specs = spark.createDataFrame(fields, "run_id string, seed long, kind string, center double, home int")
    specs = specs.withColumns({"beta": F.lit(4.0), "n": F.lit(200), "dt": F.lit(0.02), "every": F.lit(20), "steps": F.lit(2000), "dynamics": F.lit(dynamics)})
    rows = systems.sample(specs, systems.fixed_run, systems.SAMPLE_ROW).where("step > 400")
    points = spark.createDataFrame([(c,) for c in centers], "t double")
    found = estimators.integrated_profile(rows, "x", "force", 0.2, 13, [(0, 1.0)], points, "t", 0.0, -1.2).orderBy("t").collect()
    f = models.Channel(m=1)
    want = spark.createDataFrame([(c,) for c in centers], "x double").select("x", f.free_energy(F.col("x")).alias("f")).orderBy("x").collect()
    middle = want[6].f
    assert max(abs(a.free_energy - (b.f - middle)) for a, b in zip(found, want)) < 0.15


def test_driven_work_bounds_the_free_energy(spark):
    spec = SPEC | {"kind": "driven", "center": -1.0, "goal": 0.0, "home": 0, "n": 400, "steps": 400, "every": 1, "dt": 0.01}
    rows = spark.createDataFrame(systems.fixed_run(spec), systems.SAMPLE_ROW)
    last = estimators.work_profile(rows, "home", ["step"], "x", "force", 4.0).orderBy(F.desc("step")).first()
    f = models.Channel(m=1)
    ends = spark.createDataFrame([(-1.0,), (0.0,)], "x double").select(f.free_energy(F.col("x")).alias("f")).collect()
    assert last.free_energy == pytest.approx(ends[1].f - ends[0].f, abs=0.2)


def test_restrained_samples_give_the_profile(spark):
    centers = [-1.0, -0.5, 0.0, 0.5, 1.0]
    rows = [r for k, c in enumerate(centers) for r in systems.fixed_run(SPEC | {"run_id": f"{k}", "seed": k, "kind": "restrained", "center": c, "home": k, "stiffness": 20.0, "steps": 3000, "dt": 0.005, "every": 20})]
    df = spark.createDataFrame(rows, systems.SAMPLE_ROW).where("step > 600")
    got = {r.bin: r.pmf for r in estimators.mbar_restrained_profile(df, centers, "x", "home", 20.0, 4.0, -1.2, 0.2, 13, 1e-6).collect()}
    x = np.round(-1.2 + 0.2 * np.arange(13), 1)
    f = models.Channel(m=1)
    want = [r.f for r in spark.createDataFrame([(float(v),) for v in x], "x double").select("x", f.free_energy(F.col("x")).alias("f")).orderBy("x").collect()]
    off = [got[j] - got[6] - (want[j] - want[6]) for j in range(1, 12)]
    assert max(map(abs, off)) < 0.25


def test_extended_sums_are_unbiased(spark):
    spec = SPEC | {"model": "channel", "stiffness": 50.0, "steps": 3000, "n": 200}
    rows = spark.createDataFrame(systems.extended_run(spec), systems.EXTENDED_ROW)
    out = estimators.czar(rows.where("hits > 200"), ["run_id"], "z", "density", "mean_lambda", 4.0, 50.0)
    f = models.Channel(m=1)
    got = out.where("abs(z) < 1.1").select("z", "mean_force", f.mean_force(F.col("z")).alias("want")).collect()
    assert len(got) > 20 and np.mean([abs(r.mean_force - r.want) for r in got]) < 0.6
