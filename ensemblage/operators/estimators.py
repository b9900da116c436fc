"""Free-energy estimators: Jarzynski, MBAR, extended-variable unbiasing, and the
targets, scores and rates of birth-death resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import EPS, cumulative_trapezoid, finite_difference, gauge_fix, interpolate, normalised, smooth, trapezoid


def jarzynski(work: DataFrame, keys: list[str], w: str, beta: float) -> DataFrame:
    """-log(mean(exp(-beta W))) / beta; the least work is taken out first, so that
    no exponential underflows for all."""
    least = work.groupBy(*keys).agg(F.min(w).alias("_least"))
    df = work.join(least, keys)
    return df.groupBy(*keys).agg((F.max("_least") - F.log(F.avg(F.exp(-beta * (F.col(w) - F.col("_least"))))) / beta).alias("delta_f"), F.count("*").alias("n"))


def _log_weights(x: str, centers: list[float], stiffness: float, beta: float, logs: list[float | None]) -> Column:
    """Array over the restraints of log n_k + f_k - beta u_k(x), null where n_k is 0."""
    each = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(None if g is None else float(g)).cast("double").alias("g")) for c, g in zip(centers, logs)])
    return F.transform(each, lambda k: k["g"] - beta * stiffness / 2 * (F.col(x) - k["c"]) * (F.col(x) - k["c"]))


def _log_sum(terms: Column) -> Column:
    most = F.array_max(terms)
    return most + F.log(F.aggregate(terms, F.lit(0.0), lambda t, v: t + F.coalesce(F.exp(v - most), F.lit(0.0))))


def _mixed(history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Anderson's mixture of the last iterates and what a round made of them."""
    f, g = history[-1]
    if len(history) < 2:
        return g
    residual = g - f
    steps = np.stack([(b - a) - residual for a, b in history[:-1]], 1)
    weights, *_ = np.linalg.lstsq(steps, -residual, rcond=1e-10)
    moved = g + np.stack([b - g for _, b in history[:-1]], 1) @ weights
    # Far from the solution a mixture may leave it; then the plain round counts.
    return moved if np.isfinite(moved).all() and np.abs(moved - g).max() < 10 * np.abs(residual).max() + 1e-12 else g


def mbar(samples: DataFrame, centers: list[float], x: str, home: str, stiffness: float, beta: float, rounds: int = 20, tolerance: float | None = None) -> list[float]:
    """Weights z of harmonic restraints by self-consistent iteration, z[K/2] = 1.

    z_k = sum_n exp(-beta u_k(x_n)) / sum_l N_l exp(-beta u_l(x_n)) / z_l, with f = -log z.
    Everything is in logarithms: a sample's restraints are one array, its denominator a
    log-sum of it, and what is added up for each k is a probability, so that nothing
    underflows far from all centers.  A round is one aggregate with K sums, and K numbers
    come back; rounds are mixed by Anderson's method.  At most ``rounds``, or until a round
    changes no weight by more than ``tolerance`` (relative).  The two columns are kept
    through the rounds."""
    samples = samples.select(x, home).persist()
    counts = {r[0]: r[1] for r in samples.groupBy(home).count().collect()}
    n = [counts.get(k, 0) for k in range(len(centers))]
    at = lambda f: _log_weights(x, centers, stiffness, beta, f)
    f, history = np.zeros(len(centers)), []
    for _ in range(rounds):
        rows = samples.select(at(list(f)).alias("_u"), _log_sum(at([math.log(m) + v if m else None for m, v in zip(n, f)])).alias("_l"))
        row = rows.agg(*[F.sum(F.exp(F.get("_u", F.lit(k)) - F.col("_l"))).alias(f"s{k}") for k in range(len(centers))]).first()
        new = f - np.log(np.array([max(v or 0.0, 1e-300) for v in row]))
        new -= new[len(centers) // 2]
        change = np.abs(np.expm1(f - new)).max()
        if tolerance is not None and change <= tolerance:
            f = new
            break
        history = [*history[-4:], (f, new)]
        f = _mixed(history)
    samples.unpersist()
    return [float(v) for v in np.exp(-(f - f[len(centers) // 2]))]


def mbar_profile(samples: DataFrame, centers: list[float], z: list[float], x: str, home: str, stiffness: float, beta: float, bin_of: Column) -> DataFrame:
    """Unbiased probability of each bin from the samples' MBAR weights, in logarithms."""
    counts = {r[0]: r[1] for r in samples.groupBy(home).count().collect()}
    logs = [math.log(counts[k]) - math.log(v) if counts.get(k) else None for k, v in enumerate(z)]
    weighed = samples.select(bin_of.alias("bin"), (-_log_sum(_log_weights(x, centers, stiffness, beta, logs))).alias("_w"))
    # The largest weight is taken out before exponentials are added up.
    top = weighed.agg(F.max("_w").alias("_top"))
    sums = weighed.crossJoin(F.broadcast(top)).groupBy("bin").agg(F.sum(F.exp(F.col("_w") - F.col("_top"))).alias("_w"))
    total = sums.agg(F.sum("_w").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select("bin", (F.col("_w") / F.col("_t")).alias("p"), (-F.log(F.col("_w") / F.col("_t")) / beta).alias("pmf"))


def czar(profile: DataFrame, run: list[str], z: str, density: str, mean_lambda: str, beta: float, stiffness: float) -> DataFrame:
    """Unbiased mean force -(1/beta) d log rho / dz + k (<lambda>_z - z)."""
    df = finite_difference(profile.withColumn("_l", F.log(F.greatest(density, F.lit(EPS)))), run, z, "_l", "_d")
    return df.withColumn("mean_force", -F.col("_d") / beta + stiffness * (F.col(mean_lambda) - F.col(z))).drop("_l", "_d")


def running_mean(samples: DataFrame, run: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("running", F.avg(value).over(w))


# ---------------------------------------------------------------- birth-death


def target_density(profile: DataFrame, run: list[str], x: str, kind: str, beta: float, estimate: str = "F", bias: str = "B") -> DataFrame:
    """Density q that resampling aims at: ``uniform``; ``estimated`` or ``oracle``, of
    exp(-beta (F - bias)), where F is an estimate or, for the oracle method only, the
    reference (see ``oracle_guard``), clamped after it is normalised, and normalised
    again.  ``self_target`` gives the fourth kind."""
    df = profile
    if kind == "uniform":
        df = df.withColumn("q", F.lit(1.0))
    elif kind in ("estimated", "oracle"):
        u = F.col(estimate) - F.col(bias)
        df = df.withColumn("q", F.exp(-beta * (u - F.min(u).over(Window.partitionBy(*run)))))
    else:
        raise ValueError(kind)
    return normalised(df, run, x, "q", again=kind != "uniform")


def oracle_guard(method: str, **reference) -> None:
    """Reference values may reach the oracle method alone."""
    if method != "oracle" and any(v is not None for v in reference.values()):
        raise ValueError(f"reference values must not reach method {method}")


def scores(profile: DataFrame, run: list[str], x: str, p: str, q: str, eps: float = EPS) -> DataFrame:
    """Score log(p/q) - KL(p||q) at each node."""
    ratio = F.log(F.greatest(F.col(p), F.lit(eps)) / F.greatest(F.col(q), F.lit(eps)))
    df = profile.withColumn("_l", ratio).withColumn("_k", F.col(p) * F.col("_l"))
    return df.join(trapezoid(df, run, x, "_k", "kl"), run).withColumn("score", F.col("_l") - F.col("kl")).drop("_l", "_k")


def particle_scores(particles: DataFrame, profile: DataFrame, x: str, low: float, step: float, n: int, cap: float) -> DataFrame:
    """Scores at the particles' places, clipped to [-cap, cap]."""
    df = interpolate(particles, profile, x, low, step, n, "score")
    return df.withColumn("score", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("score"))))


def recentred_clip(df: DataFrame, run: list[str], score: str, cap: float, times: int = 3) -> DataFrame:
    """Clip and take the mean out, again and again."""
    w = Window.partitionBy(*run)
    for _ in range(times):
        df = df.withColumn(score, F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col(score))))
        df = df.withColumn(score, F.col(score) - F.avg(score).over(w))
    return df


def ramp(t: Column, start: float, rate: float, time: float) -> Column:
    """Rate gamma (1 - exp(-s)) with s the time since ``start`` over ``time``."""
    s = F.greatest(t - start, F.lit(0.0)) / time
    return rate * (1 - F.exp(-s))


def death_probability(score: Column, rate: float, dt: float) -> Column:
    """1 - exp(-rate * score * dt) where the score is positive, else 0."""
    return F.when(score > 0, 1 - F.exp(-rate * score * dt)).otherwise(0.0)


def replacement_fraction(died: Column, cloned: Column, applied: Column, n: int) -> Column:
    return (died + cloned) / F.greatest(applied * n, F.lit(1))


def barrier_decomposition(energetic: Column, beta: float, m: int, omega_in: Column, omega_out: Column) -> list[Column]:
    return [(beta * energetic).alias("energetic"), (m * F.log(omega_in / omega_out)).alias("entropic")]


# --------------------------------------------------------------- whole chains


def integrated_profile(samples: DataFrame, z: str, force: str, step: float, n: int, smoothing: list[tuple[int, float]], points: DataFrame, x: str, at: float, low: float = 0.0) -> DataFrame:
    """Thermodynamic integration as a whole: mean constrained force at each of ``n``
    nodes, smoothed with its end values going on, integrated by trapezoids, interpolated
    at ``points`` (column ``x``), and 0 at the point nearest to ``at``."""
    j = F.rint((F.col(z) - low) / step).cast("int")
    means = samples.groupBy(j.alias("j")).agg(F.avg(force).alias("f"))
    flat = smooth(means, [], "f", n, smoothing, "replicate").withColumn("_x", low + F.col("j") * step).withColumn("_run", F.lit(0))
    profile = cumulative_trapezoid(flat, ["_run"], "_x", "f", "free_energy").select("j", "free_energy")
    found = interpolate(points, profile, x, low, step, n, "free_energy").withColumn("_run", F.lit(0))
    return gauge_fix(found, ["_run"], x, "free_energy", at).drop("_run")


def work_profile(path: DataFrame, run: str, order: list[str], xi: str, force: str, beta: float) -> DataFrame:
    """Free energy along a driven coordinate: each run's work is summed up from the
    force times the coordinate's step, and Jarzynski's estimate is taken over the runs
    at each step (the first of ``order``): (step, n, free_energy)."""
    w = Window.partitionBy(run).orderBy(*order)
    moved = F.coalesce(F.col(xi) - F.lag(xi).over(w), F.lit(0.0))
    work = path.withColumn("_w", F.col(force) * moved).withColumn("work", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = jarzynski(work, [order[0]], "work", beta)
    return out.select(order[0], "n", F.col("delta_f").alias("free_energy"))


def mbar_restrained_profile(samples: DataFrame, centers: list[float], x: str, home: str, stiffness: float, beta: float, low: float, step: float, n: int, tolerance: float = 1e-9, most: int = 500) -> DataFrame:
    """Iterate the restraints' weights to ``tolerance`` and give probability and free
    energy at the nodes: (bin, p, pmf), over the bins of half a step about each node."""
    j = F.rint((F.col(x) - low) / step).cast("int")
    z = mbar(samples, centers, x, home, stiffness, beta, most, tolerance)
    return mbar_profile(samples, centers, z, x, home, stiffness, beta, F.when((j >= 0) & (j < n), j))


def self_target(profile: DataFrame, run: list[str], x: str, p: str) -> DataFrame:
    """Target q that is the present density itself: a control that moves nothing."""
    return normalised(profile.withColumn("q", F.col(p)), run, x, "q")
