"""Further run-parallel samplers: extended-variable bias, constrained, restrained and
driven sampling of the surface models, and replicas of a dimer in a box of repulsive disks.

Like the runs in ``simulate`` each one is a feedback loop inside one task, reproducible by
its seed; runs are what Spark spreads.  Their rows feed the estimators: constrained forces
the integration chain, restrained samples MBAR, driven paths the work average, extended
sums the unbiasing by ``czar``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .simulate import Channel, Surface, fold, recentred, replace_configurations

MODELS = {"channel": (Channel(), (-2.0, 2.0)), "surface": (Surface(), (-3.0, 3.0))}


def streams(seed, count: int = 3) -> list[np.random.Generator]:
    """Independent generators of a run."""
    key = int(hashlib.sha256(str(seed).encode()).hexdigest()[:15], 16)
    return [np.random.default_rng([key, k]) for k in range(count)]


class Mover:
    """One step of overdamped dynamics, or of Langevin dynamics with friction: half a
    kick, a drift, half a kick with implicit friction."""

    def __init__(self, kind: str, dt: float, beta: float, rng: np.random.Generator, friction: float = 1.0):
        self.kind, self.dt, self.beta, self.rng, self.friction = kind, dt, beta, rng, friction
        self.p: dict[str, np.ndarray] = {}

    def __call__(self, name: str, q: np.ndarray, force) -> np.ndarray:
        """New positions of the coordinate ``name``; ``force`` maps positions to forces."""
        dt = self.dt
        if self.kind == "overdamped":
            return q + dt * force(q) + np.sqrt(2 * dt / self.beta) * self.rng.standard_normal(q.shape)
        p = self.p.setdefault(name, self.rng.standard_normal(q.shape) / np.sqrt(self.beta))
        kick = np.sqrt(self.friction * dt / self.beta)
        p = p + dt / 2 * (force(q) - self.friction * p) + kick * self.rng.standard_normal(q.shape)
        q = q + dt * p
        self.p[name] = (p + dt / 2 * force(q) + kick * self.rng.standard_normal(q.shape)) / (1 + self.friction * dt / 2)
        return q


EXTENDED_ROW = "run_id string, j int, z double, hits_ext double, force_ext double, hits double, mean_lambda double, density double"


def extended_run(spec: dict, nodes: int = 60, least: int = 100) -> list[tuple]:
    """An extended variable on a spring, biased by its own mean force: for each bin of
    the interval the hits and mean force of the extended variable, and the hits and mean
    extended variable of the coordinate itself, which ``czar`` unbiases."""
    start, noise, extra = streams(spec["seed"])
    model, (low, high) = MODELS[spec.get("model") or "surface"]
    n, beta, dt, k = int(spec["n"]), spec["beta"], spec["dt"], spec["stiffness"]
    step = (high - low) / nodes
    x, y = -1 + 0.1 * start.standard_normal(n), 0.3 * start.standard_normal(n)
    extended = x.copy()
    sums, hits, lambdas, own = np.zeros((4, nodes))
    amplitude = np.sqrt(2 * dt / beta)
    for _ in range(int(spec["steps"])):
        fx, fy = model.forces(x, y)
        pull = k * (extended - x)
        j, i = (np.clip(((v - low) / step).astype(int), 0, nodes - 1) for v in (extended, x))
        sums += np.bincount(j, weights=pull, minlength=nodes)
        hits += np.bincount(j, minlength=nodes)
        lambdas += np.bincount(i, weights=extended, minlength=nodes)
        own += np.bincount(i, minlength=nodes)
        bias = (sums / np.maximum(hits, least))[j]
        x = fold(x + dt * (fx + pull) + amplitude * noise.standard_normal(n), low, high)
        y = y + dt * fy + amplitude * noise.standard_normal(n)
        extended = fold(extended + dt * (bias - pull) + amplitude * extra.standard_normal(n), low, high)
    z = low + (np.arange(nodes) + 0.5) * step
    columns = (z, hits, sums / np.maximum(hits, 1), own, lambdas / np.maximum(own, 1), own / (own.sum() * step))
    return [(spec["run_id"], j, *map(float, row)) for j, row in enumerate(zip(*columns))]


SAMPLE_ROW = "run_id string, home int, step long, x double, y double, force double"


def fixed_run(spec: dict) -> list[tuple]:
    """Sampling along the coordinate.  Kind ``constrained``: particles stay at x =
    ``center`` and report the model's force there; ``restrained``: a spring of
    ``stiffness`` holds them about it; ``driven``: x goes from ``center`` to ``goal`` in
    the run's time, whatever the particles do.  Rows of every ``every``-th step; a row's
    force is dV/dx, its home the spec's ``home``."""
    start, noise, _ = streams(spec["seed"])
    model, _ = MODELS[spec.get("model") or "channel"]
    n, steps, beta = int(spec["n"]), int(spec["steps"]), spec["beta"]
    move = Mover(spec.get("dynamics") or "overdamped", spec["dt"], beta, noise)
    x, y = np.full(n, float(spec["center"])), 0.3 * start.standard_normal(n)
    rows = []
    for k in range(1, steps + 1):
        if spec["kind"] == "driven":
            x = np.full(n, spec["center"] + (spec["goal"] - spec["center"]) * k / steps)
        elif spec["kind"] == "restrained":
            x = move("x", x, lambda q: model.forces(q, y)[0] - spec["stiffness"] * (q - spec["center"]))
        y = move("y", y, lambda q: model.forces(x, q)[1])
        if k % int(spec["every"]) == 0:
            force = -model.forces(x, y)[0]
            # A driven particle is a run of its own.
            home = np.arange(n) if spec["kind"] == "driven" else np.full(n, int(spec["home"]))
            rows += zip([spec["run_id"]] * n, home.tolist(), [k] * n, x.tolist(), y.tolist(), force.tolist())
    return rows


def minimum_image(d: np.ndarray, length: float) -> np.ndarray:
    return d - length * np.rint(d / length)


class Box:
    """Replicas of a square periodic box of repulsive disks; disks 0 and 1 are a dimer."""

    def __init__(self, side: int, spacing: float, height: float = 1.0, width: float = 0.5):
        self.n, self.length, self.height, self.width, self.rest = side * side, side * spacing, height, width, 2 ** (1 / 6)
        self.spacing, self.side = spacing, side
        i, j = np.triu_indices(self.n, 1)
        self.i, self.j = i[1:], j[1:]  # the first pair is the dimer

    def start(self, replicas: int, rng: np.random.Generator) -> np.ndarray:
        """A jittered lattice, shifted at random, with the dimer at its short length."""
        at = (np.arange(self.side) + 0.5) * self.spacing
        q = np.stack(np.meshgrid(at, at, indexing="ij"), -1).reshape(1, self.n, 2) + rng.uniform(0, self.length, (replicas, 1, 2))
        q = q + 0.015 * rng.standard_normal((replicas, self.n, 2))
        q[:, 1] = q[:, 0] + [0.0, self.rest]
        return q % self.length

    def dimer(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = minimum_image(q[:, 0] - q[:, 1], self.length)
        return d, np.maximum(np.linalg.norm(d, axis=1), 1e-12)

    def coordinate(self, q: np.ndarray) -> np.ndarray:
        return (self.dimer(q)[1] - self.rest) / (2 * self.width)

    def forces(self, q: np.ndarray) -> np.ndarray:
        d = minimum_image(q[:, self.i] - q[:, self.j], self.length)
        r = np.maximum(np.linalg.norm(d, axis=2), 0.5)
        six = r**-6.0
        push = np.where(r <= self.rest, 24 * (2 * six * six - six) / (r * r), 0.0)[..., None] * d
        out = np.zeros_like(q)
        for k in range(2):
            flat = np.zeros((q.shape[0], self.n))
            np.add.at(flat.T, self.i, push[..., k].T)
            np.subtract.at(flat.T, self.j, push[..., k].T)
            out[..., k] = flat
        d, r = self.dimer(q)
        u = (r - self.rest - self.width) / self.width
        bond = (4 * self.height * u * (1 - u * u) / self.width / r)[:, None] * d
        out[:, 0] += bond
        out[:, 1] -= bond
        return out

    def mean_force(self, q: np.ndarray, forces: np.ndarray, beta: float) -> np.ndarray:
        """Local mean force: the energetic part along the dimer, less the entropic one."""
        d, r = self.dimer(q)
        return self.width / r * (d * (forces[:, 1] - forces[:, 0])).sum(1) - 2 * self.width / (beta * r)


DIMER_ROW = "run_id string, method string, seed long, step long, t double, frac_compact double, frac_transition double, frac_stretched double, replaced long, n_unique long, ess double, pmf_range double, error string"


def dimer_run(spec: dict, nodes: int = 61, low: float = -0.2, high: float = 1.2, bandwidth: float = 0.03, clip: float = 200.0, snapshots: int = 5) -> list[tuple]:
    """Replicas biased along the dimer's coordinate by a kernel estimate of its mean
    force, which is ramped up; beyond [low, high] a wall pulls back.  Method ``abf``
    biases alone, ``uniform`` also resamples whole configurations to the flat density."""
    start, noise, choice = streams(spec["seed"])
    box = Box(int(spec["side"]), spec["spacing"])
    n, beta, dt = int(spec["n"]), spec["beta"], spec["dt"]
    q = box.start(n, start)
    grid, step = np.linspace(low, high, nodes, retstep=True)
    num, den = np.zeros((2, nodes))
    ancestor, replaced, rows = np.arange(n), 0, []
    steps = int(spec["steps"])
    every = max(1, steps // snapshots)
    for k in range(1, steps + 1):
        z, f = box.coordinate(q), np.clip(box.forces(q), -clip, clip)
        w = np.exp(-0.5 * ((grid[:, None] - z) / bandwidth) ** 2)
        num += w @ np.clip(box.mean_force(q, f, beta), -clip, clip)
        den += w.sum(1)
        force = np.where(den > 1e-12, num / np.maximum(den, 1e-12), 0.0)
        ramp = min(1.0, k / (0.2 * steps))
        along = ramp * np.interp(z, grid, force, 0.0, 0.0) - 50.0 * (np.maximum(z - high, 0) - np.maximum(low - z, 0))
        d, r = box.dimer(q)
        push = (along / (2 * box.width * r))[:, None] * d
        f[:, 0] += push
        f[:, 1] -= push
        q = (q + dt * np.clip(f, -clip, clip) + np.sqrt(2 * dt / beta) * noise.standard_normal(q.shape)) % box.length
        if spec["method"] == "uniform" and k >= spec["start"] and k % int(spec["every"]) == 0:
            z = box.coordinate(q)
            p = np.exp(-0.5 * ((grid[:, None] - z) / (2 * bandwidth)) ** 2).sum(1) + 1e-12
            p = p / ((p.sum() - (p[0] + p[-1]) / 2) * step)
            score = recentred(np.interp(z, grid, np.log(p * (high - low))), 5.0)
            pool, events = replace_configurations(score, spec["rate"], dt * spec["every"], spec["cap"], choice)
            q, ancestor, replaced = q[pool], ancestor[pool], replaced + events
        if k % every == 0:
            z = box.coordinate(q)
            family = np.unique(ancestor, return_counts=True)[1].astype(float)
            pmf = np.concatenate([[0], np.cumsum((force[1:] + force[:-1]) / 2 * step)])
            if not np.isfinite(q).all():
                raise FloatingPointError(f"step {k}")
            rows.append((spec["run_id"], spec["method"], int(spec["seed"]), k, k * dt, float((z < 0.3).mean()), float(((z >= 0.3) & (z <= 0.7)).mean()), float((z > 0.7).mean()), replaced, len(family), float(n * n / (family**2).sum()), float(np.ptp(pmf)), None))
    return rows


def sample(specs: DataFrame, run, row: str) -> DataFrame:
    """Rows of every run of ``specs`` (a row each, with ``run_id``)."""
    names = [f.split()[0] for f in row.split(", ")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(run(pdf.iloc[0].to_dict()), columns=names)

    # Errors end the query here: these rows are inputs of estimators, not results.

    return specs.groupBy("run_id").applyInPandas(one, row)
