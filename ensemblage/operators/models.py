"""Model potentials as column builders, and their exact one-dimensional profiles.

A potential is registered by name with builders for its value and derivatives, each
taking columns; whatever is built stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grid import cumulative_trapezoid, grid, trapezoid

E = F.exp


@dataclass(frozen=True)
class Potential:
    value: Callable[..., Column]
    dx: Callable[..., Column]
    dy: Callable[..., Column] | None = None


POTENTIALS: dict[str, Potential] = {}


def register_potential(name: str, value, dx, dy=None) -> None:
    POTENTIALS[name] = Potential(value, dx, dy)


def _wells(x, y):
    a, b = E(-x * x), E(-y * y)
    third, upper = y - 1 / 3, y - 5 / 3
    return a, b, third, upper, E(-third * third), E(-upper * upper), E(-(x - 1) * (x - 1)), E(-(x + 1) * (x + 1))


def _v(x, y):
    a, b, third, _, g, h, right, left = _wells(x, y)
    return 3 * a * (g - h) - 5 * b * (right + left) + 0.2 * F.pow(x, F.lit(4.0)) + 0.2 * F.pow(third, F.lit(4.0))


def _v_dx(x, y):
    a, b, _, _, g, h, right, left = _wells(x, y)
    return -6 * x * a * (g - h) + 10 * b * ((x - 1) * right + (x + 1) * left) + 0.8 * x * x * x


def _v_dy(x, y):
    a, b, third, upper, g, h, right, left = _wells(x, y)
    return -6 * a * (third * g - upper * h) + 10 * y * b * (right + left) + 0.8 * third * third * third


register_potential("two_channel", _v, _v_dx, _v_dy)


def _ring(x, y):
    """Terms of a potential with a ring of wells."""
    return 1 - x * x - y * y, x * x - 2, (x + y) * (x + y) - 1, (x - y) * (x - y) - 1


def _ring_v(x, y):
    a, b, c, d = _ring(x, y)
    return (4 * a * a + 2 * b * b + c * c + d * d) / 6


def _ring_dx(x, y):
    a, b, c, d = _ring(x, y)
    return (8 * x * (b - 2 * a) + 4 * c * (x + y) + 4 * d * (x - y)) / 6


def _ring_dy(x, y):
    a, _, c, d = _ring(x, y)
    return (-16 * y * a + 4 * c * (x + y) - 4 * d * (x - y)) / 6


register_potential("ring", _ring_v, _ring_dx, _ring_dy)
#: The triple well is the two-channel surface, usually taken with y from -5 to 5.
register_potential("triple_well", _v, _v_dx, _v_dy)
register_potential("double_well", lambda x: (x * x - 1) * (x * x - 1), lambda x: 4 * x * (x * x - 1))


@dataclass(frozen=True)
class Channel:
    """Double well of height H whose m transverse modes stiffen from ``omega_out`` to
    ``omega_in`` near x = 0: the entropic part of the barrier is m log(in/out) / beta."""

    height: float = 1.0
    omega_in: float = 4.0
    omega_out: float = 1.0
    spread: float = 0.3
    beta: float = 4.0
    m: int = 1

    @classmethod
    def from_share(cls, phi: float, barrier: float, beta: float, omega_out: float, m: int, spread: float = 0.3) -> Channel:
        """The share ``phi`` of a total barrier (in 1/beta) is entropic."""
        import math

        return cls((1 - phi) * barrier / beta, omega_out * math.exp(phi * barrier / m), omega_out, spread, beta, m)

    def omega(self, x: Column) -> Column:
        return self.omega_out + (self.omega_in - self.omega_out) * E(-x * x / (2 * self.spread**2))

    def energy(self, x: Column) -> Column:
        return self.height * (x * x - 1) * (x * x - 1)

    def free_energy(self, x: Column) -> Column:
        return self.energy(x) + self.m / self.beta * F.log(self.omega(x))

    def mean_force(self, x: Column) -> Column:
        slope = -(self.omega_in - self.omega_out) * x / self.spread**2 * E(-x * x / (2 * self.spread**2))
        return 4 * self.height * x * (x * x - 1) + self.m / self.beta * slope / self.omega(x)


def reference_profile(spark: SparkSession, potential: str = "two_channel", beta: float = 4.0, x=(-3.0, 3.0, 401), y=(-2.5, 3.5, 801)) -> DataFrame:
    """Exact profile by quadrature over y: F (mean 0 over the grid), F', density p.

    Every x has its own smallest exponent taken out before the exponentials are
    summed, so no term overflows.  (j, x, F, Fprime, p)"""
    v = POTENTIALS[potential]
    nx, ny = grid(spark, *x), grid(spark, *y).select(F.col("j").alias("k"), F.col("x").alias("y"))
    step = (y[1] - y[0]) / (y[2] - 1)
    both = nx.crossJoin(F.broadcast(ny)).withColumns({"v": v.value(F.col("x"), F.col("y")), "f": v.dx(F.col("x"), F.col("y"))})
    least = F.min("v").over(Window.partitionBy("j"))
    end = F.when((F.col("k") == 0) | (F.col("k") == y[2] - 1), 0.5).otherwise(1.0) * step
    w = both.withColumn("least", least).withColumn("w", end * E(-beta * (F.col("v") - F.col("least"))))
    rows = w.groupBy("j", "x").agg((F.max("least") - F.log(F.sum("w")) / beta).alias("F"), (F.sum(F.col("w") * F.col("f")) / F.sum("w")).alias("Fprime"))
    mean = rows.agg(F.avg("F").alias("_m"))
    rows = rows.crossJoin(F.broadcast(mean)).withColumn("F", F.col("F") - F.col("_m")).withColumn("p", E(-beta * F.col("F"))).drop("_m")
    total = trapezoid(rows.withColumn("run", F.lit(0)), ["run"], "x", "p", "_t").drop("run")
    return rows.crossJoin(F.broadcast(total)).withColumn("p", F.col("p") / F.col("_t")).drop("_t")


def conditional_density(at: DataFrame, potential: str = "two_channel", beta: float = 4.0, y=(-2.5, 3.5, 801)) -> DataFrame:
    """p(y | x0) at the nodes of y for each row's ``x0``, which are distinct."""
    v = POTENTIALS[potential]
    df = at.select("x0").crossJoin(F.broadcast(grid(at.sparkSession, *y).withColumnRenamed("x", "y")))
    value = v.value(F.col("x0"), F.col("y"))
    df = df.withColumn("v", value).withColumn("p", E(-beta * (F.col("v") - F.min("v").over(Window.partitionBy("x0")))))
    return df.join(trapezoid(df, ["x0"], "y", "p", "_t"), "x0").select("x0", "j", "y", (F.col("p") / F.col("_t")).alias("p"))


def boltzmann_grid(spark: SparkSession, potential: str = "two_channel", beta: float = 4.0, x=(-3.0, 3.0, 61), y=(-2.5, 3.5, 61)) -> DataFrame:
    """Density on an x-y grid, of double trapezoid integral 1."""
    v = POTENTIALS[potential]
    ny = grid(spark, *y).select(F.col("j").alias("k"), F.col("x").alias("y"))
    both = grid(spark, *x).crossJoin(F.broadcast(ny)).withColumn("v", v.value(F.col("x"), F.col("y")))

    def end(c, n):
        return F.when((F.col(c) == 0) | (F.col(c) == n - 1), 0.5).otherwise(1.0)

    cell = (x[1] - x[0]) / (x[2] - 1) * (y[1] - y[0]) / (y[2] - 1)
    least = both.agg(F.min("v").alias("_least"))
    both = both.crossJoin(F.broadcast(least)).withColumn("p", E(-beta * (F.col("v") - F.col("_least"))))
    total = both.agg(F.sum(F.col("p") * end("j", x[2]) * end("k", y[2]) * cell).alias("_t"))
    return both.crossJoin(F.broadcast(total)).select("j", "k", "x", "y", "v", (F.col("p") / F.col("_t")).alias("p"))


def free_energy_of_density(p: Column, beta: float, eps: float = 1e-12) -> Column:
    return -F.log(F.greatest(p, F.lit(eps))) / beta


def free_energy_of_mean_force(profile: DataFrame, run: list[str], x: str, force: str, out: str = "F") -> DataFrame:
    """Thermodynamic integration of a mean force along x, from 0."""
    return cumulative_trapezoid(profile, run, x, force, out)


def gradient_check(points: DataFrame, potential: str, x: str = "x", y: str = "y", h: float = 1e-5) -> DataFrame:
    """One row: largest deviation of the gradient from central differences."""
    v = POTENTIALS[potential]
    cx, cy = F.col(x), F.col(y)
    dx = (v.value(cx + h, cy) - v.value(cx - h, cy)) / (2 * h)
    dy = (v.value(cx, cy + h) - v.value(cx, cy - h)) / (2 * h)
    return points.agg(F.count("*").alias("n"), F.max(F.abs(v.dx(cx, cy) - dx)).alias("dx_off"), F.max(F.abs(v.dy(cx, cy) - dy)).alias("dy_off"))


def knobs(df: DataFrame, phi: str, barrier: float, beta: float, omega_out: float, m: int) -> DataFrame:
    """Height and inner frequency for a share ``phi`` of entropy in a barrier (in 1/beta),
    and the two parts of the free-energy difference that they give."""
    share = F.col(phi)
    df = df.withColumns({"height": (1 - share) * barrier / beta, "omega_in": omega_out * E(share * barrier / m)})
    return df.withColumns({"df_energetic": F.col("height"), "df_entropic": m / beta * F.log(F.col("omega_in") / omega_out)})
