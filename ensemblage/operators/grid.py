"""Functions on uniform grids, one row a node: bins, integrals, smoothing, errors.

Profiles are rows (run, j, x, value).  All windows are partitioned by the run, so a
plan is spread over runs; what is crossed with rows is a grid or a kernel, whose size
is set by the caller and not by the data, and is sent to every task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .gauss import moments, sums_at
from .intervals import within
from .scan import decayed_last

EPS = 1e-12


def _w(run: list[str], x: str) -> WindowSpec:
    return Window.partitionBy(*run).orderBy(x)


def grid(spark, low: float, high: float, n: int) -> DataFrame:
    """Nodes (j, x) of a closed uniform grid."""
    return spark.range(n).select(F.col("id").cast("int").alias("j"), (F.lit(float(low)) + F.col("id") * ((high - low) / (n - 1))).alias("x"))


# ---------------------------------------------------------------------- bins


def nearest_bin(x: Column, low: float, step: float, n: int) -> Column:
    """Nearest node, halves to the even one, clamped to the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((x - low) / step).cast("int")))


def floor_bin(x: Column, low: float, step: float, n: int) -> Column:
    """Bin of half-open intervals, -1 outside."""
    j = F.floor((x - low) / step).cast("int")
    return F.when((j >= 0) & (j < n), j).otherwise(-1)


def closed_right_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin of [low, high] with the last bin closed, null outside."""
    return F.when(x == high, n - 1).when((x >= low) & (x < high), F.least(F.floor((x - low) / ((high - low) / n)).cast("int"), F.lit(n - 1)))


def midpoint_bin(x: Column, low: float, high: float, n: int) -> tuple[Column, Column]:
    """Bin of [low, high] and its middle; null outside."""
    width = (high - low) / n
    j = F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / width).cast("int"), F.lit(n - 1)))
    return j, low + (j + 0.5) * width


def histogram(df: DataFrame, keys: list[str], x: str, low: float, high: float, n: int) -> DataFrame:
    """Counts in each bin that has any."""
    return df.withColumn("bin", closed_right_bin(F.col(x), low, high, n)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def scatter_add(df: DataFrame, keys: list[str], j: Column, value: str, n: int) -> DataFrame:
    """Count and sum of a value at every node of every group, 0 where there is none.

    The dense grid is exploded from the groups that exist; it meets sums, not rows."""
    sums = df.withColumn("j", j).groupBy(*keys, "j").agg(F.count("*").alias("hits"), F.sum(value).alias("total"))
    dense = sums.select(*keys).distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if keys else df.sparkSession.range(n).select(F.col("id").cast("int").alias("j"))
    return dense.join(sums, [*keys, "j"], "left").select(*keys, "j", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("total", F.lit(0.0)).alias("total"))


# ------------------------------------------------------------------ integrals


def cumulative_trapezoid(df: DataFrame, run: list[str], x: str, y: str, out: str = "cumulative") -> DataFrame:
    """Running trapezoid sum from 0 at the first node."""
    w = _w(run, x)
    piece = F.coalesce((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    return df.withColumn("_p", piece).withColumn(out, F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p")


def cumulative_riemann(df: DataFrame, run: list[str], x: str, y: str, step: float, left: bool = False, out: str = "cumulative") -> DataFrame:
    """Running sum of y times step; the left rule leaves the node's own value out."""
    frame = _w(run, x).rowsBetween(Window.unboundedPreceding, -1 if left else 0)
    return df.withColumn(out, F.coalesce(F.sum(y).over(frame), F.lit(0.0)) * step)


def cumulative_midpoint(df: DataFrame, run: list[str], x: str, y: str, step: float, out: str = "cumulative") -> DataFrame:
    """Integral up to each bin's middle: all bins before it and half of its own."""
    before = F.sum(y).over(_w(run, x).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, (F.coalesce(before, F.lit(0.0)) + F.col(y) / 2) * step)


def trapezoid(df: DataFrame, run: list[str], x: str, y: str, out: str = "integral") -> DataFrame:
    """Trapezoid integral of each run over its finite points; null below two."""
    w = _w(run, x)
    ok = df.where(F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(y) < math.inf))
    pieces = ok.withColumn("_p", (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)))
    return pieces.groupBy(*run).agg(F.when(F.count("*") >= 2, F.sum("_p")).alias(out))


def normalised(df: DataFrame, run: list[str], x: str, y: str, eps: float = EPS, again: bool = False) -> DataFrame:
    """y, at least eps, over its trapezoid integral; ``again``: clamped and divided a
    second time, so that the clamp holds of the density."""
    if again:
        df = normalised(df, run, x, y, eps)
    df = df.withColumn(y, F.greatest(F.col(y), F.lit(eps)))
    total = trapezoid(df, run, x, y, "_total")
    return (df.join(total, run) if run else df.crossJoin(F.broadcast(total))).withColumn(y, F.col(y) / F.col("_total")).drop("_total")


def finite_difference(df: DataFrame, run: list[str], x: str, y: str, out: str = "slope") -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = _w(run, x)
    after, before = F.lead(y).over(w), F.lag(y).over(w)
    rise = F.coalesce(after, F.col(y)) - F.coalesce(before, F.col(y))
    over = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    return df.withColumn(out, F.try_divide(rise, over))


def relative_curvature(df: DataFrame, run: list[str], x: str, y: str, step: float, out: str = "curvature") -> DataFrame:
    """Second difference over the value and the square of the step; 0 at the two ends
    and where the value is 0."""
    w = _w(run, x)
    second = F.lead(y).over(w) - 2 * F.col(y) + F.lag(y).over(w)
    return df.withColumn(out, F.coalesce(F.try_divide(second, F.col(y) * step * step), F.lit(0.0)))


# --------------------------------------------------------------------- gauges


def gauge_fix(df: DataFrame, run: list[str], x: str, y: str, at: float) -> DataFrame:
    """Subtract the value at the node nearest to ``at``, the first among equals."""
    near = df.groupBy(*run).agg(F.min_by(y, F.struct(F.abs(F.col(x) - at), F.col(x))).alias("_g"))
    return df.join(near, run).withColumn(y, F.col(y) - F.col("_g")).drop("_g")


def centred(df: DataFrame, run: list[str], y: str, mask: Column) -> DataFrame:
    """Subtract the mean over the mask."""
    return df.withColumn(y, F.col(y) - F.avg(F.when(mask, F.col(y))).over(Window.partitionBy(*run)))


def aligned(df: DataFrame, run: list[str], y: str, reference: str, mask: Column) -> DataFrame:
    """Shift y by its mean difference from the reference over the mask."""
    return df.withColumn(y, F.col(y) - F.avg(F.when(mask, F.col(y) - F.col(reference))).over(Window.partitionBy(*run)))


# ------------------------------------------------------------------ smoothing


def gaussian_offsets(width: float, step: float, cut: float = 4.0, unit: str = "integral") -> list[tuple[int, float]]:
    """Kernel (offset, weight) cut at ``cut`` widths.  Two flavours that must not be mixed
    up: weights times step sum to 1 for unit ``integral``, whose radius is the nearest
    number of steps; weights alone sum to 1 for unit ``sum``, whose radius covers the cut."""
    reach = cut * width / step
    radius = max(1, round(reach) if unit == "integral" else math.ceil(reach))
    weights = [math.exp(-0.5 * (k * step / width) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights) * (step if unit == "integral" else 1.0)
    return [(k, w / total) for k, w in zip(range(-radius, radius + 1), weights)]


def smooth(df: DataFrame, run: list[str], y: str, n: int, kernel: list[tuple[int, float]], edge: str = "reflect") -> DataFrame:
    """Convolve y(j) with a kernel; beyond the ends the profile is reflected (the end
    node is not repeated) or its end value goes on (``replicate``).

    A profile is one array while it is convolved: no node is paired by a join."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(y).alias("v")))), lambda s: s["v"])
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel])

    def place(i: Column) -> Column:
        if edge == "replicate":
            return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
        m = F.pmod(i, F.lit(2 * (n - 1)))
        return F.least(m, 2 * (n - 1) - m)

    def at(values):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.aggregate(offsets, F.lit(0.0), lambda t, o: t + o["w"] * F.get(values, place(j + o["k"]))))

    smoothed = df.groupBy(*run).agg(a.alias("_a")) if run else df.agg(a.alias("_a"))
    out = smoothed.select(*run, F.posexplode(F.transform(F.array("_a"), at)[0]).alias("j", y))
    return out.select(*run, F.col("j").cast("int").alias("j"), y)


def reflected_images(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """Each particle with its images beyond both ends."""
    return df.withColumn(x, F.explode(F.array(2 * low - F.col(x), F.col(x).cast("double"), 2 * high - F.col(x))))


def gaussian(u: Column, width: float) -> Column:
    """Kernel of unit mass."""
    return F.exp(-0.5 * (u / width) * (u / width)) / (width * math.sqrt(2 * math.pi))


def kernel_density(particles: DataFrame, nodes: DataFrame, x: str, width: float, low: float, high: float, eps: float = EPS) -> DataFrame:
    """Density at each node, by Gaussians about the particles and their images beyond
    both ends, by a fast Gauss transform.

    A particle's image is as far from a node as the node's image from the particle, so
    one set of moments serves a node and its two images."""
    own = particles.where(F.col(x).isNotNull())
    found = moments(own, [], x, {"_mass": F.lit(1.0)}, width)
    total = own.agg(F.count("*").alias("_n"))
    images = nodes.select("j", "x", F.explode(F.array(F.col("x").cast("double"), 2 * low - F.col("x"), 2 * high - F.col("x"))).alias("_at"))
    sums = sums_at(images, F.col("_at"), found, [], ["_mass"], width).groupBy("j", "x").agg(F.sum("_mass").alias("_mass"))
    # One row beside all.
    density = F.col("_mass") / (F.col("_n") * (width * math.sqrt(2 * math.pi)))
    return sums.crossJoin(F.broadcast(total)).where("_n > 0").select("j", "x", F.greatest(density, F.lit(eps)).alias("density"))


def _weighted_sums(particles: DataFrame, nodes: DataFrame, x: str, value: str, width: float) -> DataFrame:
    """(j, x, num, den): sums of kernel times value and of the kernel at each node."""
    own = particles.where(F.col(x).isNotNull() & F.col(value).isNotNull())
    found = moments(own, [], x, {"num": F.col(value), "den": F.lit(1.0)}, width)
    norm = width * math.sqrt(2 * math.pi)
    return sums_at(nodes.select("j", "x"), F.col("x"), found, [], ["num", "den"], width).select("j", "x", (F.col("num") / norm).alias("num"), (F.col("den") / norm).alias("den"))


def kernel_regression(particles: DataFrame, nodes: DataFrame, x: str, value: str, width: float, min_count: float = 0.0, eps: float = EPS) -> DataFrame:
    """Weighted mean sum(w v) / (sum(w) + min_count + eps) at each node, by a fast Gauss
    transform; particles without a value are passed over."""
    sums = _weighted_sums(particles, nodes, x, value, width)
    return sums.select("j", "x", (F.col("num") / (F.col("den") + min_count + eps)).alias("estimate"), F.col("den").alias("mass"))


def binned_mean(sums: DataFrame, least: float = 0.0) -> DataFrame:
    """Mean of scatter-added sums, 0 for empty bins; ``least`` hits at least divide."""
    return sums.withColumn("mean", F.coalesce(F.try_divide(F.col("total"), F.greatest(F.col("hits").cast("double"), F.lit(least))), F.lit(0.0)))


def smoothed_density(df: DataFrame, run: list[str], x: str, low: float, step: float, n: int, width: float, eps: float = EPS) -> DataFrame:
    """Density (run, j, x, p): particles scattered to their nearest nodes, smoothed with
    reflected ends, normalised and clamped.  The work is that of the grid, not of
    particles times nodes."""
    hits = scatter_add(df.withColumn("_one", F.lit(1.0)), run, nearest_bin(F.col(x), low, step, n), "_one", n)
    flat = smooth(hits, run, "total", n, gaussian_offsets(width, step)).withColumnRenamed("total", "p").withColumn("x", low + F.col("j") * step)
    return normalised(flat, run, "x", "p", eps).withColumn("p", F.greatest("p", F.lit(eps)))


def smoothed_force(df: DataFrame, run: list[str], x: str, value: str, low: float, step: float, n: int, width: float, min_count: float = 0.0, eps: float = EPS) -> DataFrame:
    """Mean of a value at each node (run, j, x, estimate): smoothed sums over smoothed
    counts, which ``min_count`` is added to."""
    sums = scatter_add(df, run, nearest_bin(F.col(x), low, step, n), value, n).withColumn("hits", F.col("hits").cast("double"))
    kernel = gaussian_offsets(width, step)
    both = smooth(sums, run, "total", n, kernel).join(smooth(sums, run, "hits", n, kernel), [*run, "j"])
    return both.select(*run, "j", (low + F.col("j") * step).alias("x"), (F.col("total") / (F.col("hits") + min_count + eps)).alias("estimate"))


def kernel_estimate(particles: DataFrame, nodes: DataFrame, x: str, value: str, width: float, smoothing: list[tuple[int, float]], n: int, eps: float = EPS) -> DataFrame:
    """Weighted mean at each node without a least count, 0 where there is no weight,
    then smoothed with its end values going on."""
    sums = _weighted_sums(particles, nodes, x, value, width)
    raw = sums.select("j", F.when(F.col("den") > eps, F.col("num") / F.col("den")).otherwise(0.0).alias("estimate"))
    return smooth(raw, [], "estimate", n, smoothing, "replicate")


def ema_profiles(df: DataFrame, run: list[str], step: str, node: str, y: str, alpha: float, at: float | None = None, out: str = "ema") -> DataFrame:
    """Moving average of profiles over their steps, from the first one on; ``at``: with
    the value 0 at the node nearest to it.  Taking a constant out at every step shifts
    the average by a constant, so it is taken out once."""
    folded = decayed_last(df, [*run, node], [step], y, 1 - alpha, None, out).drop("n")
    return folded if at is None else gauge_fix(folded, run, node, out, at)


def interpolate(points: DataFrame, profile: DataFrame, x: str, low: float, step: float, n: int, y: str, outside: float | None = None) -> DataFrame:
    """Linear interpolation of a profile (j, y) at points; clamped at the ends, or a
    constant outside.  The profile travels as one array beside the points."""
    values = profile.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(y).alias("v")))), lambda s: s["v"]).alias("_v"))
    t = (F.col(x) - low) / step
    i = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor(t).cast("int")))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t - i))
    value = F.get("_v", i) * (1 - f) + F.get("_v", i + 1) * f
    if outside is not None:
        value = F.when((t < 0) | (t > n - 1), outside).otherwise(value)
    return points.crossJoin(F.broadcast(values)).withColumn(y, value).drop("_v")


# ------------------------------------------------------------------- geometry


def reflect(x: Column, low: float, high: float) -> Column:
    """Fold into [low, high] by reflections at both walls."""
    width = high - low
    m = F.pmod(x - low, F.lit(2.0 * width))
    return low + F.least(m, 2 * width - m)


def wrap(x: Column, length: float) -> Column:
    return F.pmod(x, F.lit(float(length)))


def minimum_image(d: Column, length: float) -> Column:
    return d - length * F.rint(d / length)


def clip_norm(components: list[Column], most: float) -> list[Column]:
    """Scale a vector down to norm ``most`` where it is longer."""
    norm = F.sqrt(sum((c * c for c in components[1:]), components[0] * components[0]))
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(norm, F.lit(EPS)))
    return [c * scale for c in components]


# --------------------------------------------------------------------- errors


def profile_errors(df: DataFrame, run: list[str], x: str, y: str, reference: str, mask: Column) -> DataFrame:
    """Three L2 errors that must not be mixed up, over the nodes of the mask:

    ``l2_centred``  both centred, squares integrated by trapezoids, over the width;
    ``l2_plain``    root of the plain mean of squares;
    ``l2_aligned``  shifted by the mean difference, then like the first.
    Null below two nodes (below one for the plain one)."""
    inside = df.where(mask).select(*run, x, F.col(y).alias("_y"), F.col(reference).alias("_r"))
    part = Window.partitionBy(*run)
    d = inside.withColumn("_d", F.col("_y") - F.col("_r")).withColumn("_c", F.col("_y") - F.avg("_y").over(part) - (F.col("_r") - F.avg("_r").over(part))).withColumn("_a", F.col("_d") - F.avg("_d").over(part))
    w = _w(run, x)
    step = F.col(x) - F.lag(x).over(w)

    def piece(c):
        return (F.col(c) * F.col(c) + F.lag(c).over(w) * F.lag(c).over(w)) / 2 * step

    pieces = d.withColumns({"_pc": piece("_c"), "_pa": piece("_a")})
    width = F.max(x) - F.min(x)
    return pieces.groupBy(*run).agg(
        F.sqrt(F.try_divide(F.sum("_pc"), width)).alias("l2_centred"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("l2_plain"), F.sqrt(F.try_divide(F.sum("_pa"), width)).alias("l2_aligned")
    )


def errors_by_region(df: DataFrame, run: list[str], x: str, y: str, reference: str, region: Column, inside: Column) -> DataFrame:
    """Root of the squared difference integrated over each region's nodes inside the
    window, by its width: (run, region, l2).  Null below two nodes."""
    own = df.withColumn("region", region).where(inside & F.col("region").isNotNull()).withColumn("_d", F.col(y) - F.col(reference))
    keys = [*run, "region"]
    squares = own.withColumn("_d", F.col("_d") * F.col("_d"))
    total = trapezoid(squares, keys, x, "_d", "_t")
    return squares.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("_w")).join(total, keys).select(*keys, F.sqrt(F.try_divide("_t", "_w")).alias("l2"))


def marginal_error(df: DataFrame, run: list[str], x: str, p: str, inside: Column, target: str | None = None, eps: float = 1e-300) -> DataFrame:
    """L2 distance of a density from the uniform one, or from a target density, both
    renormalised on the window, over its width: (run, l2)."""
    own = df.where(inside)

    def unit(frame, c):
        total = trapezoid(frame, run, x, c, "_t")
        return frame.join(total, run).withColumn(c, F.col(c) / F.greatest("_t", F.lit(eps))).drop("_t")

    own = unit(own, p)
    own = unit(own, target) if target else own
    part = Window.partitionBy(*run)
    other = F.col(target) if target else 1 / (F.max(x).over(part) - F.min(x).over(part))
    squares = own.withColumn("_d", F.col(p) - other).withColumn("_d", F.col("_d") * F.col("_d"))
    width = squares.groupBy(*run).agg((F.max(x) - F.min(x)).alias("_w"))
    return trapezoid(squares, run, x, "_d", "_t").join(width, run).select(*run, F.sqrt(F.try_divide("_t", "_w")).alias("l2"))


def conditional_divergence(df: DataFrame, bins: DataFrame, x: str, y: str, reference: Column, low: float, high: float, n: int, least: int = 10, eps: float = EPS) -> DataFrame:
    """L2 and KL divergence of y's histogram density, among particles near each bin
    center, from a reference density at the histogram's midpoints (column ``mid``).

    Null for bins with fewer than ``least`` particles."""
    step = (high - low) / n
    hits = within(df.select(F.col(x).alias("_at"), closed_right_bin(F.col(y), low, high, n).alias("k")), F.col("_at"), bins, F.col("center") - F.col("half"), F.col("center") + F.col("half"))
    counts = hits.groupBy("center", "k").agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy("center")))
    total = counts.groupBy("center").agg(F.max("_all").alias("n_in_bin"), F.sum(F.when(F.col("k").isNotNull(), F.col("n"))).alias("n_kept"))
    dense = bins.select("center").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("mid", F.lit(low) + (F.col("k") + 0.5) * step)
    p = F.coalesce(F.col("n"), F.lit(0)) / (F.col("n_kept") * step)
    df = dense.join(counts.where("k is not null").drop("_all"), ["center", "k"], "left").join(total, "center").withColumn("p", p).withColumn("r", reference)
    out = df.groupBy("center").agg(
        F.max("n_in_bin").alias("n_in_bin"),
        F.sqrt(F.sum((F.col("p") - F.col("r")) * (F.col("p") - F.col("r")) * step)).alias("l2"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.greatest("r", F.lit(eps))) * step)).alias("kl"),
    )
    enough = F.col("n_in_bin") >= least
    return out.select("center", "n_in_bin", F.when(enough, F.col("l2")).alias("l2"), F.when(enough, F.col("kl")).alias("kl"))
