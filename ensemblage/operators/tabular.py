"""Tables of repeated runs: summaries over seeds, paired comparisons, series bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, finite_or_null, quantile, reduction_percent, standard_error
from .intervals import within
from .quantiles import exact_quantiles, same
from .scan import decayed_last, previous, running_sums


def config_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Runs per configuration, and median, quartiles, IQR and missing share of metrics.

    Quartiles of all metrics are found together by distributed selection, so that no
    group is gathered; a metric without a finite value has nulls."""
    missing = [F.avg((~finite(F.col(m))).cast("double")).alias(f"{m}_missing") for m in metrics]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *missing)
    found = exact_quantiles(df, keys, metrics, [0.25, 0.5, 0.75])
    by_metric = [F.max(F.when(F.col("metric") == m, F.col("quantiles"))).alias(f"_{m}") for m in metrics]
    out = same(counts, found.groupBy(*keys).agg(*by_metric), keys, "left")
    return out.select(*keys, "n", *[c for m in metrics for c in (*_spread(m, F.col(f"_{m}")), F.col(f"{m}_missing"))])


def _spread(m: str, q: Column) -> list[Column]:
    """Columns from the three quartiles of a metric."""
    return [q[1].alias(f"{m}_median"), q[0].alias(f"{m}_q25"), q[2].alias(f"{m}_q75"), (q[2] - q[0]).alias(f"{m}_iqr")]


def matched_pairs(runs: DataFrame, method: str, baseline: str, match: list[str], metric: str) -> DataFrame:
    """Every method's run beside the baseline's run with the same match keys.

    The baseline's value comes to the others by a window over the match keys: one pass
    and one shuffle.  The baseline has one row a key.
    Columns: method, match keys, ``value``, ``base``.  Null keys never match.
    """
    known = runs.where(F.concat(*[F.col(m).cast("string") for m in match]).isNotNull())
    own, w = F.col(method) == baseline, Window.partitionBy(*match)
    both = known.select(method, *match, F.col(metric).alias("value"), F.max(F.when(own, F.col(metric))).over(w).alias("base"), F.max(own).over(w).alias("_known"))
    return both.where(F.col("_known") & ~own).drop("_known")


def pair_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs, wins, strict win rate and paired gains (percent) of finite pairs with a
    finite baseline; a gain needs a baseline other than 0."""
    ok = pairs.where(finite(F.col("value")) & finite(F.col("base")))
    gain = reduction_percent(F.col("base"), F.col("value"))
    won = (F.col("value") < F.col("base")).cast("double")
    return ok.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.sum(won).cast("long").alias("wins"),
        F.avg(won).alias("win_rate"),
        F.percentile(gain, 0.5).alias("median_gain"),
        F.avg(gain).alias("mean_gain"),
    )


def unpaired_gain(runs: DataFrame, method: str, baseline: str, metric: str) -> DataFrame:
    """1 - median(method) / median(baseline), a fraction."""
    medians = runs.groupBy(method).agg(quantile(F.col(metric), 0.5).alias("median"))
    base = medians.where(F.col(method) == baseline).select(F.col("median").alias("base_median"))
    # One row beside all.
    both = medians.where(F.col(method) != baseline).crossJoin(F.broadcast(base))
    return both.withColumn("gain", F.try_divide(F.col("base_median") - F.col("median"), F.col("base_median")))


def paired_t(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean difference base - value, its standard error and t, degrees of freedom."""
    d = F.col("base") - F.col("value")
    out = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), standard_error(d).alias("se_diff"))
    return out.withColumn("t_stat", F.try_divide("mean_diff", "se_diff")).withColumn("dof", F.col("n") - 1)


def nested_summary(runs: DataFrame, target: str, config: str, metric: str) -> DataFrame:
    """Distribution over configurations of their medians, by target."""
    medians = runs.groupBy(target, config).agg(quantile(F.col(metric), 0.5).alias("m"))
    return medians.groupBy(target).agg(F.count("*").alias("n_configs"), F.min("m").alias("best_median"), F.percentile("m", 0.5).alias("median_of_medians"), F.max("m").alias("worst_median"))


def band_by_position(series: DataFrame, config: list[str], run: str, order: list[Column], value: str) -> DataFrame:
    """Median and quartiles over runs at each position, up to the shortest run."""
    place = F.row_number().over(Window.partitionBy(*config, run).orderBy(*order)) - 1
    placed = series.select(*config, run, F.col(value).alias("v"), place.alias("pos"))
    shortest = placed.groupBy(*config, run).agg(F.count("*").alias("n")).groupBy(*config).agg(F.min("n").alias("least"))
    kept = placed.join(shortest, config).where("pos < least")
    return kept.groupBy(*config, "pos").agg(*_band("v"))


def band_by_time(series: DataFrame, config: list[str], time: str, value: str) -> DataFrame:
    """Median, quartiles and mean over runs at each time."""
    return series.groupBy(*config, time).agg(*_band(value), F.avg(finite_or_null(F.col(value))).alias("mean"))


def _band(value: str) -> list[Column]:
    c = F.col(value)
    return [F.count("*").alias("n"), quantile(c, 0.5).alias("median"), quantile(c, 0.25).alias("q25"), quantile(c, 0.75).alias("q75")]


def profile_mean(profiles: DataFrame, keys: list[str], value: str, total: list[str]) -> DataFrame:
    """Mean of a profile over seeds at each node, and sums of counts, nulls skipped."""
    return profiles.groupBy(*keys).agg(F.avg(finite_or_null(F.col(value))).alias(f"{value}_mean"), *[F.sum(finite_or_null(F.col(t))).alias(f"{t}_sum") for t in total])


def missing_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and for each column the number that are not finite."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(~finite(F.col(c))).alias(f"{c}_missing") for c in columns])


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y on x, and their correlation."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count("*").alias("n"))


def window_aggregates(steps: DataFrame, run: str, step: str, every: int, value: str) -> DataFrame:
    """Mean, extremes and sum of a score in consecutive windows of steps."""
    return steps.groupBy(run, F.floor(F.col(step) / every).alias("window")).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.sum(value).alias("sum"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")
    )


def last_value(df: DataFrame, run: str, order: list[str], values: list[str]) -> DataFrame:
    """Values of each run's last row."""
    return df.groupBy(run).agg(*[F.max_by(v, F.struct(*order)).alias(f"last_{v}") for v in values])


def ancestor_statistics(particles: DataFrame, group: list[str], ancestor: str, truncate: bool = False) -> DataFrame:
    """Distinct ancestors, effective sample size n^2 / sum n_a^2, largest family."""
    families = particles.groupBy(*group, ancestor).agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    ess = F.pow(F.sum(n), F.lit(2.0)) / F.sum(n * n)
    return families.groupBy(*group).agg(
        F.count("*").alias("n_unique"), (F.floor(ess).cast("double") if truncate else ess).alias("ess"), F.max("n").alias("max_multiplicity"), F.sum("n").alias("n_particles")
    )


def strict_crossings(path: DataFrame, run: list[str], order: list[Column], x: Column) -> DataFrame:
    """Steps along each run whose two ends have opposite signs; a point at 0 has none."""
    w = Window.partitionBy(*run).orderBy(*[f"_o{i}" for i in range(len(order))])
    points = path.select(*run, *[c.alias(f"_o{i}") for i, c in enumerate(order)], x.alias("_x")).withColumn("_p", F.lag("_x").over(w))
    return points.groupBy(*run).agg(F.count_if(F.col("_x") * F.col("_p") < 0).alias("crossings"), F.count("*").alias("n_points"))


def crossings(path: DataFrame, run: list[str], order: list[Column], x: Column) -> DataFrame:
    """Sign changes along each run; points at 0 are passed over."""
    signs = path.select(*run, *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.signum(x).alias("s")).where("s <> 0")
    before = F.lag("s").over(Window.partitionBy(*run).orderBy(*[f"_o{i}" for i in range(len(order))]))
    return signs.withColumn("p", before).groupBy(*run).agg(F.count_if(F.col("p") != F.col("s")).alias("crossings"), F.count("*").alias("n_points"))


def ema(path: DataFrame, run: str, order: list[str], value: str, alpha: float, start: float | None = 0.0, blocks: int | None = None) -> DataFrame:
    """Exponential moving average at the end of each run, from ``start`` or, if that
    is None, from the first value.  A long run is cut over several tasks."""
    return decayed_last(path, [run], order, value, 1 - alpha, start, "ema", blocks).withColumn("n", F.col("n").cast("int"))


def cadence_rate(alpha: float, every: int) -> float:
    """Rate of a moving average that is taken at every ``every``-th step only."""
    return 1 - (1 - alpha) ** every


def running_counters(events: DataFrame, run: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """``total_`` columns: counters summed up along each run, which may be cut over
    several tasks; ``since_``: what was added since the row before, from totals again."""
    df = running_sums(events, run, order, {f"total_{c}": F.col(c) for c in counters})
    df = previous(df, run, order, {f"_p_{c}": f"total_{c}" for c in counters})
    return df.withColumns({f"since_{c}": F.col(f"total_{c}") - F.coalesce(F.col(f"_p_{c}"), F.lit(0)) for c in counters}).drop(*[f"_p_{c}" for c in counters])


def extent(x: Column, low: float, high: float) -> Column:
    """compact below ``low``, transition [low, high], stretched above; nowhere else."""
    return F.when(x < low, "compact").when((x >= low) & (x <= high), "transition").when(x > high, "stretched")


def extent_fractions(df: DataFrame, keys: list[str], where: Column) -> DataFrame:
    named = df.withColumn("_r", where)
    return named.groupBy(*keys).agg(*[F.avg((F.col("_r") == r).cast("double")).alias(f"frac_{r}") for r in ("compact", "transition", "stretched")])


def region(x: Column, barrier: float, half: float, low: float, high: float) -> Column:
    """left [low, b-h), barrier [b-h, b+h], right (b+h, high], else outside."""
    return (
        F.when((x >= low) & (x < barrier - half), "left")
        .when((x >= barrier - half) & (x <= barrier + half), "barrier")
        .when((x > barrier + half) & (x <= high), "right")
        .otherwise("outside")
    )


def region_fractions(df: DataFrame, keys: list[str], where: Column) -> DataFrame:
    named = df.withColumn("_r", where)
    return named.groupBy(*keys).agg(*[F.avg((F.col("_r") == r).cast("double")).alias(f"frac_{r}") for r in ("left", "barrier", "right", "outside")])


def conditional_moments(df: DataFrame, bins: DataFrame, x: str, y: str) -> DataFrame:
    """Count, mean, sample variance and mean square of y for particles within
    ``half`` of each bin's ``center`` (closed).

    Particles and bins meet by cells of the bins' own size, whatever their widths.
    Variance is null for fewer than two particles; bins without particles stay with
    count 0."""
    hits = within(df.select(F.col(x).cast("double").alias("_at"), F.col(y).cast("double").alias(y)), F.col("_at"), bins, F.col("center") - F.col("half"), F.col("center") + F.col("half"))
    found = hits.groupBy("center").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_samp(y).alias("variance"), F.avg(F.col(y) * F.col(y)).alias("mean_square"))
    return bins.join(found, "center", "left").select("center", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.when(F.col("n") >= 2, F.col("variance")).alias("variance"), "mean_square")


def conditional_spread(df: DataFrame, bins: DataFrame, x: str, components: list[str]) -> DataFrame:
    """Per half-open bin [low, high): count, mean over the components of their sample
    variances (null below two), and mean of the squared norm."""
    hits = within(df.select(F.col(x).cast("double").alias("_at"), *[F.col(c).cast("double").alias(c) for c in components]), F.col("_at"), bins, F.col("low"), F.col("high"), closed=(True, False))
    norm = sum((F.col(c) * F.col(c) for c in components[1:]), F.col(components[0]) * F.col(components[0]))
    variance = sum((F.var_samp(c) for c in components[1:]), F.var_samp(components[0])) / len(components)
    found = hits.groupBy("low", "high").agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, variance).alias("variance"), F.avg(norm).alias("square_norm"))
    return bins.join(found, ["low", "high"], "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), "variance", "square_norm")
