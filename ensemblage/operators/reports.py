"""Composed summaries of repeated runs: one row a configuration, with spread over seeds,
paired comparison with a baseline, and the reshaping that reports ask for.

The baseline's value is brought beside the runs of its own match keys by a window, so a
table of runs is read once; medians of a group come from one percentile aggregate each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite_or_null, reduction_percent, standard_error, strict_median


def constant_where(df: DataFrame, applies: Column, columns: list[str], value: float = 0.0) -> DataFrame:
    """``value`` in the columns of rows to which they do not apply."""
    return df.withColumns({c: F.when(applies, F.col(c)).otherwise(F.lit(value)) for c in columns})


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Copies of columns under further names: {new: old}."""
    return df.withColumns({new: F.col(old) for new, old in aliases.items()})


def time_window(df: DataFrame, run: list[str], time: str, most: float | None = None) -> DataFrame:
    """Rows up to ``most``, with ``is_last``: the run's last time among all its rows."""
    last = F.max(time).over(Window.partitionBy(*run))
    df = df.withColumn("is_last", F.col(time) == last)
    return df if most is None else df.where((F.col(time) <= most) | F.col("is_last"))


def flattened(df: DataFrame, column: str, prefix: str = "cfg__") -> DataFrame:
    """Fields of a struct as prefixed columns in its place."""
    fields = df.schema[column].dataType.names
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[f].alias(prefix + f) for f in fields])


def with_baseline(runs: DataFrame, cell: list[str], method: str, baseline: str, seed: list[str], value: str) -> DataFrame:
    """``base``: the baseline's value with the same cell and seed, null if there is none."""
    own = F.when(F.col(method) == baseline, F.col(value))
    return runs.withColumn("base", F.max(own).over(Window.partitionBy(*cell, *seed)))


def _quartiles(metric: str) -> Column:
    return F.percentile(finite_or_null(F.col(metric)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def config_report(runs: DataFrame, cell: list[str], method: str, baseline: str, seed: str, value: str, spread: list[str], medians: list[str]) -> DataFrame:
    """Per cell and method: seeds, median and IQR of ``spread``, medians of ``medians``,
    the gain of the method's median over the baseline's (a fraction), and the win rate
    over shared seeds.  The baseline's own gain is 0 and its win rate null; without
    shared seeds both are null."""
    paired = with_baseline(runs, cell, method, baseline, [seed], value)
    shared = F.col("base").isNotNull() & (F.col(method) != baseline)
    aggregates = [F.count("*").alias("n_seeds"), *[_quartiles(m).alias(f"_{m}") for m in spread], *[F.percentile(F.col(m), 0.5).alias(f"med_{m}") for m in medians]]
    out = paired.groupBy(*cell, method).agg(*aggregates, F.avg(F.when(shared, (F.col(value) < F.col("base")).cast("double"))).alias("winrate_vs_base"))
    for m in spread:
        out = out.withColumns({f"med_{m}": F.col(f"_{m}")[1], f"iqr_{m}": F.col(f"_{m}")[2] - F.col(f"_{m}")[0]}).drop(f"_{m}")
    whole = F.max(F.when(F.col(method) == baseline, F.col(f"med_{value}"))).over(Window.partitionBy(*cell))
    gain = F.when(F.col(method) == baseline, 0.0).when(F.col("winrate_vs_base").isNotNull(), F.try_divide(whole - F.col(f"med_{value}"), whole))
    return out.withColumn("gain_vs_base", gain)


def share_report(runs: DataFrame, cell: list[str], method: str, baseline: str, seed: str, value: str, medians: list[str]) -> DataFrame:
    """Per cell and method: seeds, median, IQR and standard error of ``value``, medians
    that are NaN as soon as one value is, win rate and median paired gain in per cent."""
    paired = with_baseline(runs, cell, method, baseline, [seed], value)
    shared = F.col("base").isNotNull() & (F.col(method) != baseline)
    gain = F.when(shared, reduction_percent(F.col("base"), F.col(value)))
    out = paired.groupBy(*cell, method).agg(
        F.count("*").alias("n_seeds"),
        _quartiles(value).alias("_q"),
        standard_error(F.col(value)).alias(f"se_{value}"),
        *[strict_median(F.col(m)).alias(f"med_{m}") for m in medians],
        F.avg(F.when(shared, (F.col(value) < F.col("base")).cast("double"))).alias("winrate_vs_base"),
        F.percentile(gain, 0.5).alias("_gain"),
    )
    return out.select(
        *cell, method, "n_seeds", F.col("_q")[1].alias(f"med_{value}"), (F.col("_q")[2] - F.col("_q")[0]).alias(f"iqr_{value}"), f"se_{value}", *[f"med_{m}" for m in medians],
        "winrate_vs_base", F.when(F.col(method) == baseline, 0.0).otherwise(F.col("_gain")).alias("med_gain_pct_vs_base"),
    )


def rate_report(runs: DataFrame, cell: list[str], method: str, baseline: str, chosen: str, seed: str, value: str, medians: list[str]) -> DataFrame:
    """Per cell, one method beside the baseline: medians of both over shared seeds (of
    the method over all its seeds), gain in per cent, win rate, further medians."""
    paired = with_baseline(runs, cell, method, baseline, [seed], value).where(F.col(method) == chosen)
    gain = reduction_percent(F.col("base"), F.col(value))
    won = F.when(F.col("base").isNotNull(), (F.col(value) < F.col("base")).cast("double"))
    return paired.groupBy(*cell).agg(
        F.count("*").alias("n_seeds"), F.percentile("base", 0.5).alias("med_base"), F.percentile(value, 0.5).alias(f"med_{value}"), F.percentile(gain, 0.5).alias("median_gain_pct"),
        F.avg(won).alias("win_rate"), *[F.percentile(m, 0.5).alias(f"med_{m}") for m in medians],
    )


def leaderboard(runs: DataFrame, name: str, method: str, baseline: str, seed: str, value: str, medians: list[str], constants: list[str] = ()) -> DataFrame:
    """Configurations by falling median paired gain: seeds, wins, gain, medians, and
    constants of the configuration.  Baselines that are not positive give no gain."""
    paired = with_baseline(runs, [], method, baseline, [seed], value).where(F.col(method) != baseline)
    gain = F.when(F.col("base") > 0, reduction_percent(F.col("base"), F.col(value)))
    out = paired.groupBy(name).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) < F.col("base")).alias("wins"), F.percentile(gain, 0.5).alias("med_gain"),
        *[F.percentile(m, 0.5).alias(f"med_{m}") for m in (value, *medians)], *[F.min(c).alias(c) for c in constants],
    )
    return out.orderBy(F.col("med_gain").desc_nulls_last(), name)


def win_table(runs: DataFrame, match: list[str], group: list[str], method: str, baseline: str, seed: str, value: str, also: str) -> DataFrame:
    """Per configuration the pairs matched on all ``match`` keys and the seed: wins, win
    rate, median and mean gain of ``value``, median gain of ``also``."""
    both = with_baseline(runs, match, method, baseline, [seed], value)
    both = both.withColumn("base_also", F.max(F.when(F.col(method) == baseline, F.col(also))).over(Window.partitionBy(*match, seed)))
    both = both.where((F.col(method) != baseline) & F.col("base").isNotNull())
    gain = lambda base, v: F.when(F.col(base) > 0, reduction_percent(F.col(base), F.col(v)))
    won = (F.col(value) < F.col("base")).cast("double")
    return both.groupBy(*group, method).agg(
        F.count("*").alias("n_pairs"), F.sum(won).cast("long").alias("n_wins"), F.avg(won).alias("win_rate"), F.percentile(gain("base", value), 0.5).alias("median_gain_pct"),
        F.avg(gain("base", value)).alias("mean_gain_pct"), F.percentile(gain("base_also", also), 0.5).alias("median_gain_pct_also"),
    )


def conditional_table(rows: DataFrame, keys: list[str], center: str, medians: list[str], references: list[str] = (), count: str | None = None) -> DataFrame:
    """Medians over seeds at each center, missing ones left out, beside references."""
    return rows.groupBy(*keys, center).agg(
        *[F.percentile(finite_or_null(F.col(m)), 0.5).alias(f"med_{m}") for m in medians], *[F.min(r).alias(r) for r in references], *([F.percentile(count, 0.5).alias(f"med_{count}")] if count else [])
    )


def throughput(runs: DataFrame, steps: str, particles: str, configs: str, seconds: str) -> DataFrame:
    """Steps and particle-steps a second, and the speed-up over one configuration."""
    rate = F.try_divide(F.col(steps), F.col(seconds))
    return runs.withColumn("steps_per_second", rate).withColumn("particle_steps_per_second", F.col("steps_per_second") * F.col(particles) * F.col(configs))


def selection_rates(df: DataFrame, births: str, deaths: str, steps: str, dt: float, n: str) -> DataFrame:
    """Births and deaths for each particle and unit of time."""
    span = F.col(steps) * dt * F.col(n)
    return df.withColumns({"birth_rate": F.try_divide(F.col(births), span), "death_rate": F.try_divide(F.col(deaths), span)})


def members_of_best(runs: DataFrame, config: str, rank_by: str, value: str, k: int) -> DataFrame:
    """All runs' ``value`` of the ``k`` configurations of least median ``rank_by``, with
    the configuration's rank.  The k rows are sent to the runs."""
    medians = runs.groupBy(config).agg(F.percentile(finite_or_null(F.col(rank_by)), 0.5).alias("_m"))
    best = medians.orderBy(F.col("_m").asc_nulls_last(), config).limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_m").asc_nulls_last(), config))).drop("_m")
    return runs.join(F.broadcast(best), config).select(config, "rank", value)


def run_status(specs: DataFrame, done: DataFrame, failed: DataFrame, key: str = "run_id") -> DataFrame:
    """Every spec with ``status``: done, failed or waiting; a run that failed first and
    was done later is done.  ``error`` is that of failed runs."""
    marks = done.select(key, F.lit(True).alias("_done")).distinct()
    errors = failed.groupBy(key).agg(F.max("error").alias("error"))
    df = specs.join(marks, key, "left").join(errors, key, "left")
    status = F.when(F.col("_done"), "done").when(F.col("error").isNotNull(), "failed").otherwise("waiting")
    return df.withColumn("status", status).withColumn("error", F.when(F.col("status") == "failed", F.col("error"))).drop("_done")


def stage_directory(stage: Column, root: str, shared: dict[str, str]) -> Column:
    """Folder of a stage; some stages share another one's."""
    name = stage
    for alias, of in shared.items():
        name = F.when(stage == alias, of).otherwise(name)
    return F.concat(F.lit(root.rstrip("/") + "/"), name)


def dry_run(specs: DataFrame, done: DataFrame, key: str, folder: Column) -> DataFrame:
    """What a start would run, and where it would write; nothing is run."""
    return specs.join(done.select(key).distinct(), key, "left_anti").select(key, F.concat(folder, F.lit("/"), F.col(key).cast("string")).alias("path"))


