"""Queries of sources, streams and simulations: rows, invariants and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions.shared import scratch
from ..operators import estimators, grid, sampled_systems, simulate
from ..streaming import lineage
from . import orchestration
from .tabular_queries import rounded, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def run_stream(stream, mode: str, spark):
    """Run a stream over what is there now and return its output as a table.

    Batches are written to the shared folder as they come, by number, so a batch that is
    run again replaces its rows.  In update mode a key's last batch counts."""
    place = scratch(spark)

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{place}/rows")
    return out


def last_update(rows, keys: list[str]):
    """The newest row of each key of a stream's updates."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_r")).select(*keys, "_r.*")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_window_count(spark, d):
    stream = streaming.event_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    out = run_stream(streaming.window_counts(stream), "append", spark)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda t, x: t * 0.9::DOUBLE + 0.1::DOUBLE * x), 6) AS ema, len(v)::BIGINT AS n FROM a""")
def stream_running_ema(spark, d):
    stream = streaming.event_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    return rounded(last_update(run_stream(streaming.running_ema(stream), "update", spark), ["user_id"]))


_FIXED = (("beta", "double", 4.0), ("n", "long", 200), ("steps", "long", 1000), ("dt", "double", 0.01), ("rate", "double", 1.0), ("every", "long", 10), ("start", "long", 200), ("cap", "double", 0.1))


def _specs(spark, axes):
    names = list(axes)
    values = [F.lit(v).cast(k).alias(n) for n, k, v in _FIXED]
    return orchestration.expand_grid(spark, axes).select(orchestration.config_id(names).alias("run_id"), *[F.col(n).cast("long").alias(n) if n == "seed" else n for n in names], *values)


@query()
def simulate_methods(spark, d):
    return rounded(simulate.simulate(_specs(spark, {"method": ["abf", "uniform", "estimated", "oracle", "self"], "seed": [0, 1, 2]})))


@query()
def simulate_resamplers(spark, d):
    return rounded(simulate.simulate(_specs(spark, {"method": ["uniform"], "resampler": list(simulate.RESAMPLERS), "seed": [0, 1]})))


@query()
def simulate_surface(spark, d):
    return rounded(simulate.simulate(_specs(spark, {"method": ["abf", "estimated"], "model": ["surface"], "init": ["well", "uniform", "left", "right", "mixed"], "seed": [0]})))


@query()
def simulate_dimer(spark, d):
    specs = orchestration.expand_grid(spark, {"method": ["abf", "uniform"], "seed": [0, 1]})
    specs = specs.select(orchestration.config_id(["method", "seed"]).alias("run_id"), "*").withColumns({"beta": F.lit(1.0), "side": F.lit(3), "spacing": F.lit(1.4), "n": F.lit(64), "steps": F.lit(400), "dt": F.lit(0.0005), "rate": F.lit(5.0), "start": F.lit(100), "every": F.lit(10), "cap": F.lit(0.1)})
    return rounded(sampled_systems.sample(specs, sampled_systems.dimer_run, sampled_systems.DIMER_ROW))


@query()
def simulate_extended(spark, d):
    specs = orchestration.expand_grid(spark, {"seed": [0, 1, 2]}).select(orchestration.config_id(["seed"]).alias("run_id"), "seed")
    specs = specs.withColumns({"beta": F.lit(4.0), "n": F.lit(100), "steps": F.lit(1000), "dt": F.lit(0.005), "stiffness": F.lit(50.0)})
    rows = sampled_systems.sample(specs, sampled_systems.extended_run, sampled_systems.EXTENDED_ROW)
    return rounded(estimators.czar(rows.where("hits > 0"), ["run_id"], "z", "density", "mean_lambda", 4.0, 50.0))


@query()
def simulate_constrained_profile(spark, d):
    specs = orchestration.expand_grid(spark, {"home": list(range(13))}).select(F.col("home").cast("string").alias("run_id"), "home", F.col("home").alias("seed"), (-1.2 + 0.2 * F.col("home")).alias("center"))
    specs = specs.withColumns({"kind": F.lit("constrained"), "beta": F.lit(4.0), "n": F.lit(100), "steps": F.lit(500), "dt": F.lit(0.02), "every": F.lit(20), "dynamics": F.lit("langevin")})
    rows = sampled_systems.sample(specs, sampled_systems.fixed_run, sampled_systems.SAMPLE_ROW).where("step > 100")
    points = spark.range(49).select((-1.2 + 0.05 * F.col("id")).alias("x0"))
    return rounded(estimators.integrated_profile(rows, "x", "force", 0.2, 13, grid.gaussian_offsets(0.1, 0.2, unit="sum"), points, "x0", 0.0, -1.2))


@query("SELECT p_partkey, p_size, round(p_retailprice, 2) AS p_retailprice FROM part")
def csv_round_trip(spark, d):
    place = scratch(spark)
    sources.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), place)
    return rounded(sources.read_table(spark, place, "p_partkey long, p_name string, p_size int, p_retailprice double", ["p_partkey", "p_size", "p_retailprice"]), 2)


@query("SELECT 'macro' || n_nationkey AS name, n_name AS value FROM nation")
def macro_round_trip(spark, d):
    place = scratch(spark)
    n = table(spark, d, "nation").select(F.concat(F.lit("macro"), "n_nationkey").alias("name"), "n_name")
    sources.macro_lines(n, "name", F.col("n_name")).write.text(place)
    return sources.read_macros(spark, place)


@query("SELECT n_regionkey AS shard_index, n_nationkey AS key, n_name AS name FROM nation")
def manifest_round_trip(spark, d):
    place = scratch(spark)
    runs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("shard_index")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("runs"))
    sources.write_json(runs, place)
    m = sources.read_manifest(spark, place, whole_files=False)
    return m.select(F.col("shard_index").cast("int").alias("shard_index"), F.col("run.key").cast("int").alias("key"), "run.name")


# Rows come in three batches of ten days; every tenth comes one batch late.  The stream is
# stopped after each batch, however many files it has, and goes on from its checkpoint.
_DELIVERED = """rows AS (SELECT event_type AS run, user_id AS label, value, ts, least(2, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END + (event_id % 10 = 0)::INT) AS batch, (epoch_ms(ts) // 86400000 + 1) * 86400000 AS ends FROM events),
marks AS (SELECT batch, max(max(epoch_ms(ts))) OVER (ORDER BY batch) AS mark FROM rows GROUP BY batch), told AS (SELECT rows.*, coalesce(ends <= b.mark, false) AS late, floor(value / 50)::INT AS bin FROM rows LEFT JOIN marks b ON b.batch = rows.batch - 1)"""


@query(f"""WITH {_DELIVERED}, f AS (SELECT run, ends, label, count(*) AS c FROM told WHERE NOT late GROUP BY ALL), w AS (SELECT run, ends, sum(c)::BIGINT AS n, count(*) AS n_unique, round(sum(c) ^ 2 / sum(c * c), 6) AS ess FROM f WHERE ends <= (SELECT max(mark) FROM marks) GROUP BY ALL),
first AS (SELECT event_type AS run, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL), h AS (SELECT run, ends, count(*) AS c, sum(value) AS v FROM told WHERE NOT late GROUP BY ALL)
SELECT run, 'window' AS kind, ends, w.n, n_unique, ess, (first.n + sum(h.c) OVER (PARTITION BY run ORDER BY ends))::BIGINT AS hist_n, round(first.total + sum(h.v) OVER (PARTITION BY run ORDER BY ends), 2) AS hist_total FROM w JOIN h USING (run, ends) JOIN first USING (run)
UNION ALL SELECT run, 'late', ends, count(*), 0, NULL, NULL, NULL FROM told WHERE late GROUP BY run, ends
UNION ALL SELECT 'silent', 'expired', epoch_ms(TIMESTAMP '2024-01-15'), 0, 0, NULL, count(*), round(sum(value), 2) FROM events""")
def stream_lineage(spark, d):
    day = 86_400_000
    place = scratch(spark)
    late = (F.col("event_id") % 10 == 0).cast("int")
    home = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("user_id").cast("string").alias("label"), "value", ms.alias("ms"), F.least(home + late, F.lit(2)).alias("batch"))
    # When a batch was delivered: the newest time in it or before.
    marks = {r[0]: r[1] for r in e.groupBy("batch").agg(F.max("ms")).collect()}
    mark = lambda b: max(v for k, v in marks.items() if k <= b)
    binned = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.floor(F.col("value") / 50).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    first = binned.unionByName(binned.withColumn("run", F.lit("silent")).groupBy("run", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    processor = lineage.LineageWindows(day, 20 * day, 0.0, 50.0, 20, 1705276800000)
    kind = "run string, label string, value double, ms long, arrived timestamp"

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    with lineage.rocksdb(spark):
        for b in range(3):
            arrived = F.timestamp_millis(F.lit(mark(b)))
            e.where(F.col("batch") == b).select("run", "label", "value", "ms", arrived.alias("arrived")).write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(kind).parquet(f"{place}/in")
            out = lineage.lineage_windows(stream, first, processor)
            q = out.writeStream.outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
            q.awaitTermination()
    rows = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{place}/out")
    # Late rows of a window may come in several batches.
    whole = rows.where("kind <> 'late'").select("run", "kind", "ends", "n", "n_unique", "ess", "hist_n", "hist_total")
    aside = rows.where("kind = 'late'").groupBy("run", "kind", "ends").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("n_unique"), F.lit(None).cast("double").alias("ess"), F.lit(None).cast("long").alias("hist_n"), F.lit(None).cast("double").alias("hist_total"))
    return rounded(whole.withColumn("hist_total", F.round("hist_total", 2)).unionByName(aside))
