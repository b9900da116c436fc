"""Queries of composed reports, run tables and file round trips, and their SQL.

Runs are made of orders: the stage is the year, a method an order priority, a seed a
customer's remainder; 5-LOW is the baseline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators import reports, selection
from .run_queries import run_stream, scratch
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


BASE = "5-LOW"


def runs(spark, d):
    o = table(spark, d, "orders")
    seed = (F.col("o_custkey") % 20).alias("seed")
    rows = o.groupBy(F.year("o_orderdate").alias("stage"), F.col("o_orderpriority").alias("method"), seed).agg(
        F.avg("o_totalprice").alias("l2_f"), F.min("o_totalprice").alias("l2_fp"), F.max("o_totalprice").alias("int_l2_f"), F.count("*").cast("double").alias("ess"), F.avg((F.col("o_custkey") % 7).cast("double")).alias("repl")
    )
    return reports.constant_where(rows, F.col("method") != BASE, ["repl"])


RUNS = f"""runs AS (SELECT year(o_orderdate)::INT AS stage, o_orderpriority AS method, o_custkey % 20 AS seed, avg(o_totalprice) AS l2_f, min(o_totalprice) AS l2_fp, max(o_totalprice) AS int_l2_f, count(*)::DOUBLE AS ess,
  CASE WHEN any_value(o_orderpriority) = '{BASE}' THEN 0 ELSE avg(o_custkey % 7) END AS repl FROM orders GROUP BY ALL),
paired AS (SELECT *, max(l2_f) FILTER (WHERE method = '{BASE}') OVER (PARTITION BY stage, seed) AS base FROM runs)"""


def _med(*columns: str) -> str:
    return ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS med_{c}" for c in columns)


def _iqr(*columns: str) -> str:
    return ", ".join(f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr_{c}" for c in columns)


_SHARED = f"FILTER (WHERE base IS NOT NULL AND method <> '{BASE}')"
_PERCENT = "CASE WHEN base <> 0 THEN 100 * (base - l2_f) / base END"


@query(f"""WITH {RUNS}, s AS (SELECT stage, method, count(*) AS n_seeds, {_med("l2_f", "l2_fp", "int_l2_f", "ess", "repl")}, {_iqr("l2_f", "l2_fp")}, quantile_cont(l2_f, 0.5) AS m, round(avg((l2_f < base)::INT) {_SHARED}, 6) AS winrate_vs_base FROM paired GROUP BY stage, method),
b AS (SELECT *, max(m) FILTER (WHERE method = '{BASE}') OVER (PARTITION BY stage) AS bm FROM s)
SELECT * EXCLUDE (m, bm), CASE WHEN method = '{BASE}' THEN 0.0::DOUBLE WHEN winrate_vs_base IS NOT NULL THEN round((bm - m) / bm, 6) END AS gain_vs_base FROM b""")
def bottleneck_config_report(spark, d):
    return rounded(reports.config_report(runs(spark, d), ["stage"], "method", BASE, "seed", "l2_f", ["l2_f", "l2_fp"], ["int_l2_f", "ess", "repl"]))


@query(f"""WITH {RUNS}, holed AS (SELECT * REPLACE (CASE WHEN seed = 3 AND method = '2-HIGH' THEN 'nan'::DOUBLE ELSE ess END AS ess) FROM paired)
SELECT stage, method, count(*) AS n_seeds, {_med("l2_f")}, {_iqr("l2_f")}, round(stddev_samp(l2_f) / sqrt(count(l2_f)), 6) AS se_l2_f, {_med("int_l2_f", "l2_fp")},
  CASE WHEN bool_or(isnan(ess)) THEN 'nan'::DOUBLE ELSE round(quantile_cont(ess, 0.5), 6) END AS med_ess, round(avg((l2_f < base)::INT) {_SHARED}, 6) AS winrate_vs_base,
  CASE WHEN method = '{BASE}' THEN 0.0::DOUBLE ELSE round(quantile_cont({_PERCENT}, 0.5), 6) END AS med_gain_pct_vs_base FROM holed GROUP BY stage, method""")
def dominant_share_report(spark, d):
    holed = F.when((F.col("seed") == 3) & (F.col("method") == "2-HIGH"), F.lit(float("nan"))).otherwise(F.col("ess"))
    return rounded(reports.share_report(runs(spark, d).withColumn("ess", holed), ["stage"], "method", BASE, "seed", "l2_f", ["int_l2_f", "l2_fp", "ess"]))


@query(f"""WITH {RUNS} SELECT stage, count(*) AS n_seeds, round(quantile_cont(base, 0.5), 6) AS med_base, {_med("l2_f")}, round(quantile_cont({_PERCENT}, 0.5), 6) AS median_gain_pct, round(avg((l2_f < base)::INT), 6) AS win_rate, {_med("ess", "repl")}
FROM paired WHERE method = '1-URGENT' GROUP BY stage""")
def rate_sweep_report(spark, d):
    return rounded(reports.rate_report(runs(spark, d), ["stage"], "method", BASE, "1-URGENT", "seed", "l2_f", ["ess", "repl"]))


_PILOT = f"""pilot AS (SELECT o_orderpriority AS name, CASE WHEN o_orderpriority = '{BASE}' THEN 'abf' ELSE 'fr' END AS method, o_custkey % 40 AS seed, avg(o_totalprice) AS l2_f, count(*)::DOUBLE AS ess, min(o_orderkey) AS rate FROM orders GROUP BY ALL),
p AS (SELECT *, max(l2_f) FILTER (WHERE method = 'abf') OVER (PARTITION BY seed) AS base FROM pilot)"""


@query(f"""WITH {_PILOT} SELECT name, count(*) AS n, count(*) FILTER (WHERE l2_f < base) AS wins, round(quantile_cont(CASE WHEN base > 0 THEN 100 * (base - l2_f) / base END, 0.5), 6) AS med_gain, {_med("l2_f", "ess")}, min(rate) AS rate FROM p WHERE method <> 'abf' GROUP BY name""")
def pilot_leaderboard(spark, d):
    o = table(spark, d, "orders")
    pilot = o.groupBy(F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderpriority") == BASE, "abf").otherwise("fr").alias("method"), (F.col("o_custkey") % 40).alias("seed"))
    pilot = pilot.agg(F.avg("o_totalprice").alias("l2_f"), F.count("*").cast("double").alias("ess"), F.min("o_orderkey").alias("rate"))
    return rounded(reports.leaderboard(pilot, "name", "method", "abf", "seed", "l2_f", ["ess"], ["rate"]))


@query(f"""WITH {RUNS}, b AS (SELECT *, max(int_l2_f) FILTER (WHERE method = '{BASE}') OVER (PARTITION BY stage, seed) AS bi FROM paired)
SELECT method, count(*) AS n_pairs, sum((l2_f < base)::INT)::BIGINT AS n_wins, round(avg((l2_f < base)::INT), 6) AS win_rate, round(quantile_cont({_PERCENT}, 0.5), 6) AS median_gain_pct, round(avg({_PERCENT}), 6) AS mean_gain_pct,
  round(quantile_cont(CASE WHEN bi > 0 THEN 100 * (bi - int_l2_f) / bi END, 0.5), 6) AS median_gain_pct_also FROM b WHERE method <> '{BASE}' AND base IS NOT NULL GROUP BY method""")
def winrate_by_config(spark, d):
    return rounded(reports.win_table(runs(spark, d), ["stage"], [], "method", BASE, "seed", "l2_f", "int_l2_f"))


_COND = "cond AS (SELECT l_returnflag AS phi, l_linestatus AS method, l_linenumber AS x_center, l_suppkey % 9 AS seed, CASE WHEN any_value(l_suppkey % 9) = 4 THEN NULL ELSE var_samp(l_quantity) END AS emp_var, avg(l_tax) AS abs_err, count(*)::DOUBLE AS cnt, l_linenumber * 2.5::DOUBLE AS ref_var FROM lineitem GROUP BY ALL)"


@query(f"WITH {_COND} SELECT phi, method, x_center, {_med('emp_var', 'abs_err', 'cnt')}, round(min(ref_var), 6) AS ref_var FROM cond GROUP BY ALL")
def conditional_diagnostics(spark, d):
    li = table(spark, d, "lineitem")
    seed = (F.col("l_suppkey") % 9).alias("seed")
    cond = li.groupBy(F.col("l_returnflag").alias("phi"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("x_center"), seed).agg(F.var_samp("l_quantity").alias("emp_var"), F.avg("l_tax").alias("abs_err"), F.count("*").cast("double").alias("cnt"))
    cond = cond.withColumn("emp_var", F.when(F.col("seed") != 4, F.col("emp_var"))).withColumn("ref_var", F.col("x_center") * 2.5)
    return rounded(reports.conditional_table(cond, ["phi", "method"], "x_center", ["emp_var", "abs_err"], ["ref_var"], "cnt"))


@query("SELECT p_partkey, round(p_size / p_retailprice, 9) AS steps_per_second, round(p_size / p_retailprice * 100 * (p_partkey % 8 + 1), 9) AS particle_steps_per_second FROM part")
def throughput(spark, d):
    p = table(spark, d, "part").withColumns({"n": F.lit(100), "configs": F.col("p_partkey") % 8 + 1})
    return rounded(reports.throughput(p, "p_size", "n", "configs", "p_retailprice").select("p_partkey", "steps_per_second", "particle_steps_per_second"), 9)


@query("SELECT s_suppkey, round((s_suppkey % 13) / ((s_suppkey % 50) * 0.01::DOUBLE * 100), 8) AS birth_rate, round((s_suppkey % 11) / ((s_suppkey % 50) * 0.01::DOUBLE * 100), 8) AS death_rate FROM supplier WHERE s_suppkey % 50 > 0")
def selection_rates(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 50 > 0").withColumns({"b": F.col("s_suppkey") % 13, "k": F.col("s_suppkey") % 11, "steps": F.col("s_suppkey") % 50, "n": F.lit(100)})
    return rounded(reports.selection_rates(s, "b", "k", "steps", 0.01, "n").select("s_suppkey", "birth_rate", "death_rate"), 8)


@query("""WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY p_brand), k AS (SELECT p_brand, row_number() OVER (ORDER BY m, p_brand) AS rank FROM m QUALIFY rank <= 6)
SELECT p_brand, rank::INT AS rank, p_size FROM part JOIN k USING (p_brand)""")
def top_config_members(spark, d):
    return reports.members_of_best(table(spark, d, "part"), "p_brand", "p_retailprice", "p_size", 6)


@query("""WITH t AS (SELECT event_type, day(ts)::INT AS t, avg(value) AS v FROM events GROUP BY ALL), l AS (SELECT *, t = max(t) OVER (PARTITION BY event_type) AS is_last FROM t) SELECT event_type, t, round(v, 6) AS v, is_last FROM l WHERE t <= 4 OR is_last""")
def time_window_rows(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("t")).agg(F.avg("value").alias("v"))
    return rounded(reports.time_window(daily, ["event_type"], "t", 4))


@query("SELECT n_nationkey, n_regionkey AS cfg__region, n_name AS cfg__name, n_name AS label FROM nation")
def flatten_config(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).alias("config"))
    return reports.with_aliases(reports.flattened(n, "config"), {"label": "cfg__name"})


@query("""WITH f AS (SELECT o_custkey AS c, max(o_orderpriority) AS error FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'done' WHEN f.error IS NOT NULL THEN 'failed' ELSE 'waiting' END AS status,
  CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN f.error END AS error FROM customer LEFT JOIN f ON c = c_custkey""")
def run_status(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    failed = o.where("o_orderstatus = 'P'").select("c_custkey", F.col("o_orderpriority").alias("error"))
    return reports.run_status(table(spark, d, "customer").select("c_custkey"), o.where("o_orderstatus = 'F'"), failed, "c_custkey")


@query("""SELECT c_custkey, 'results/' || (CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY' ELSE c_mktsegment END) || '/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def dry_run_listing(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return reports.dry_run(table(spark, d, "customer"), done, "c_custkey", reports.stage_directory(F.col("c_mktsegment"), "results/", {"BUILDING": "MACHINERY"}))


@query("SELECT n_regionkey AS region, list(n_nationkey ORDER BY n_name) AS profile, 0::BIGINT AS other FROM nation GROUP BY n_regionkey")
def profile_arrays(spark, d):
    n = selection.project_existing(table(spark, d, "nation"), ["n_regionkey", "n_name", "n_nationkey", "no_such_column"])
    n = selection.rows_to_profile(n, ["n_regionkey"], "n_name", "n_nationkey")
    return n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("profile"), F.lit(0).cast("long").alias("other"))


# ------------------------------------------------------------------ round trips


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus FROM orders")
def append_round_trip(spark, d):
    place = scratch(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status in ("F", "O", "P"):
        sources.append_rows(o.where(F.col("o_orderstatus") == status), place, ["o_orderstatus"])
    return rounded(spark.read.parquet(place), 2)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4")
def latest_partition(spark, d):
    place = scratch(spark)
    n = table(spark, d, "nation")
    for region in range(5):
        n.where(F.col("n_regionkey") == region).select("n_nationkey", "n_name").write.parquet(f"{place}/sweep_{region}")
    return spark.read.parquet(sources.latest(spark, place, "sweep_*"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey * 2.5::DOUBLE AS value FROM nation")
def record_round_trip(spark, d):
    place = f"{scratch(spark)}/{uuid.uuid4().hex}.json"
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), (F.col("n_regionkey") * 2.5).alias("value"))
    sources.write_whole(spark, place, "\n".join(r.value for r in sources.to_records(n).collect()))
    return spark.read.schema("key int, name string, value double").json(place)


@query(r"""SELECT n_nationkey, n_name || ' & ' || n_regionkey || ' & ' || coalesce(NULLIF(n_nationkey % 3, 0)::VARCHAR, '--') || ' \\' AS value FROM nation""")
def latex_table_rows(spark, d):
    n = table(spark, d, "nation").withColumn("third", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") % 3))
    rows = sources.latex_rows(n, ["n_name", "n_regionkey", "third"])
    names = F.substring_index("value", " & ", 1)
    return rows.join(F.broadcast(n.select("n_nationkey", "n_name")), names == F.col("n_name")).select("n_nationkey", "value")


@query("SELECT o_orderkey, try_cast(o_orderpriority AS DOUBLE) AS a, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS b FROM orders")
def text_numbers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"), F.substring("o_orderpriority", 1, 1).alias("b"))
    return sources.untyped_numbers(o, ["a", "b"])


# The reference has other nodes, at uneven distances; it is interpolated at what was built.
@query("""WITH p AS (SELECT l_returnflag AS run, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL), r AS (SELECT run, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WHERE x = 1 OR x::INT % 7 IN (0, 3) WINDOW w AS (PARTITION BY run ORDER BY x)),
d AS (SELECT p.y - CASE WHEN r.x1 IS NULL THEN r.y ELSE r.y + (r.y1 - r.y) * (p.x - r.x) / (r.x1 - r.x) END AS d FROM p ASOF JOIN r ON p.run = r.run AND p.x >= r.x) SELECT count(*) AS n, round(max(abs(d)), 4) AS deviation, max(abs(d)) <= 5000 AS ok FROM d""")
def reference_gate(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    r = p.where((F.col("x") == 1) | (F.col("x").cast("int") % 7).isin(0, 3))
    return rounded(sources.required_reference(p, r, ["run"], "x", "y", 5000.0), 4)


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e), g AS (SELECT user_id, k, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, began::TIMESTAMP AS began, n FROM g WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    stream = streaming.event_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    out = run_stream(streaming.session_counts(stream, gap="2 hours"), "append", spark)
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")
