"""Queries of the tabular operators over the driver's tables, and their SQL.

Runs are made of events: a method is an event type, a seed a user, and the metric the
mean value; view is the baseline.  Doubles are rounded, as sums differ in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compact_number, lookup, safe_name, seed_of
from ..operators import selection, tabular
from . import orchestration

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    # Adding 0 turns -0 into 0.
    return df.select(*[(F.round(F.col(n), digits) + 0.0).alias(n) if k in ("double", "float") else F.col(n) for n, k in kinds.items()])


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("metric"))


RUNS = "runs AS (SELECT event_type AS method, user_id AS seed, avg(value) AS metric FROM events GROUP BY ALL)"
PAIRS = RUNS + ", pairs AS (SELECT f.method, f.seed, f.metric AS value, a.metric AS base FROM runs f JOIN runs a ON f.seed = a.seed AND a.method = 'view' WHERE f.method <> 'view')"
GAIN = "CASE WHEN base <> 0 THEN 100 * (base - value) / base END"


def pairs(spark, d):
    return tabular.matched_pairs(runs(spark, d), "method", "view", ["seed"], "metric")


@query(f"""WITH {PAIRS} SELECT method, count(*) AS n_pairs, sum((value < base)::INT)::BIGINT AS wins, round(avg((value < base)::INT), 6) AS win_rate,
  round(quantile_cont({GAIN}, 0.5), 6) AS median_gain, round(avg({GAIN}), 6) AS mean_gain FROM pairs GROUP BY method""")
def matched_seed_winrate(spark, d):
    return rounded(tabular.pair_summary(pairs(spark, d), ["method"]))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS value_median, round(quantile_cont(value, 0.25), 6) AS value_q25, round(quantile_cont(value, 0.75), 6) AS value_q75,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value_iqr, round(avg((NOT isfinite(value))::INT), 6) AS value_missing FROM events GROUP BY event_type""")
def config_median_iqr(spark, d):
    return rounded(tabular.config_summary(table(spark, d, "events"), ["event_type"], ["value"]))


@query(f"""WITH {RUNS}, m AS (SELECT method, quantile_cont(metric, 0.5) AS median FROM runs GROUP BY method)
SELECT m.method, round(m.median, 6) AS median, round(b.median, 6) AS base_median, round((b.median - m.median) / b.median, 6) AS gain FROM m, m b WHERE b.method = 'view' AND m.method <> 'view'""")
def unpaired_gain(spark, d):
    return rounded(tabular.unpaired_gain(runs(spark, d), "method", "view", "metric"))


@query(f"""WITH {PAIRS} SELECT method, count(*) AS n, round(avg(base - value), 6) AS mean_diff, round(stddev_samp(base - value) / sqrt(count(*)), 6) AS se_diff,
  round(avg(base - value) / (stddev_samp(base - value) / sqrt(count(*))), 6) AS t_stat, count(*) - 1 AS dof FROM pairs GROUP BY method""")
def paired_t_stat(spark, d):
    return rounded(tabular.paired_t(pairs(spark, d), ["method"]))


_PRIO = "prio AS (SELECT o_orderpriority AS method, year(o_orderdate)::INT AS stage, o_custkey % 20 AS seed, avg(o_totalprice) AS metric FROM orders GROUP BY ALL)"


@query(f"""WITH {_PRIO}, pairs AS (SELECT f.method, f.stage, f.metric AS value, a.metric AS base FROM prio f JOIN prio a USING (stage, seed) WHERE a.method = '5-LOW' AND f.method <> '5-LOW')
SELECT method, stage, count(*) AS n_pairs, sum((value < base)::INT)::BIGINT AS wins, round(avg((value < base)::INT), 6) AS win_rate, round(quantile_cont({GAIN}, 0.5), 6) AS median_gain, round(avg({GAIN}), 6) AS mean_gain FROM pairs GROUP BY ALL""")
def multi_key_pairing(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("stage"), (F.col("o_custkey") % 20).alias("seed")).agg(F.avg("o_totalprice").alias("metric"))
    return rounded(tabular.pair_summary(tabular.matched_pairs(o, "method", "5-LOW", ["stage", "seed"], "metric"), ["method", "stage"]))


_CONFIGS = """configs AS (SELECT l_returnflag AS target, l_linenumber || '-' || l_linestatus AS config, quantile_cont(l_extendedprice, 0.5) AS integrated, quantile_cont(l_discount, 0.5) AS final, avg(l_tax) AS event_fraction FROM lineitem GROUP BY ALL)"""


def configs(spark, d):
    config = F.concat_ws("-", "l_linenumber", "l_linestatus")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("target"), config.alias("config")).agg(
        F.percentile("l_extendedprice", 0.5).alias("integrated"), F.percentile("l_discount", 0.5).alias("final"), F.avg("l_tax").alias("event_fraction")
    )


@query(f"""WITH {_CONFIGS} SELECT target, config, round(integrated, 4) AS integrated, row_number() OVER (PARTITION BY target ORDER BY integrated, final, config) AS rank,
  row_number() OVER (PARTITION BY target ORDER BY integrated, final, config) = 1 AS selected FROM configs""")
def best_config_per_target(spark, d):
    return rounded(selection.best_per_target(configs(spark, d), "target", "config", ["integrated", "final"]).select("target", "config", "integrated", "rank", "selected"), 4)


@query(f"""WITH {_CONFIGS}, safe AS (SELECT *, event_fraction <= 0.0399 AND target <> 'N' AS passed FROM configs), pool AS (SELECT *, passed OR NOT bool_or(passed) OVER (PARTITION BY target) AS pool FROM safe),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target, pool ORDER BY integrated, final, config) AS n FROM pool)
SELECT target, config, passed, CASE WHEN pool THEN n END AS rank, pool AND n = 1 AS selected FROM ranked""")
def safety_filtered_selection(spark, d):
    safe = (F.col("event_fraction") <= 0.0399) & (F.col("target") != "N")
    return selection.best_per_target(configs(spark, d), "target", "config", ["integrated", "final"], safe).select("target", "config", "passed", "rank", "selected")


@query("""WITH m AS (SELECT p_brand AS config, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY p_brand)
SELECT config, round(median, 6) AS median, row_number() OVER (ORDER BY median, config) AS rank FROM m ORDER BY median, config LIMIT 10""")
def top_k_configs(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("config")).agg(F.percentile("p_retailprice", 0.5).alias("median"))
    return rounded(selection.top_k(m, "median", "config", 10))


@query("""WITH m AS (SELECT p_type AS type, p_brand AS config, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY ALL)
SELECT type, arg_min(config, (median, config)) AS best, round(min(median), 6) AS best_value, arg_max(config, (median, config)) AS worst, round(max(median), 6) AS worst_value FROM m GROUP BY type""")
def best_and_worst_config(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("config")).agg(F.percentile("p_retailprice", 0.5).alias("median"))
    return rounded(selection.best_and_worst(m, ["type"], "config", "median"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def dedup_keep_last(spark, d):
    o = selection.keep_last(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return rounded(o.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), 2)


@query("""WITH shards AS (SELECT o_orderkey AS run_id, o_totalprice AS v, NULL AS extra, 0 AS shard FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, o_totalprice * 2, o_orderstatus, 1 FROM orders WHERE o_orderkey % 3 > 0)
SELECT run_id, round(v, 2) AS v, extra, shard FROM shards QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY shard DESC) = 1""")
def merge_shards(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("extra"))
    one = o.where("run_id % 3 < 2").drop("extra").withColumn("shard", F.lit(0))
    two = o.where("run_id % 3 > 0").withColumn("v", F.col("v") * 2).withColumn("shard", F.lit(1))
    return rounded(selection.keep_last([one, two], ["run_id"], [F.col("shard")]).select("run_id", "v", "extra", "shard"), 2)


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def dedup_keep_first(spark, d):
    return selection.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def resume_anti_join(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    done = [o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 400000")]
    return orchestration.remaining(table(spark, d, "customer"), *done, key="c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def selected_semi_join(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return orchestration.chosen(table(spark, d, "customer"), big, "c_custkey").select("c_custkey", "c_name")


@query("""SELECT n_nationkey, n_name, eta, gamma, seed::INT AS seed FROM nation, (SELECT unnest([0.075, 0.15])::DOUBLE AS eta), (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS gamma), (SELECT unnest([0, 1, 2, 3, 4]) AS seed)""")
def grid_expand(spark, d):
    axes = {"eta": [0.075, 0.15], "gamma": [0.0, 0.05, 0.1], "seed": [0, 1, 2, 3, 4]}
    return orchestration.cross_with(table(spark, d, "nation").select("n_nationkey", "n_name"), axes)


@query("SELECT n_nationkey, n_regionkey, ((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey)) - 1) // 2 AS batch FROM nation")
def batch_chunk(spark, d):
    return orchestration.batches(table(spark, d, "nation"), ["n_regionkey"], ["n_name", "n_nationkey"], 2).select("n_nationkey", "n_regionkey", "batch")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) % 4)::INT AS shard FROM orders")
def stride_shard(spark, d):
    o = orchestration.stride_shards(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 4)
    return o.select("o_orderkey", F.col("shard").cast("int").alias("shard"))


@query("""WITH RECURSIVE g AS (SELECT l_returnflag || l_linenumber AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_returnflag || l_linenumber) AS i FROM lineitem GROUP BY l_returnflag, l_linenumber),
s(i, name, shard, loads) AS (SELECT 0::BIGINT, '', -1, [0, 0, 0, 0]::BIGINT[] UNION ALL SELECT g.i, g.name, list_position(loads, list_min(loads))::INT - 1, list_transform([1, 2, 3, 4], lambda k: loads[k] + CASE WHEN k = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END) FROM s JOIN g ON g.i = s.i + 1)
SELECT name, shard FROM s WHERE i > 0""")
def greedy_shard(spark, d):
    # The groups are batches of a plan, 35 at most here.
    sizes = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n")).collect()
    plan = orchestration.greedy_shards([(f"{r[0]}{r[1]}", r[2]) for r in sizes], 4)
    return spark.createDataFrame(sorted(plan.items()), "name string, shard int")


@query("""SELECT l_returnflag, min(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS F, min(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag""")
def heatmap_pivot(spark, d):
    return selection.heatmap(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_extendedprice")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def exactly_one_lookup(spark, d):
    return selection.exactly_one(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), n_nationkey=7)


@query("""SELECT r_name, CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'AMERICA' THEN 2 ELSE 9 END AS ordinal, starts_with(r_name, 'A') AS has_prefix, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA', 'AMERICA') GROUP BY r_name""")
def categorical_order(spark, d):
    r = table(spark, d, "region").where(F.col("r_name").isin("EUROPE", "ASIA", "AFRICA", "AMERICA"))
    n = r.join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    ordinal = lookup({"EUROPE": 0, "ASIA": 1, "AMERICA": 2}, F.col("r_name"), 9)
    return n.select("r_name", ordinal.alias("ordinal"), F.col("r_name").startswith("A").alias("has_prefix"), "n").orderBy("ordinal", "r_name")


@query("""WITH m AS (SELECT event_type, user_id, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL)
SELECT event_type, count(*) AS n_configs, round(min(m), 6) AS best_median, round(quantile_cont(m, 0.5), 6) AS median_of_medians, round(max(m), 6) AS worst_median FROM m GROUP BY event_type""")
def nested_summary(spark, d):
    return rounded(tabular.nested_summary(table(spark, d, "events"), "event_type", "user_id", "value"))


_PLACED = """placed AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
least AS (SELECT event_type, min(n) AS least FROM (SELECT event_type, user_id, count(*) AS n FROM placed GROUP BY ALL) GROUP BY event_type)"""


@query(f"""WITH {_PLACED} SELECT event_type, pos::INT AS pos, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75
FROM placed JOIN least USING (event_type) WHERE pos < least GROUP BY event_type, pos""")
def series_band_positional(spark, d):
    e = table(spark, d, "events")
    return rounded(tabular.band_by_position(e, ["event_type"], "user_id", [F.col("ts"), F.col("event_id")], "value"))


@query("""SELECT event_type, day(ts)::INT AS t, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def series_band_by_time(spark, d):
    return rounded(tabular.band_by_time(table(spark, d, "events").withColumn("t", F.dayofmonth("ts")), ["event_type"], "t", "value"))


@query("SELECT l_returnflag, l_quantity::INT AS node, round(avg(l_discount), 6) AS discount_mean, round(sum(l_linenumber), 2) AS births_sum FROM lineitem GROUP BY ALL")
def profile_seed_mean(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("node"), F.col("l_discount").alias("discount"), F.col("l_linenumber").cast("double").alias("births"))
    return rounded(tabular.profile_mean(li, ["l_returnflag", "node"], "discount", ["births"]))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(NOT isfinite(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END), true)) AS v_missing, 0::BIGINT AS value_missing FROM events""")
def missing_census(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return tabular.missing_census(table(spark, d, "events").withColumn("v", v), ["v", "value"])


@query("SELECT event_type, count(DISTINCT user_id) AS n_seeds, count(DISTINCT day(ts)) AS n_days FROM events GROUP BY event_type")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_seeds"), F.count_distinct(F.dayofmonth("ts")).alias("n_days"))


@query("""SELECT event_type, round(regr_slope(value, day(ts)), 6) AS slope, round(regr_intercept(value, day(ts)), 6) AS intercept, round(corr(value, day(ts)), 6) AS r, count(*) AS n FROM events GROUP BY event_type""")
def trend_slope_corr(spark, d):
    return rounded(tabular.trend(table(spark, d, "events").withColumn("x", F.dayofmonth("ts").cast("double")), ["event_type"], "x", "value"))


@query("""SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS smallest FROM orders GROUP BY o_orderpriority""")
def argmax_argmin(spark, d):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", by).alias("largest"), F.min_by("o_orderkey", by).alias("smallest"))


@query("""SELECT user_id, (event_id // 500)::BIGINT AS "window", round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, round(sum(value), 4) AS sum, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY ALL""")
def windowed_scores(spark, d):
    out = tabular.window_aggregates(table(spark, d, "events"), "user_id", "event_id", 500, "value")
    return rounded(out.withColumn("sum", F.round("sum", 4)))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value, arg_max(event_type, (ts, event_id)) AS last_event_type FROM events GROUP BY user_id")
def last_value_per_run(spark, d):
    return tabular.last_value(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value", "event_type"])


@query("""WITH f AS (SELECT o_orderpriority, o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n_unique, round(sum(n) ^ 2 / sum(n * n), 6) AS ess, max(n)::BIGINT AS max_multiplicity, sum(n)::BIGINT AS n_particles FROM f GROUP BY o_orderpriority""")
def ancestor_ess(spark, d):
    return rounded(tabular.ancestor_statistics(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey"))


@query("""WITH s AS (SELECT user_id, ts, event_id, sign(value - 50) AS s FROM events WHERE value <> 50), p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM s)
SELECT user_id, count(*) FILTER (WHERE p <> s) AS crossings, count(*) AS n_points FROM p GROUP BY user_id""")
def barrier_crossings(spark, d):
    return tabular.crossings(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value") - 50)


@query("""WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda t, x: t * 0.9::DOUBLE + 0.1::DOUBLE * x), 6) AS ema, len(v)::INT AS n FROM a""")
def ema_fold(spark, d):
    return rounded(tabular.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.1))


@query("""SELECT c_mktsegment, round(avg((c_acctbal >= -1000 AND c_acctbal < 4000)::INT), 6) AS frac_left, round(avg((c_acctbal BETWEEN 4000 AND 5000)::INT), 6) AS frac_barrier, round(avg((c_acctbal > 5000 AND c_acctbal <= 9000)::INT), 6) AS frac_right,
  round(avg((c_acctbal < -1000 OR c_acctbal > 9000)::INT), 6) AS frac_outside FROM customer GROUP BY c_mktsegment""")
def region_fractions(spark, d):
    return rounded(tabular.region_fractions(table(spark, d, "customer"), ["c_mktsegment"], tabular.region(F.col("c_acctbal"), 4500, 500, -1000, 9000)))


@query("""WITH bins AS (SELECT unnest([5.0, 15.0, 25.0, 35.0, 60.0])::DOUBLE AS center) SELECT center, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(var_samp(l_discount), 8) AS variance, round(avg(l_discount * l_discount), 8) AS mean_square
FROM bins LEFT JOIN lineitem ON abs(l_quantity - center) <= 5 GROUP BY center""")
def conditional_variance(spark, d):
    bins = spark.createDataFrame([(float(c), 5.0) for c in (5, 15, 25, 35, 60)], "center double, half double")
    out = tabular.conditional_moments(table(spark, d, "lineitem"), bins, "l_quantity", "l_discount")
    return rounded(out.withColumn("mean", F.round("mean", 6)), 8)


@query("""SELECT user_id, pos::INT AS pos, v FROM (SELECT user_id, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS a FROM events GROUP BY user_id))""")
def explode_series(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a")).select("user_id", F.col("a.value").alias("v"))
    return selection.series_to_rows(a, ["user_id"], ["v"])


@query(f"""WITH {RUNS} SELECT method, len(list(seed)) AS n, list(seed ORDER BY seed)[1] AS first_seed, round(list(metric ORDER BY seed)[3], 6) AS third FROM runs GROUP BY method""")
def stack_matrix(spark, d):
    m = selection.stack_seeds(runs(spark, d), ["method"], "seed", "metric")
    return rounded(m.select("method", F.size("values").cast("long").alias("n"), F.col("seeds")[0].alias("first_seed"), F.col("values")[2].alias("third")))


@query("""SELECT n_nationkey, 'key=' || n_nationkey || '_eta=' || (CASE WHEN n_nationkey % 2 = 0 THEN '0.5' ELSE '0.25' END) AS config_id, regexp_replace(n_name || '/ ' || n_regionkey, '[^A-Za-z0-9._=-]+', '_', 'g') AS file_name,
  ('0x' || substr(sha256(n_name), 1, 15))::BIGINT AS seed FROM nation""")
def run_identity(spark, d):
    n = table(spark, d, "nation").withColumn("eta", F.when(F.col("n_nationkey") % 2 == 0, 0.5).otherwise(0.25))
    cid = F.concat(F.lit("key="), "n_nationkey", F.lit("_eta="), compact_number(F.col("eta")))
    return n.select("n_nationkey", cid.alias("config_id"), safe_name(F.concat("n_name", F.lit("/ "), "n_regionkey")).alias("file_name"), seed_of(F.col("n_name")).alias("seed"))


@query("""SELECT page_id, split_part(k, '|', 1) AS stage, split_part(split_part(k, '|', 2), '::', 1) AS method, split_part(k, '::', 2) AS field, try_cast(split_part(k, '::', 2) AS DOUBLE) AS number FROM (SELECT page_id, 'stage' || (page_id % 3) || '|m' || (page_id % 5) || '::' || (CASE WHEN page_id % 2 = 0 THEN (page_id / 4)::VARCHAR ELSE 'bias' END) AS k FROM pages)""")
def composite_key_parse(spark, d):
    last = F.when(F.col("page_id") % 2 == 0, (F.col("page_id") / 4).cast("string")).otherwise("bias")
    k = F.concat(F.lit("stage"), F.col("page_id") % 3, F.lit("|m"), F.col("page_id") % 5, F.lit("::"), last)
    p = table(spark, d, "pages").select("page_id", k.alias("k"))
    field = F.element_at(F.split("k", "::"), 2)
    return p.select("page_id", F.element_at(F.split("k", r"\|"), 1).alias("stage"), F.element_at(F.split(F.element_at(F.split("k", r"\|"), 2), "::"), 1).alias("method"), field.alias("field"), field.try_cast("double").alias("number"))
