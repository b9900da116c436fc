"""Queries of files and configurations: tables are written, read back and used."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import lookup
from ..functions.shared import scratch
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


def _customers(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


def _above(customers, limits: dict):
    limit = lookup(limits, F.col("r_name"), None)
    return customers.where(F.col("c_acctbal") > limit).groupBy("r_name").agg(F.count("*").alias("n"), F.max(limit).cast("long").alias("least"))


_ABOVE = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


# A configuration of limits by region, one line for each region of the table.
@query(f"SELECT r_name, count(*) AS n, max(r_regionkey * 1000)::BIGINT AS least {_ABOVE} WHERE c_acctbal > r_regionkey * 1000 GROUP BY r_name")
def config_from_yaml(spark, d):
    place = scratch(spark)
    lines = table(spark, d, "region").select(F.lit(1).alias("o"), F.concat(F.lit('  "'), "r_name", F.lit('": '), (F.col("r_regionkey") * 1000).cast("string")).alias("value"))
    head = spark.createDataFrame([(0, "limits:")], "o int, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.text(place)
    limits = sources.read_config(spark, place)["limits"]
    return _above(_customers(spark, d), limits)


# The same limits, with those of two regions laid over by arguments.
@query(f"""WITH l AS (SELECT r_name, CASE r_name WHEN 'ASIA' THEN 500 WHEN 'EUROPE' THEN -250 ELSE r_regionkey * 1000 END AS least, r_regionkey FROM region)
SELECT r_name, count(*) AS n, max(least)::BIGINT AS least FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN l ON n_regionkey = r_regionkey WHERE c_acctbal > least GROUP BY r_name""")
def config_overrides(spark, d):
    base = {"limits": {r.r_name: r.r_regionkey * 1000 for r in table(spark, d, "region").collect()}, "other": {"kept": True}}
    config = orchestration.merged_config(base, orchestration.overrides(["limits.ASIA=100", "limits.EUROPE=-250", "limits.ASIA=500"]))
    return _above(_customers(spark, d), config["limits"])


# Shards are read while there is no merged file, and the merged file as soon as it is there.
@query("SELECT o_orderkey, round(o_totalprice, 2) AS v, origin FROM orders, (SELECT unnest(['shards', 'merged']) AS origin) WHERE origin = 'shards' OR o_orderkey % 2 = 0")
def merged_or_shards(spark, d):
    place, kind = scratch(spark), "o_orderkey long, v double"
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    for s in range(3):
        sources.write_csv(o.where(F.col("o_orderkey") % 3 == s), f"{place}/shard-{s}")
    paths = [f"{place}/merged", f"{place}/shard-*"]
    first = sources.first_existing(spark, paths, kind).withColumn("origin", F.lit("shards"))
    sources.write_csv(o.where("o_orderkey % 2 = 0"), paths[0])
    return rounded(first.unionByName(sources.first_existing(spark, paths, kind).withColumn("origin", F.lit("merged"))), 2)


# Built once under its parameters; other parameters are another reference.
@query("""WITH p AS (SELECT l_returnflag AS run, l_quantity AS x, avg(l_tax) AS y FROM lineitem GROUP BY ALL) SELECT run, x, round(y * k, 6) AS y, k::INT AS k FROM p, (SELECT unnest([1, 2]) AS k)""")
def reference_cache(spark, d):
    place = scratch(spark)
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("x")).agg(F.avg("l_tax").alias("y"))

    def at(k: int, factor: float):
        key = {"beta": 4.0, "nodes": 50, "k": k}
        return sources.cached_reference(spark, place, key, lambda: p.withColumn("y", F.col("y") * factor)).withColumn("k", F.lit(k))

    at(1, 1.0)
    # What is there under its parameters is not built again.
    return rounded(at(1, 100.0).unionByName(at(2, 2.0)))


@query("SELECT o_orderkey::VARCHAR AS label, o_orderpriority || ' : ' || o_orderstatus AS value FROM orders")
def labelled_values(spark, d):
    place = scratch(spark)
    o = table(spark, d, "orders")
    o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(" :  "), "o_orderpriority", F.lit(" : "), "o_orderstatus").alias("value")).write.text(place)
    return sources.read_labelled(spark, place).select("label", "value")


@query("""SELECT pos::INT AS pos, count(*) AS n, count(v) AS known, round(sum(v), 2) AS total FROM (SELECT unnest([l_quantity, l_extendedprice, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END]) AS v, unnest([0, 1, 2]) AS pos FROM lineitem) GROUP BY pos""")
def wide_text(spark, d):
    place = scratch(spark)
    third = F.when(F.col("l_linenumber") == 1, "x").otherwise(F.col("l_discount").cast("string"))
    li = table(spark, d, "lineitem").select(F.concat_ws("  ", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), third).alias("value"))
    li.write.text(place)
    rows = sources.read_wide_text(spark, place)
    return rounded(rows.groupBy("pos").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.sum("value").alias("total")), 2)


# Checks over whole tables; a query behind the gate runs only if all of them hold.
@query("""SELECT 'customers' AS name, count(*) AS n, count(*) = (SELECT count(*) FROM orders) AS ok FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'prices', count(*), min(o_totalprice) > 0 FROM orders UNION ALL SELECT 'discounts', count(*), max(l_discount) <= 1 FROM lineitem""")
def validation_gate(spark, d):
    o, c, li = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    known = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"))
    whole = o.agg(F.count("*").alias("_all"), F.min("o_totalprice").alias("_least"))
    # One row beside one row.
    first = known.crossJoin(F.broadcast(whole)).select(F.lit("customers").alias("name"), "n", (F.col("n") == F.col("_all")).alias("ok"))
    second = whole.select(F.lit("prices").alias("name"), F.col("_all").alias("n"), (F.col("_least") > 0).alias("ok"))
    third = li.agg(F.count("*").alias("n"), F.max("l_discount").alias("_most")).select(F.lit("discounts").alias("name"), "n", (F.col("_most") <= 1).alias("ok"))
    return orchestration.gate(first.unionByName(second).unionByName(third))
