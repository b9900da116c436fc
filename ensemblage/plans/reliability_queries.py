"""Queries of damaged parts, isolated failures and the npz source, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import kept, scratch
from ..operators import isolation, reports
from ..sources import npz, parts
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


def cut_short(spark, folder: str) -> None:
    """Halve the first part of a folder, as a writer that was stopped leaves it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.globStatus(place)[0]
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_cut")
    # The half goes from stream to stream and is never held.
    file, out = fs.open(status.getPath()), fs.create(aside, True)
    spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(file, out, 0, status.getLen() // 2)
    file.close()
    out.close()
    fs.delete(status.getPath(), False)
    fs.rename(aside, status.getPath())


# Five shards with keys in common; the fourth is cut short, is named, and adds no row.
@query("""WITH shards AS (SELECT o_orderkey AS run_id, o_totalprice * (1 + s) AS v, s AS shard FROM orders, (SELECT unnest([0, 1, 2, 3, 4]) AS s) WHERE o_orderkey % 5 IN (s, (s + 1) % 5))
SELECT run_id, round(v, 2) AS v, shard, NULL AS damaged FROM shards WHERE shard <> 3 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY shard DESC) = 1 UNION ALL SELECT NULL, NULL, 3, true""")
def merge_damaged(spark, d):
    place = scratch(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("v"))
    for s in range(5):
        shard = o.where((F.col("run_id") % 5).isin(s, (s + 1) % 5)).select("run_id", (F.col("v") * (1 + s)).alias("v"))
        shard.coalesce(1).write.parquet(f"{place}/shard={s}")
    cut_short(spark, f"{place}/shard=3")
    number = lambda c: F.regexp_extract(c, "shard=(\\d)", 1).cast("int")
    rows, skipped = parts.merged(spark, place, T.StructType.fromDDL("run_id long, v double"), ["run_id"], [number(F.col("part"))])
    named = skipped.select(F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("double").alias("v"), number(F.col("path")).alias("shard"), F.lit(True).alias("damaged"))
    rows = rows.select("run_id", "v", number(F.col("part")).alias("shard"), F.lit(None).cast("boolean").alias("damaged"))
    return rounded(rows.unionByName(named), 2)


# A table by status; new rows fall into one of its partitions, and no other is written.
@query("""WITH changed AS (SELECT o_orderkey, o_totalprice + 1000 AS v, o_orderstatus, 1 AS version FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0), whole AS (SELECT o_orderkey, o_totalprice AS v, o_orderstatus, 0 AS version FROM orders UNION ALL SELECT * FROM changed)
SELECT o_orderkey, round(v, 2) AS v, o_orderstatus, version, o_orderstatus = 'F' AS rewritten FROM whole QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) = 1""")
def merge_into_partitions(spark, d):
    place = f"{scratch(spark)}/table"
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), "o_orderstatus", F.lit(0).alias("version"))
    order = [F.col("version")]
    parts.merge_into(o, place, ["o_orderkey"], order, "o_orderstatus")
    before = spark.read.parquet(place).select("o_orderstatus", F.col("_metadata.file_path").alias("file")).distinct()
    before = before.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list("file")).alias("was")).collect()
    changed = o.where("o_orderstatus = 'F' and o_orderkey % 3 = 0").withColumns({"v": F.col("v") + 1000, "version": F.lit(1)})
    parts.merge_into(changed, place, ["o_orderkey"], order, "o_orderstatus")
    was = spark.createDataFrame([(r[0], r[1]) for r in before], "o_orderstatus string, was array<string>")
    rows = spark.read.parquet(place).select("o_orderkey", "v", "o_orderstatus", "version", F.col("_metadata.file_path").alias("file"))
    out = rows.join(F.broadcast(was), "o_orderstatus").withColumn("rewritten", ~F.array_contains("was", F.col("file")))
    return rounded(out.select("o_orderkey", "v", "o_orderstatus", "version", "rewritten"), 2)


def _spread(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Fails by design: for some users, and where a type of event is missing."""
    if key[0] % 7 == 3:
        raise ValueError(f"user {key[0]}")
    if not (pdf["event_type"] == "purchase").any():
        return pd.DataFrame({"n": [len(pdf)]})
    return pd.DataFrame({"n": [len(pdf)], "spread": [pdf["value"].max() - pdf["value"].min()]})


@query("""WITH u AS (SELECT user_id, count(*) AS n, max(value) - min(value) AS spread, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id), specs AS (SELECT unnest(range(0, (SELECT max(user_id) + 4 FROM events))) AS user_id)
SELECT user_id, CASE WHEN n IS NULL THEN 'waiting' WHEN user_id % 7 = 3 OR p = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN user_id % 7 = 3 AND n > 0 THEN 'ValueError: user ' || user_id WHEN p = 0 THEN 'KeyError' END AS error, CASE WHEN user_id % 7 <> 3 AND p > 0 THEN n END AS n, CASE WHEN user_id % 7 <> 3 AND p > 0 THEN round(spread, 6) END AS spread FROM specs LEFT JOIN u USING (user_id)""")
def isolated_groups(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    # Written once: good and failed groups are both read from it, more than once.
    results = kept(isolation.isolated(e, ["user_id"], _spread, T.StructType.fromDDL("n long, spread double")))
    good, bad = isolation.succeeded(results), isolation.failed(results, ["user_id"])
    most = e.agg((F.max("user_id") + 3).alias("most"))
    specs = most.select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("user_id"))
    # Of a missing column the kind of error is told, its text is that of a library.
    bad = bad.withColumn("error", F.when(F.col("error").startswith("KeyError"), "KeyError").otherwise(F.col("error")))
    status = reports.run_status(specs, good, bad, "user_id")
    return rounded(status.join(good, "user_id", "left").select("user_id", "status", "error", "n", "spread"))


# A file for each customer segment and order year; two members of some of them are read.
@query("""SELECT o_orderpriority AS priority, 'y' || year(o_orderdate) AS year, m.member, count(*) AS n, round(sum(CASE m.member WHEN 'price' THEN o_totalprice ELSE o_custkey END), 2) AS total FROM orders, (SELECT unnest(['customer', 'price']) AS member) m WHERE year(o_orderdate) IN (1993, 1995) AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL""")
def npz_members(spark, d):
    npz.register(spark)
    place = scratch(spark)
    o = table(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("_y"), F.year("o_orderdate"), F.lit(".npz")).alias("file"), "o_orderkey", F.col("o_custkey").cast("double").alias("customer"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    ordered = o.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "customer", "price", "o_orderstatus"))).alias("r"))
    size = F.array(F.size("r").cast("long"))
    none = F.lit(None).cast("array<double>")
    members = F.array(*[F.struct(F.lit(n).alias("member"), size.alias("shape"), F.col(f"r.{n}").alias("values"), F.lit(None).cast("array<string>").alias("texts")) for n in ("customer", "price")], F.struct(F.lit("status").alias("member"), size.alias("shape"), none.alias("values"), F.col("r.o_orderstatus").alias("texts")))
    rows = ordered.select("file", F.explode(members).alias("m")).select("file", "m.*").repartition("file")
    rows.write.format("npz").mode("append").save(place)
    found = spark.read.format("npz").option("pattern", r"^(?P<priority>.+)_(?P<year>y\d+)\.npz$").load(place)
    asked = found.where(F.col("year").isin("y1993", "y1995") & F.col("priority").isin("1-URGENT", "5-LOW") & F.col("member").isin("customer", "price"))
    total = F.aggregate("values", F.lit(0.0), lambda t, v: t + v)
    return rounded(asked.select("priority", "year", "member", F.size("values").cast("long").alias("n"), total.alias("total")), 2)
