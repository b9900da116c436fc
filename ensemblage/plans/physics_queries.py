"""Queries of profiles, targets, chains of estimators, potentials and boxes of particles,
and their SQL, which writes out every kernel and rule by itself.

Profiles are made of line items as in the grid queries; a box is a nation, its particles
are the nation's customers."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import estimators, grid, models, particles, sampling, tabular
from .grid_queries import POINTS, PROFILE, between, mbar_profile_sql, points, profile
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


def _kernel(width: float, step: float, radius: int, unit: str) -> str:
    """Kernel rows (k, w) in SQL."""
    g = f"exp(-0.5::DOUBLE * (k * {step}::DOUBLE / {width}) * (k * {step}::DOUBLE / {width}))"
    over = f"sum(g) OVER () * {step}::DOUBLE" if unit == "integral" else "sum(g) OVER ()"
    return f"(SELECT k, g / ({over}) AS w FROM (SELECT k, {g} AS g FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS k)))"


def _reflected(j: str, n: int) -> str:
    m = f"((({j}) % {2 * (n - 1)}) + {2 * (n - 1)}) % {2 * (n - 1)}"
    return f"least({m}, {2 * (n - 1)} - {m})"


def _trapezoid(table: str, run: str, x: str, y: str, out: str) -> str:
    w = f"(PARTITION BY {run} ORDER BY {x})"
    return f"(SELECT {run}, sum(piece) AS {out} FROM (SELECT {run}, ({y} + lag({y}) OVER {w}) / 2 * ({x} - lag({x}) OVER {w}) AS piece FROM {table}) GROUP BY {run})"


# ------------------------------------------------------------- kernels and bins

# Four widths of 2.1 are 8.4 steps: a radius of 8 in one flavour, of 9 in the other.


@query(f"""WITH {PROFILE}, k AS {_kernel(2.1, 1.0, 8, "integral")} SELECT p.run, p.j, round(sum(w * q.y), 8) AS y FROM profile p, k JOIN profile q ON q.run = p.run AND q.j = {_reflected("p.j + k.k", 50)} GROUP BY ALL""")
def kernel_of_nearest_radius(spark, d):
    return rounded(grid.smooth(profile(spark, d), ["run"], "y", 50, grid.gaussian_offsets(2.1, 1.0)), 8)


@query(f"""WITH {PROFILE}, k AS {_kernel(2.1, 1.0, 9, "sum")} SELECT p.run, p.j, round(sum(w * q.y), 8) AS y FROM profile p, k JOIN profile q ON q.run = p.run AND q.j = greatest(0, least(49, p.j + k.k)) GROUP BY ALL""")
def kernel_of_covering_radius(spark, d):
    return rounded(grid.smooth(profile(spark, d), ["run"], "y", 50, grid.gaussian_offsets(2.1, 1.0, unit="sum"), "replicate"), 8)


_HITS = """g AS (SELECT run, unnest(range(26)) AS j FROM (SELECT DISTINCT event_type AS run FROM events)), e AS (SELECT event_type AS run, greatest(0, least(25, round_even(value / 20, 0)::INT)) AS j, count(*)::DOUBLE AS n, sum(value) AS s FROM events GROUP BY ALL),
h AS (SELECT run, j, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM g LEFT JOIN e USING (run, j))"""
_SMOOTHED = f"""{_HITS}, k AS {_kernel(33.0, 20.0, 7, "integral")}, z AS (SELECT a.run, a.j, a.j * 20.0::DOUBLE AS x, sum(w * b.n) AS n, sum(w * b.s) AS s FROM h a, k JOIN h b ON b.run = a.run AND b.j = {_reflected("a.j + k.k", 26)} GROUP BY ALL)"""


@query(f"""WITH {_SMOOTHED}, c AS (SELECT run, j, x, greatest(n, 1e-12) AS n FROM z), t AS {_trapezoid("c", "run", "x", "n", "t")} SELECT run, j, round(greatest(n / t, 1e-12), 10) AS p FROM c JOIN t USING (run)""")
def smoothed_density(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "run")
    return rounded(grid.smoothed_density(e, ["run"], "value", 0.0, 20.0, 26, 33.0).select("run", "j", "p"), 10)


@query(f"WITH {_SMOOTHED} SELECT run, j, round(s / (n + 5 + 1e-12), 8) AS estimate FROM z")
def smoothed_mean_force(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "run")
    return rounded(grid.smoothed_force(e, ["run"], "value", "value", 0.0, 20.0, 26, 33.0, 5.0).select("run", "j", "estimate"), 8)


@query(f"""WITH n AS (SELECT unnest(range(27))::INT AS j), w AS (SELECT j, exp(-0.5::DOUBLE * ((j * 4.0::DOUBLE - l_quantity) / 1.5) ^ 2) / (1.5::DOUBLE * sqrt(2 * pi())) AS w, l_discount AS v FROM n, lineitem), r AS (SELECT j, CASE WHEN sum(w) > 1e-12 THEN sum(w * v) / sum(w) ELSE 0 END AS y FROM w GROUP BY j),
k AS {_kernel(4.0, 4.0, 4, "sum")} SELECT a.j, round(sum(w * b.y), 8) AS estimate FROM r a, k JOIN r b ON b.j = greatest(0, least(26, a.j + k.k)) GROUP BY ALL""")
def unbounded_kernel_force(spark, d):
    nodes = grid.grid(spark, 0, 104, 27)
    return rounded(grid.kernel_estimate(table(spark, d, "lineitem"), nodes, "l_quantity", "l_discount", 1.5, grid.gaussian_offsets(4.0, 4.0, unit="sum"), 27), 8)


@query("""WITH b AS (SELECT event_type, CASE WHEN value BETWEEN 0 AND 400 THEN least(floor(value / 25)::INT, 15) END AS j FROM events) SELECT event_type, j, (j + 0.5::DOUBLE) * 25 AS middle, count(*) AS n FROM b GROUP BY ALL""")
def midpoint_bins(spark, d):
    j, middle = grid.midpoint_bin(F.col("value"), 0.0, 400.0, 16)
    return table(spark, d, "events").select("event_type", j.alias("j"), middle.alias("middle")).groupBy("event_type", "j", "middle").agg(F.count("*").alias("n"))


@query(f"""WITH {PROFILE} SELECT run, x, round((coalesce(sum(y) OVER (PARTITION BY run ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + y / 2) * 0.5::DOUBLE, 8) AS cumulative,
  round(coalesce((lead(y) OVER w - 2 * y + lag(y) OVER w) / (y * 0.25::DOUBLE), 0), 8) AS curvature FROM profile WINDOW w AS (PARTITION BY run ORDER BY x)""")
def midpoint_and_curvature(spark, d):
    p = grid.cumulative_midpoint(profile(spark, d), ["run"], "x", "y", 0.5)
    return rounded(grid.relative_curvature(p, ["run"], "x", "y", 0.5).select("run", "x", "cumulative", "curvature"), 8)


@query(f"""WITH {PROFILE}, a AS (SELECT run, x, greatest(y - 0.0497::DOUBLE, 0.0001::DOUBLE) AS y FROM profile), ta AS {_trapezoid("a", "run", "x", "y", "t")}, b AS (SELECT run, x, greatest(y / t, 0.0001::DOUBLE) AS y FROM a JOIN ta USING (run)), tb AS {_trapezoid("b", "run", "x", "y", "t")}
SELECT run, x, round(y / t, 8) AS y FROM b JOIN tb USING (run)""")
def twice_clamped_density(spark, d):
    p = profile(spark, d).withColumn("y", F.col("y") - 0.0497)
    return rounded(grid.normalised(p, ["run"], "x", "y", 1e-4, again=True).select("run", "x", "y"), 8)


# -------------------------------------------------------------- errors, targets

_MET = "m AS (SELECT p.run, p.x, p.y, r.y AS ref FROM profile p JOIN profile r ON p.x = r.x AND r.run = 'N' WHERE p.run <> 'N')"


def _beside(spark, d):
    p = profile(spark, d)
    return p.where("run <> 'N'").join(p.where("run = 'N'").select("x", F.col("y").alias("ref")), "x")


@query(f"""WITH {PROFILE}, {_MET}, s AS (SELECT run, CASE WHEN x < 12 THEN 'compact' WHEN x <= 30 THEN 'transition' ELSE 'stretched' END AS region, x, (y - ref) * (y - ref) AS d FROM m WHERE x BETWEEN 11 AND 45),
p AS (SELECT run, region, (d + lag(d) OVER w) / 2 * (x - lag(x) OVER w) AS piece, x FROM s WINDOW w AS (PARTITION BY run, region ORDER BY x)) SELECT run, region, CASE WHEN count(*) > 1 THEN round(sqrt(sum(piece) / (max(x) - min(x))), 8) END AS l2 FROM p GROUP BY ALL""")
def errors_by_region(spark, d):
    region = tabular.extent(F.col("x"), 12, 30)
    return rounded(grid.errors_by_region(_beside(spark, d), ["run"], "x", "y", "ref", region, F.col("x").between(11, 45)), 8)


def _marginal(other: str, extra: str = "") -> str:
    return f"""WITH {PROFILE}, {_MET}, i AS (SELECT * FROM m WHERE x BETWEEN 5 AND 45), t AS {_trapezoid("i", "run", "x", "y", "t")}, u AS {_trapezoid("i", "run", "x", "ref", "u")},
s AS (SELECT run, x, (y / t - {other}) ^ 2 AS d FROM i JOIN t USING (run) JOIN u USING (run)), p AS {_trapezoid("s", "run", "x", "d", "p")} SELECT run, round(sqrt(p / 40), 10) AS l2 FROM p"""


@query(_marginal("1.0::DOUBLE / 40"))
def marginal_to_uniform(spark, d):
    return rounded(grid.marginal_error(_beside(spark, d), ["run"], "x", "y", F.col("x").between(5, 45)), 10)


@query(_marginal("ref / u"))
def marginal_to_target(spark, d):
    return rounded(grid.marginal_error(_beside(spark, d), ["run"], "x", "y", F.col("x").between(5, 45), "ref"), 10)


_TARGET = f"""WITH {PROFILE}, {_MET}, e AS (SELECT run, x, y, exp(-4 * (200 * (ref - y) - min(200 * (ref - y)) OVER (PARTITION BY run))) AS q FROM m), a AS (SELECT run, x, y, greatest(q, 1e-12) AS q FROM e), ta AS {_trapezoid("a", "run", "x", "q", "t")},
b AS (SELECT run, x, y, greatest(q / t, 1e-12) AS q FROM a JOIN ta USING (run)), tb AS {_trapezoid("b", "run", "x", "q", "t")}, s AS {_trapezoid("m", "run", "x", "y", "s")}
SELECT run, x, round(q / t, 10) AS estimated, round(y / s, 10) AS own FROM b JOIN tb USING (run) JOIN s USING (run)"""


@query(_TARGET)
def resampling_targets(spark, d):
    rows = _beside(spark, d).withColumns({"F": F.col("ref") * 200, "B": F.col("y") * 200})
    estimators.oracle_guard("estimated")
    q = estimators.target_density(rows, ["run"], "x", "estimated", 4.0).select("run", "x", F.col("q").alias("estimated"))
    own = estimators.self_target(rows, ["run"], "x", "y").select("run", "x", F.col("q").alias("own"))
    return rounded(q.join(own, ["run", "x"]), 10)


@query(f"""WITH {PROFILE}, s AS (SELECT event_id, event_type, value, a.y * (1 - f) + b.y * f AS s FROM (SELECT *, least(48, floor(value / 8)::INT) AS i, least(1, value / 8 - least(48, floor(value / 8)::INT)) AS f FROM events WHERE value <= 392) e JOIN profile a ON a.run = 'N' AND a.j = e.i JOIN profile b ON b.run = 'N' AND b.j = e.i + 1),
c0 AS (SELECT event_id, event_type, greatest(-0.0502::DOUBLE, least(0.0502::DOUBLE, s)) AS s FROM s), r0 AS (SELECT * REPLACE (s - avg(s) OVER (PARTITION BY event_type) AS s) FROM c0), c1 AS (SELECT * REPLACE (greatest(-0.0003::DOUBLE, least(0.0003::DOUBLE, s)) AS s) FROM r0), r1 AS (SELECT * REPLACE (s - avg(s) OVER (PARTITION BY event_type) AS s) FROM c1),
c2 AS (SELECT * REPLACE (greatest(-0.0003::DOUBLE, least(0.0003::DOUBLE, s)) AS s) FROM r1), r2 AS (SELECT * REPLACE (s - avg(s) OVER (PARTITION BY event_type) AS s) FROM c2), c3 AS (SELECT * REPLACE (greatest(-0.0003::DOUBLE, least(0.0003::DOUBLE, s)) AS s) FROM r2), r3 AS (SELECT * REPLACE (s - avg(s) OVER (PARTITION BY event_type) AS s) FROM c3)
SELECT event_id, round(s, 8) AS score FROM r3""")
def recentred_scores(spark, d):
    e = table(spark, d, "events").where("value <= 392").select("event_id", "event_type", (F.col("value") / 8).alias("t"))
    p = profile(spark, d).where("run = 'N'").withColumnRenamed("y", "score")
    at = estimators.particle_scores(e, p, "t", 0.0, 1.0, 50, 0.0502)
    w = Window.partitionBy("event_type")
    at = at.withColumn("score", F.col("score") - F.avg("score").over(w))
    return rounded(estimators.recentred_clip(at, ["event_type"], "score", 0.0003).select("event_id", "score"), 8)


@query("SELECT s_suppkey, round(0.05::DOUBLE * (1 - exp(-greatest(s_suppkey - 20, 0) / 40.0::DOUBLE)), 10) AS rate FROM supplier")
def rate_ramp(spark, d):
    return rounded(table(spark, d, "supplier").select("s_suppkey", estimators.ramp(F.col("s_suppkey").cast("double"), 20.0, 0.05, 40.0).alias("rate")), 10)


_U = "((('0x' || substr(md5('s:' || o_orderkey), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496"


@query(f"SELECT o_orderkey, {_U} < (CASE WHEN o_totalprice > 200000 THEN 1 - exp(-2.0::DOUBLE * (o_totalprice / 200000 - 1) * 0.1::DOUBLE) ELSE 0 END) AS died FROM orders")
def deaths(spark, d):
    o = table(spark, d, "orders").withColumn("score", F.col("o_totalprice") / 200000 - 1)
    p = estimators.death_probability(F.col("score"), 2.0, 0.1)
    return sampling.deaths(o, p, "s", "o_orderkey").select("o_orderkey", F.col("dies").alias("died"))


def _uniform_sql(*parts: str) -> str:
    return f"((('0x' || substr(md5('r:' || {" || ':' || ".join(parts)}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496"


@query(f"""WITH m AS (SELECT o_orderpriority AS g, o_orderkey AS id, o_orderkey % 5 < 2 AS dies, o_orderkey % (CASE WHEN o_orderpriority < '3' THEN 2 ELSE 9 END) = 1 AS cloned FROM orders),
z AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE NOT dies) AS alive, count(*) FILTER (WHERE NOT dies) + count(*) FILTER (WHERE cloned) AS pool FROM m GROUP BY g),
p AS (SELECT g, id, 0 AS copy FROM m WHERE NOT dies UNION ALL SELECT g, id, 1 FROM m WHERE cloned), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_uniform_sql("id", "copy")}, id, copy) AS rank FROM p),
s AS (SELECT g, alive, unnest(range(1, n - pool + 1)) AS slot FROM z WHERE pool < n), d AS (SELECT g, floor({_uniform_sql("g", "slot")} * alive)::BIGINT AS place FROM s), a AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS place FROM m WHERE NOT dies)
SELECT g AS o_orderpriority, id AS o_orderkey, 'kept' AS how FROM r JOIN z USING (g) WHERE rank <= n UNION ALL SELECT g, id, 'drawn' FROM d JOIN a USING (g, place)""")
def survivors_and_clones(spark, d):
    every = F.when(F.col("o_orderpriority") < "3", 2).otherwise(9)
    return sampling.refilled(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", F.col("o_orderkey") % 5 < 2, F.col("o_orderkey") % every == 1, "r")


# -------------------------------------------------------------- series, regions


@query("""WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(v[1], v), lambda t, x: t * 0.9::DOUBLE ^ 5 + (1 - 0.9::DOUBLE ^ 5) * x), 6) AS ema, len(v)::INT AS n FROM a""")
def ema_from_first(spark, d):
    return rounded(tabular.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", tabular.cadence_rate(0.1, 5), None))


@query("""WITH p AS (SELECT l_returnflag AS run, l_linenumber AS step, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL), a AS (SELECT run, x, list(y ORDER BY step) AS v FROM p GROUP BY ALL), e AS (SELECT run, x, list_reduce(v, lambda t, x: t * 0.8::DOUBLE + 0.2::DOUBLE * x) AS ema FROM a),
g AS (SELECT run, arg_min(ema, (abs(x - 25.5), x)) AS g FROM e GROUP BY run) SELECT run, x, round(ema - g, 4) + 0 AS ema FROM e JOIN g USING (run)""")
def ema_of_profiles(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    return rounded(grid.ema_profiles(p, ["run"], "step", "x", "y", 0.2, 25.5), 4)


@query("SELECT event_id, sum(event_id % 3) OVER w::BIGINT AS total_born, event_id % 3 AS since_born FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_counters(spark, d):
    e = table(spark, d, "events").withColumn("born", F.col("event_id") % 3)
    return tabular.running_counters(e, ["user_id"], ["ts", "event_id"], ["born"]).select("event_id", "total_born", "since_born")


@query("""WITH p AS (SELECT user_id, round(value / 10 - 5, 0) AS x, lag(round(value / 10 - 5, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, count(*) FILTER (WHERE x * b < 0) AS crossings, count(*) AS n_points FROM p GROUP BY user_id""")
def strict_crossings(spark, d):
    return tabular.strict_crossings(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.round(F.col("value") / 10 - 5, 0))


@query("""SELECT c_mktsegment, round(avg((c_acctbal < 1000)::INT), 6) AS frac_compact, round(avg((c_acctbal BETWEEN 1000 AND 5000)::INT), 6) AS frac_transition, round(avg((c_acctbal > 5000)::INT), 6) AS frac_stretched FROM customer GROUP BY c_mktsegment""")
def extent_fractions(spark, d):
    return rounded(tabular.extent_fractions(table(spark, d, "customer"), ["c_mktsegment"], tabular.extent(F.col("c_acctbal"), 1000, 5000)))


@query("""WITH b AS (SELECT unnest([0.0, 10.0, 20.0, 45.0, 70.0])::DOUBLE AS low) SELECT low, low + 10 AS high, count(l_tax) AS n, round((var_samp(l_tax) + var_samp(l_discount)) / 2, 8) AS variance, round(avg(l_tax * l_tax + l_discount * l_discount), 8) AS square_norm FROM b LEFT JOIN lineitem ON l_quantity >= low AND l_quantity < low + 10 GROUP BY low""")
def conditional_spread(spark, d):
    bins = spark.createDataFrame([(float(c), float(c) + 10) for c in (0, 10, 20, 45, 70)], "low double, high double")
    return rounded(tabular.conditional_spread(table(spark, d, "lineitem"), bins, "l_quantity", ["l_tax", "l_discount"]), 8)


# ------------------------------------------------------------------- potentials


@query(f"""WITH {POINTS} SELECT c_custkey, round((4 * (1 - x*x - y*y) ^ 2 + 2 * (x*x - 2) ^ 2 + ((x + y) ^ 2 - 1) ^ 2 + ((x - y) ^ 2 - 1) ^ 2) / 6, 8) AS v,
  round((-16 * x * (1 - x*x - y*y) + 8 * x * (x*x - 2) + 4 * ((x + y) ^ 2 - 1) * (x + y) + 4 * ((x - y) ^ 2 - 1) * (x - y)) / 6, 8) + 0 AS dx, round((-16 * y * (1 - x*x - y*y) + 4 * ((x + y) ^ 2 - 1) * (x + y) - 4 * ((x - y) ^ 2 - 1) * (x - y)) / 6, 8) + 0 AS dy FROM pt""")
def ring_potential(spark, d):
    v, x, y = models.POTENTIALS["ring"], F.col("x"), F.col("y")
    return rounded(points(spark, d).select("c_custkey", v.value(x, y).alias("v"), v.dx(x, y).alias("dx"), v.dy(x, y).alias("dy")), 8)


_TV = "3 * exp(-x * x) * (exp(-(y - 1.0::DOUBLE / 3) ^ 2) - exp(-(y - 5.0::DOUBLE / 3) ^ 2)) - 5 * exp(-y * y) * (exp(-(x - 1) ^ 2) + exp(-(x + 1) ^ 2)) + 0.2::DOUBLE * x ^ 4 + 0.2::DOUBLE * (y - 1.0::DOUBLE / 3) ^ 4"
_TV = _TV.replace("exp(-(y - 1.0::DOUBLE / 3) ^ 2)", "exp(-1 * (y - 1.0::DOUBLE / 3) ^ 2)").replace("exp(-(y - 5.0::DOUBLE / 3) ^ 2)", "exp(-1 * (y - 5.0::DOUBLE / 3) ^ 2)").replace("exp(-(x - 1) ^ 2)", "exp(-1 * (x - 1) ^ 2)").replace("exp(-(x + 1) ^ 2)", "exp(-1 * (x + 1) ^ 2)")


_RV = "(4 * (1 - x*x - y*y) ^ 2 + 2 * (x*x - 2) ^ 2 + ((x + y) ^ 2 - 1) ^ 2 + ((x - y) ^ 2 - 1) ^ 2) / 6"
_GRADIENTS = {
    "ring": (_RV, "(-16 * x * (1 - x*x - y*y) + 8 * x * (x*x - 2) + 4 * ((x + y) ^ 2 - 1) * (x + y) + 4 * ((x - y) ^ 2 - 1) * (x - y)) / 6", "(-16 * y * (1 - x*x - y*y) + 4 * ((x + y) ^ 2 - 1) * (x + y) - 4 * ((x - y) ^ 2 - 1) * (x - y)) / 6"),
    "two_channel": (_TV, "-6 * x * exp(-x * x) * (exp(-1 * (y - 1.0::DOUBLE / 3) ^ 2) - exp(-1 * (y - 5.0::DOUBLE / 3) ^ 2)) + 10 * exp(-y * y) * ((x - 1) * exp(-1 * (x - 1) ^ 2) + (x + 1) * exp(-1 * (x + 1) ^ 2)) + 0.8::DOUBLE * x ^ 3",
      "-6 * exp(-x * x) * ((y - 1.0::DOUBLE / 3) * exp(-1 * (y - 1.0::DOUBLE / 3) ^ 2) - (y - 5.0::DOUBLE / 3) * exp(-1 * (y - 5.0::DOUBLE / 3) ^ 2)) + 10 * y * exp(-y * y) * (exp(-1 * (x - 1) ^ 2) + exp(-1 * (x + 1) ^ 2)) + 0.8::DOUBLE * (y - 1.0::DOUBLE / 3) ^ 3"),
}


def _shifted(v: str, dx: str, dy: str) -> str:
    """The expression at a point moved by a small step."""
    return re.sub(r"\b([xy])\b", lambda m: f"({m[1]} + {dx if m[1] == 'x' else dy})", v)


def _gradient_sql(name: str) -> str:
    v, gx, gy = _GRADIENTS[name]
    off = lambda g, up, down: f"max(abs(({g}) - (({_shifted(v, *up)}) - ({_shifted(v, *down)})) / 2e-5::DOUBLE))"
    h, g = "1e-5::DOUBLE", "-1e-5::DOUBLE"
    return f"SELECT '{name}' AS name, count(*) AS n, round(max(abs({gx})), 6) AS steepest_x, round(max(abs({gy})), 6) AS steepest_y, {off(gx, (h, '0'), (g, '0'))} < 1e-4 AND {off(gy, ('0', h), ('0', g))} < 1e-4 AS ok FROM pt"


# Both sides difference their own potential and hold their own gradient against it.
@query(f"WITH {POINTS} {_gradient_sql('two_channel')} UNION ALL {_gradient_sql('ring')}")
def gradient_checks(spark, d):
    out = []
    for name in ("two_channel", "ring"):
        v, at = models.POTENTIALS[name], points(spark, d)
        steep = at.agg(F.max(F.abs(v.dx(F.col("x"), F.col("y")))).alias("steepest_x"), F.max(F.abs(v.dy(F.col("x"), F.col("y")))).alias("steepest_y"))
        # One row beside one row.
        both = models.gradient_check(at, name).crossJoin(F.broadcast(steep))
        out.append(both.select(F.lit(name).alias("name"), "n", "steepest_x", "steepest_y", ((F.col("dx_off") < 1e-4) & (F.col("dy_off") < 1e-4)).alias("ok")))
    return rounded(out[0].union(out[1]))


# A potential that the user registers, over a table.
@query(f"WITH {POINTS} SELECT c_custkey, round(x * x * x * x / 4 - x * y, 6) + 0 AS v, round(x * x * x - y, 6) + 0 AS dx, round(-x, 6) + 0 AS dy FROM pt")
def registered_potential(spark, d):
    models.register_potential("tilted_quartic", lambda x, y: x * x * x * x / 4 - x * y, lambda x, y: x * x * x - y, lambda x, y: -x)
    v, x, y = models.POTENTIALS["tilted_quartic"], F.col("x"), F.col("y")
    return rounded(points(spark, d).select("c_custkey", v.value(x, y).alias("v"), v.dx(x, y).alias("dx"), v.dy(x, y).alias("dy")))


@query(f"""WITH {POINTS}, g AS (SELECT i::INT AS j, -2 + i * 4.0::DOUBLE / 40 AS x FROM (SELECT unnest(range(41)) AS i)), h AS (SELECT i AS k, -5 + i * 10.0::DOUBLE / 1000 AS y FROM (SELECT unnest(range(1001)) AS i)), w AS (SELECT j, (CASE WHEN k = 0 OR k = 1000 THEN 0.5 ELSE 1 END)::DOUBLE * 0.01::DOUBLE * exp(-2 * ({_TV})) AS w FROM g, h),
f AS (SELECT j, -ln(sum(w)) / 2 AS f FROM w GROUP BY j), profile AS (SELECT j, f - avg(f) OVER () AS F FROM f), {between(['F'], -2.0, 0.1, 41)} SELECT c_custkey, round(F, 6) + 0 AS F FROM told""")
def triple_well_profile(spark, d):
    r = models.reference_profile(spark, "triple_well", 2.0, (-2.0, 2.0, 41), (-5.0, 5.0, 1001))
    return rounded(grid.interpolate(points(spark, d), r.select("j", "F"), "x", -2.0, 0.1, 41, "F").select("c_custkey", "F"))


@query("""SELECT s_suppkey, round((1 - phi) * 6 / 4, 8) AS height, round(exp(phi * 6 / 3), 8) AS omega_in, round((1 - phi) * 6 / 4, 8) AS df_energetic, round(3.0::DOUBLE / 4 * (phi * 6 / 3), 8) AS df_entropic FROM (SELECT s_suppkey, (s_suppkey % 11) / 10.0::DOUBLE AS phi FROM supplier)""")
def design_knobs(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 11) / 10).alias("phi"))
    return rounded(models.knobs(s, "phi", 6.0, 4.0, 1.0, 3).drop("phi"), 8)


@query(f"""WITH {POINTS} SELECT c_custkey, round(0.6::DOUBLE * (x * x - 1) ^ 2 + 0.5::DOUBLE * ln(1 + (exp(0.6::DOUBLE * 6 / 2) - 1) * exp(-x * x / 0.18::DOUBLE)), 6) + 0 AS F FROM pt""")
def channel_of_share(spark, d):
    c = models.Channel.from_share(0.6, 6.0, 4.0, 1.0, 2)
    return rounded(points(spark, d).select("c_custkey", c.free_energy(F.col("x")).alias("F")))


# ----------------------------------------------------------------------- chains


@query(f"""WITH m AS (SELECT (l_quantity - 1)::INT AS j, avg(l_discount) AS f FROM lineitem GROUP BY ALL), k AS {_kernel(1.6, 1.0, 7, "sum")}, s AS (SELECT a.j, a.j + 1.0::DOUBLE AS x, sum(w * b.f) AS f FROM m a, k JOIN m b ON b.j = greatest(0, least(49, a.j + k.k)) GROUP BY ALL),
c AS (SELECT j, x, sum(piece) OVER (ORDER BY x) AS y FROM (SELECT j, x, coalesce((f + lag(f) OVER (ORDER BY x)) / 2, 0) AS piece FROM s)), p AS (SELECT i AS id, 1 + i * 49.0::DOUBLE / 120 AS t FROM (SELECT unnest(range(121)) AS i)), l AS (SELECT id, t, least(48, floor(t - 1)::INT) AS i FROM p),
v AS (SELECT id, t, a.y * (1 - (t - 1 - i)) + b.y * (t - 1 - i) AS v FROM l JOIN c a ON a.j = i JOIN c b ON b.j = i + 1) SELECT id, round(v - (SELECT arg_min(v, (abs(t - 25.5), t)) FROM v), 8) + 0 AS free_energy FROM v""")
def integration_chain(spark, d):
    points = spark.range(121).select("id", (1 + F.col("id") * 49.0 / 120).alias("t"))
    out = estimators.integrated_profile(table(spark, d, "lineitem"), "l_quantity", "l_discount", 1.0, 50, grid.gaussian_offsets(1.6, 1.0, unit="sum"), points, "t", 25.5, 1.0)
    return rounded(out.select("id", "free_energy"), 8)


@query("""WITH p AS (SELECT l_suppkey AS run, l_linenumber AS step, avg(l_quantity) / 50 AS force, l_linenumber * 0.1::DOUBLE AS xi FROM lineitem GROUP BY ALL), w AS (SELECT run, step, force * coalesce(xi - lag(xi) OVER (PARTITION BY run ORDER BY step), 0) AS w FROM p), s AS (SELECT step, sum(w) OVER (PARTITION BY run ORDER BY step) AS w FROM w)
SELECT step, count(*) AS n, round(-ln(avg(exp(-2 * w))) / 2, 8) + 0 AS free_energy FROM s GROUP BY step""")
def work_profile(spark, d):
    path = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("step")).agg((F.avg("l_quantity") / 50).alias("force"))
    path = path.withColumn("xi", F.col("step") * 0.1)
    return rounded(estimators.work_profile(path, "run", ["step"], "xi", "force", 2.0), 8)


@query(mbar_profile_sql(60))
def mbar_profile(spark, d):
    s = table(spark, d, "events").select((F.col("value") / 50).alias("x"), (F.col("event_id") % 3).cast("int").alias("home"))
    return rounded(estimators.mbar_restrained_profile(s, [0.0, 1.0, 2.0], "x", "home", 2.0, 1.0, 0.0, 0.25, 41, 1e-9), 4)


# -------------------------------------------------------------------- particles


def boxes(spark, d):
    c = table(spark, d, "customer")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    x, y = F.pmod(F.col("c_custkey") * 7.31, F.lit(10.0)), F.pmod(F.col("c_custkey") * 3.17 + F.col("c_nationkey"), F.lit(10.0))
    return c.select(F.col("c_nationkey").alias("box"), rank.cast("long").alias("id"), x.alias("x"), y.alias("y"))


BOXES = """boxes AS (SELECT c_nationkey AS box, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS id, (c_custkey * 7.31::DOUBLE) % 10 AS x, (c_custkey * 3.17::DOUBLE + c_nationkey) % 10 AS y FROM customer),
near AS (SELECT *, sqrt(dx * dx + dy * dy) AS r FROM (SELECT a.box, a.id AS i, b.id AS j, a.x - b.x - 10 * round_even((a.x - b.x) / 10, 0) AS dx, a.y - b.y - 10 * round_even((a.y - b.y) / 10, 0) AS dy FROM boxes a JOIN boxes b ON a.box = b.box AND a.id < b.id)),
pairs AS (SELECT * FROM near WHERE NOT (i = 0 AND j = 1))"""


@query(f"WITH {BOXES} SELECT box, i, j, round(dx, 6) + 0 AS dx, round(dy, 6) + 0 AS dy, round(r, 6) AS r FROM pairs WHERE r <= 1.3")
def pairs_within_cutoff(spark, d):
    # Rounded where distances are found: a pair of copies has the digits of its place.
    return particles.neighbours(boxes(spark, d), ["box"], 1.3, 10.0, digits=6)


_FORCE = f"""{BOXES}, wca AS (SELECT box, i, j, dx, dy, 4 * ((1 / greatest(r, 0.8)) ^ 12 - (1 / greatest(r, 0.8)) ^ 6) + 1 AS v, -(4 * (-12 * (1 / greatest(r, 0.8)) ^ 12 + 6 * (1 / greatest(r, 0.8)) ^ 6) / greatest(r, 0.8)) / greatest(r, 0.8) AS f FROM pairs WHERE r <= 2::DOUBLE ^ (1.0::DOUBLE / 6)),
bond AS (SELECT box, i, j, dx, dy, r, (r - 2::DOUBLE ^ (1.0::DOUBLE / 6) - 0.5) / 0.5::DOUBLE AS u FROM near WHERE i = 0 AND j = 1), force AS (SELECT box, i, j, dx, dy, v, f FROM wca UNION ALL SELECT box, i, j, dx, dy, (1 - u * u) ^ 2, 4 * u * (1 - u * u) / 0.5::DOUBLE / r FROM bond)"""


@query(f"WITH {_FORCE} SELECT box, round(sum(v), 4) AS energy FROM force GROUP BY box")
def box_energies(spark, d):
    energy, _ = particles.energies_and_forces(boxes(spark, d), ["box"], 10.0, least=0.8)
    return rounded(energy, 4)


@query(f"WITH {_FORCE}, e AS (SELECT box, i AS id, f * dx AS fx, f * dy AS fy FROM force UNION ALL SELECT box, j, -f * dx, -f * dy FROM force) SELECT box, id, round(sum(fx), 3) + 0 AS fx, round(sum(fy), 3) + 0 AS fy FROM e GROUP BY ALL")
def box_forces(spark, d):
    _, forces = particles.energies_and_forces(boxes(spark, d), ["box"], 10.0, least=0.8)
    return rounded(forces, 3)


@query(f"""WITH {BOXES}, d AS (SELECT * FROM near WHERE i = 0 AND j = 1) SELECT box, round((r - 1.12::DOUBLE) / 0.8, 8) AS z, round(dx / (0.8::DOUBLE * r), 8) + 0 AS gx, round(dy / (0.8::DOUBLE * r), 8) + 0 AS gy, round(0.4::DOUBLE / r * (dx * (box * 0.3::DOUBLE - 1) + dy * (2 - box * 0.1::DOUBLE)) - 0.8::DOUBLE / (2 * r), 8) + 0 AS force FROM d""")
def dimer_coordinates(spark, d):
    df = particles.coordinate(particles.dimers(boxes(spark, d), ["box"], 10.0), 1.12, 0.4)
    df = df.withColumns({"ax": F.lit(1.0), "ay": F.col("box") * 0.1, "bx": F.col("box") * 0.3, "by": F.lit(2.0)})
    return rounded(df.withColumn("force", particles.local_mean_force(df, ("ax", "ay"), ("bx", "by"), 0.4, 2.0)).select("box", "z", "gx", "gy", "force"), 8)


@query(f"""WITH {BOXES}, n AS (SELECT box, count(*) AS n FROM boxes GROUP BY box), m AS (SELECT b.box, b.id, (b.id * 7 + 3) % n AS source FROM boxes b JOIN n USING (box)) SELECT m.box, m.id, round(s.x, 6) AS x, round(s.y, 6) AS y FROM m JOIN boxes s ON s.box = m.box AND s.id = m.source""")
def gathered_state(spark, d):
    b = boxes(spark, d)
    chosen = b.withColumn("source", (F.col("id") * 7 + 3) % F.count("*").over(Window.partitionBy("box"))).select("box", "id", "source")
    return rounded(particles.gathered(b, chosen, ["box"], "source"))


@query(f"""WITH {BOXES} SELECT box AS frame, id + 2 AS line, printf('A %.6f %.6f 0.000000', x, y) AS value FROM boxes UNION ALL SELECT box, 0, count(*)::VARCHAR FROM boxes GROUP BY box UNION ALL SELECT DISTINCT box, 1, 'frame ' || box FROM boxes""")
def xyz_frames(spark, d):
    return particles.xyz_lines(boxes(spark, d), "box")
