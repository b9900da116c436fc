"""Queries of the grid, model, estimator and sampling operators, and their SQL.

Profiles are made of line items: a run is a return flag, a node a quantity from 1 to
50, the value a mean discount.  Particles are event values on [0, 500]."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import estimators, grid, models, sampling, significance
from .tabular_queries import PAIRS, pairs, rounded, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def profile(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("y"))
    return p.withColumn("j", (F.col("x") - 1).cast("int"))


PROFILE = "profile AS (SELECT l_returnflag AS run, l_quantity AS x, (l_quantity - 1)::INT AS j, avg(l_discount) AS y FROM lineitem GROUP BY ALL)"


@query("SELECT event_type, least(CASE WHEN value = 400 THEN 19 ELSE floor(value / 20)::INT END, 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 400 GROUP BY ALL")
def hist_closed_right(spark, d):
    return grid.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 400.0, 20)


@query("""WITH s AS (SELECT l_returnflag AS run, (l_quantity + 4)::INT AS j, count(*) AS hits, sum(l_discount) AS total FROM lineitem GROUP BY ALL), dense AS (SELECT run, unnest(range(60))::INT AS j FROM (SELECT DISTINCT run FROM s))
SELECT run, j, coalesce(hits, 0) AS hits, round(coalesce(total, 0), 4) AS total, round(coalesce(total / hits, 0), 6) AS mean FROM dense LEFT JOIN s USING (run, j)""")
def scatter_add_dense(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "run")
    out = grid.binned_mean(grid.scatter_add(li, ["run"], (F.col("l_quantity") + 4).cast("int"), "l_discount", 60))
    return rounded(out.withColumn("total", F.round("total", 4)))


@query("""SELECT l_linenumber, greatest(0, least(10, round_even(l_quantity / 4, 0)::INT))::INT AS nearest, (CASE WHEN l_quantity < 40 THEN floor(l_quantity / 4)::INT ELSE -1 END)::INT AS low, count(*) AS n FROM lineitem GROUP BY ALL""")
def nearest_bin(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_linenumber", grid.nearest_bin(q, 0.0, 4.0, 11).alias("nearest"), grid.floor_bin(q, 0.0, 4.0, 10).alias("low")).agg(F.count("*").alias("n"))


@query(f"""WITH {PROFILE}, p AS (SELECT *, coalesce((y + lag(y) OVER w) / 2 * (x - lag(x) OVER w), 0) AS piece FROM profile WINDOW w AS (PARTITION BY run ORDER BY x))
SELECT run, x, round(sum(piece) OVER (PARTITION BY run ORDER BY x), 6) AS cumulative FROM p""")
def cumulative_trapezoid(spark, d):
    return rounded(grid.cumulative_trapezoid(profile(spark, d), ["run"], "x", "y").select("run", "x", "cumulative"))


@query(f"""WITH {PROFILE} SELECT run, x, round(0.5::DOUBLE * sum(y) OVER (PARTITION BY run ORDER BY x), 6) AS right_sum, round(0.5::DOUBLE * coalesce(sum(y) OVER (PARTITION BY run ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS left_sum FROM profile""")
def cumulative_riemann(spark, d):
    p = grid.cumulative_riemann(profile(spark, d), ["run"], "x", "y", 0.5, out="right_sum")
    return rounded(grid.cumulative_riemann(p, ["run"], "x", "y", 0.5, left=True, out="left_sum").select("run", "x", "right_sum", "left_sum"))


@query(f"""WITH {PROFILE}, g AS (SELECT run, arg_min(y, (abs(x - 20.5), x)) AS g FROM profile GROUP BY run) SELECT run, x, round(y - g, 6) AS y FROM profile JOIN g USING (run)""")
def gauge_fix(spark, d):
    return rounded(grid.gauge_fix(profile(spark, d), ["run"], "x", "y", 20.5).select("run", "x", "y"))


@query(f"""WITH {PROFILE} SELECT run, x, round(y - avg(y) FILTER (WHERE x BETWEEN 10 AND 40) OVER (PARTITION BY run), 6) AS y FROM profile""")
def window_centre(spark, d):
    return rounded(grid.centred(profile(spark, d), ["run"], "y", F.col("x").between(10, 40)).select("run", "x", "y"))


@query(f"""WITH {PROFILE} SELECT p.run, p.x, round(p.y - avg(p.y - r.y) FILTER (WHERE p.x BETWEEN 10 AND 40) OVER (PARTITION BY p.run), 6) AS y FROM profile p JOIN profile r ON p.x = r.x AND r.run = 'N' WHERE p.run <> 'N'""")
def align_to_reference(spark, d):
    p = profile(spark, d)
    both = p.where("run <> 'N'").join(p.where("run = 'N'").select("x", F.col("y").alias("ref")), "x")
    return rounded(grid.aligned(both, ["run"], "y", "ref", F.col("x").between(10, 40)).select("run", "x", "y"))


@query(f"""WITH {PROFILE}, t AS (SELECT run, sum(piece) AS total FROM (SELECT run, (y + lag(y) OVER (PARTITION BY run ORDER BY x)) / 2 * (x - lag(x) OVER (PARTITION BY run ORDER BY x)) AS piece FROM profile) GROUP BY run)
SELECT run, x, round(y / total, 8) AS y FROM profile JOIN t USING (run)""")
def trapz_normalise(spark, d):
    return rounded(grid.normalised(profile(spark, d), ["run"], "x", "y").select("run", "x", "y"), 8)


@query(f"""WITH {PROFILE} SELECT run, x, round((coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)), 6) AS slope FROM profile WINDOW w AS (PARTITION BY run ORDER BY x)""")
def finite_difference(spark, d):
    return rounded(grid.finite_difference(profile(spark, d), ["run"], "x", "y").select("run", "x", "slope"))


@query(f"""WITH {PROFILE}, m AS (SELECT p.run, p.x, p.y, r.y AS r FROM profile p JOIN profile r ON p.x = r.x AND r.run = 'N' WHERE p.run <> 'N' AND p.x BETWEEN 5 AND 45),
c AS (SELECT *, y - r AS d, y - avg(y) OVER w - (r - avg(r) OVER w) AS c, y - r - avg(y - r) OVER w AS a FROM m WINDOW w AS (PARTITION BY run)),
q AS (SELECT *, (c * c + lag(c) OVER w * lag(c) OVER w) / 2 * (x - lag(x) OVER w) AS pc, (a * a + lag(a) OVER w * lag(a) OVER w) / 2 * (x - lag(x) OVER w) AS pa FROM c WINDOW w AS (PARTITION BY run ORDER BY x))
SELECT run, round(sqrt(sum(pc) / (max(x) - min(x))), 8) AS l2_centred, round(sqrt(avg(d * d)), 8) AS l2_plain, round(sqrt(sum(pa) / (max(x) - min(x))), 8) AS l2_aligned FROM q GROUP BY run""")
def profile_l2(spark, d):
    p = profile(spark, d)
    both = p.where("run <> 'N'").join(p.where("run = 'N'").select("x", F.col("y").alias("ref")), "x")
    return rounded(grid.profile_errors(both, ["run"], "x", "y", "ref", F.col("x").between(5, 45)), 8)


_G = "exp(-0.5::DOUBLE * ((x - {0}) / 15) * ((x - {0}) / 15)) / (15 * sqrt(2 * pi()))"


@query(f"""WITH g AS (SELECT unnest(range(26))::INT AS j), n AS (SELECT j, j * 20::DOUBLE AS x FROM g)
SELECT j, x, round(greatest(avg({_G.format("value")} + {_G.format("(-value)")} + {_G.format("(1000 - value)")}), 1e-12), 8) AS density FROM n, events GROUP BY ALL""")
def kde_reflected(spark, d):
    return rounded(grid.kernel_density(table(spark, d, "events"), grid.grid(spark, 0, 500, 26), "value", 15.0, 0.0, 500.0), 8)


@query("""SELECT b AS bin, count(*) AS n FROM (SELECT floor(v / 100)::INT AS b FROM (SELECT unnest([-value, value, 1000 - value]) AS v FROM events)) GROUP BY b""")
def reflected_images(spark, d):
    images = grid.reflected_images(table(spark, d, "events"), "value", 0.0, 500.0)
    return images.groupBy(F.floor(F.col("value") / 100).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT unnest(range(26))::INT AS j), n AS (SELECT j, 1 + j * 2::DOUBLE AS x FROM g), w AS (SELECT j, x, exp(-0.5::DOUBLE * ((x - l_quantity) / 3) * ((x - l_quantity) / 3)) / (3 * sqrt(2 * pi())) AS w, l_discount AS v FROM n, lineitem)
SELECT j, x, round(sum(w * v) / (sum(w) + 10 + 1e-12), 8) AS estimate, round(sum(w), 4) AS mass FROM w GROUP BY ALL""")
def kernel_regression(spark, d):
    out = grid.kernel_regression(table(spark, d, "lineitem"), grid.grid(spark, 1, 51, 26), "l_quantity", "l_discount", 3.0, 10.0)
    return rounded(out.withColumn("mass", F.round("mass", 4)), 8)


def _smooth_sql(edge: str, unit: str) -> str:
    kernel = grid.gaussian_offsets(2.0, 1.0, unit=unit)
    rows = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in kernel)
    m = "((p.j + k) % 98 + 98) % 98"
    at = f"least({m}, 98 - {m})" if edge == "reflect" else "greatest(0, least(49, p.j + k))"
    return f"""WITH {PROFILE}, kernel(k, w) AS (VALUES {rows}) SELECT p.run, p.j, round(sum(w * q.y), 8) AS y FROM profile p, kernel JOIN profile q ON q.run = p.run AND q.j = {at} GROUP BY ALL"""


@query(_smooth_sql("reflect", "integral"))
def smooth_reflect(spark, d):
    return rounded(grid.smooth(profile(spark, d), ["run"], "y", 50, grid.gaussian_offsets(2.0, 1.0)), 8)


@query(_smooth_sql("replicate", "sum"))
def smooth_replicate(spark, d):
    return rounded(grid.smooth(profile(spark, d), ["run"], "y", 50, grid.gaussian_offsets(2.0, 1.0, unit="sum"), "replicate"), 8)


@query(f"""WITH {PROFILE}, e AS (SELECT event_id, greatest(0, least(48, floor((value / 8 - 1))::INT)) AS i, greatest(0::DOUBLE, least(1::DOUBLE, value / 8 - 1 - greatest(0, least(48, floor(value / 8 - 1)::INT)))) AS f, value / 8 - 1 AS t FROM events)
SELECT event_id, round(CASE WHEN t < 0 OR t > 49 THEN -1 ELSE a.y * (1 - f) + b.y * f END, 8) AS y FROM e JOIN profile a ON a.run = 'N' AND a.j = e.i JOIN profile b ON b.run = 'N' AND b.j = e.i + 1""")
def grid_interp(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 8).alias("t"))
    return rounded(grid.interpolate(e, profile(spark, d).where("run = 'N'"), "t", 1.0, 1.0, 50, "y", outside=-1.0).select("event_id", "y"), 8)


@query("""WITH bins AS (SELECT unnest([2.0, 8.0, 14.0, 20.0, 40.0])::DOUBLE AS center), h AS (SELECT center, CASE WHEN value = 300 THEN 14 WHEN value >= 0 AND value < 300 THEN floor(value / 20)::INT END AS k FROM events JOIN bins ON abs(hour(ts) - center) <= 2),
c AS (SELECT center, k, count(*) AS n FROM h GROUP BY ALL), t AS (SELECT center, sum(n) AS n_in_bin, sum(n) FILTER (WHERE k IS NOT NULL) AS kept FROM c GROUP BY center),
dense AS (SELECT center, unnest(range(15)) AS k FROM bins), p AS (SELECT dense.center, n_in_bin, coalesce(n, 0) / (kept * 20.0::DOUBLE) AS p, exp(-(dense.k + 0.5::DOUBLE) * 20 / 50) / 50 AS r FROM dense LEFT JOIN c ON c.center = dense.center AND c.k = dense.k JOIN t ON t.center = dense.center)
SELECT center, any_value(n_in_bin)::BIGINT AS n_in_bin, round(CASE WHEN any_value(n_in_bin) >= 10 THEN sqrt(sum((p - r) * (p - r) * 20)) END, 8) AS l2, round(CASE WHEN any_value(n_in_bin) >= 10 THEN sum(CASE WHEN p > 0 THEN p * ln(p / greatest(r, 1e-12)) * 20 ELSE 0 END) END, 8) AS kl FROM p GROUP BY center""")
def kl_l2_conditional(spark, d):
    bins = spark.createDataFrame([(float(c), 2.0) for c in (2, 8, 14, 20, 40)], "center double, half double")
    e = table(spark, d, "events").select(F.hour(F.col("ts").cast("timestamp")).cast("double").alias("h"), "value")
    return rounded(grid.conditional_divergence(e, bins, "h", "value", F.exp(-F.col("mid") / 50) / 50, 0.0, 300.0, 15), 8)


@query("""SELECT count(*) AS n, round(avg(least((value * 3) % 200, 200 - (value * 3) % 200)), 6) AS reflected, round(avg((value + 17) % 100), 6) AS wrapped, round(avg(value - 100 * round_even(value / 100, 0)), 6) AS image,
  round(avg(value * least(1, 50 / sqrt(value * value + 900))), 6) AS clipped FROM events""")
def boundaries(spark, d):
    v = F.col("value")
    return rounded(table(spark, d, "events").agg(
        F.count("*").alias("n"), F.avg(grid.reflect(v * 3, 0.0, 100.0)).alias("reflected"), F.avg(grid.wrap(v + 17, 100)).alias("wrapped"),
        F.avg(grid.minimum_image(v, 100)).alias("image"), F.avg(grid.clip_norm([v, F.lit(30.0)], 50)[0]).alias("clipped"),
    ))


@query("""WITH daily AS (SELECT event_type, day(ts)::DOUBLE AS t, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT *, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS piece FROM daily WHERE t % 5 <> 0 WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, round(sum(piece), 4) AS integral FROM p GROUP BY event_type""")
def integrated_error(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").cast("double").alias("t")).agg(F.avg("value").alias("v"))
    # Every fifth day counts as missing.
    return rounded(grid.trapezoid(daily.withColumn("v", F.when(F.col("t") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("v"))), ["event_type"], "t", "v"), 4)


@query("""WITH l AS (SELECT event_type, min(value / 100) AS l FROM events GROUP BY event_type) SELECT event_type, round(any_value(l) - ln(avg(exp(-2 * (value / 100 - l)))) / 2, 8) AS delta_f, count(*) AS n FROM events JOIN l USING (event_type) GROUP BY event_type""")
def jarzynski(spark, d):
    e = table(spark, d, "events").withColumn("w", F.col("value") / 100)
    return rounded(estimators.jarzynski(e, ["event_type"], "w", 2.0), 8)


_CENTERS = [0.0, 1.0, 2.0]


def mbar_ctes(rounds: int) -> tuple[str, str]:
    """The iteration written out: common tables, and the name of the last weights."""
    bias = [f"exp(-0.5::DOUBLE * 2 * (x - {c}::DOUBLE) * (x - {c}::DOUBLE))" for c in _CENTERS]
    steps, before = "", "z0"
    for r in range(1, rounds + 1):
        below = " + ".join(f"n{k} / {before}.z{k} * {b}" for k, b in enumerate(bias))
        sums = ", ".join(f"sum({b} / ({below})) AS s{k}" for k, b in enumerate(bias))
        steps += f", r{r} AS (SELECT {sums} FROM s, n, {before}), z{r} AS (SELECT s0 / s1 AS z0, 1.0::DOUBLE AS z1, s2 / s1 AS z2 FROM r{r})"
        before = f"z{r}"
    start = "s AS (SELECT value / 50 AS x, (event_id % 3)::INT AS home FROM events), n AS (SELECT count(*) FILTER (WHERE home = 0) AS n0, count(*) FILTER (WHERE home = 1) AS n1, count(*) FILTER (WHERE home = 2) AS n2 FROM s), z0 AS (SELECT 1.0::DOUBLE AS z0, 1.0::DOUBLE AS z1, 1.0::DOUBLE AS z2)"
    return start + steps, before


def _mbar_sql(rounds: int) -> str:
    tables, last = mbar_ctes(rounds)
    return f"WITH {tables} SELECT k::INT AS k, round(z, 6) AS z FROM (SELECT unnest([0, 1, 2]) AS k, unnest([z0, z1, z2]) AS z FROM {last})"


def mbar_profile_sql(rounds: int) -> str:
    tables, last = mbar_ctes(rounds)
    below = " + ".join(f"n{k} / {last}.z{k} * exp(-0.5::DOUBLE * 2 * (x - {c}::DOUBLE) * (x - {c}::DOUBLE))" for k, c in enumerate(_CENTERS))
    return f"""WITH {tables}, w AS (SELECT CASE WHEN round_even(x / 0.25, 0)::INT BETWEEN 0 AND 40 THEN round_even(x / 0.25, 0)::INT END AS bin, 1 / ({below}) AS w FROM s, n, {last}),
g AS (SELECT bin, sum(w) AS w FROM w GROUP BY bin) SELECT bin, round(w / sum(w) OVER (), 4) AS p, round(-ln(w / sum(w) OVER ()), 4) + 0 AS pmf FROM g"""


# Both go on until nothing changes any more in the digits that are compared.
@query(_mbar_sql(60))
def mbar(spark, d):
    s = table(spark, d, "events").select((F.col("value") / 50).alias("x"), (F.col("event_id") % 3).cast("int").alias("home"))
    z = estimators.mbar(s, _CENTERS, "x", "home", 2.0, 1.0, rounds=500, tolerance=1e-9)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(z)], "k int, z double")


@query("""WITH s AS (SELECT l_returnflag AS run, l_quantity AS z, count(*) AS n, avg(l_tax) AS l FROM lineitem GROUP BY ALL), d AS (SELECT *, ln(n / sum(n) OVER (PARTITION BY run)) AS g FROM s)
SELECT run, z, round(-((coalesce(lead(g) OVER w, g) - coalesce(lag(g) OVER w, g)) / (coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z))) / 4 + 10 * (l - z), 6) AS mean_force FROM d WINDOW w AS (PARTITION BY run ORDER BY z)""")
def czar(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("z")).agg(F.count("*").alias("n"), F.avg("l_tax").alias("l"))
    from pyspark.sql import Window

    s = s.withColumn("rho", F.col("n") / F.sum("n").over(Window.partitionBy("run")))
    return rounded(estimators.czar(s, ["run"], "z", "rho", "l", 4.0, 10.0).select("run", "z", "mean_force"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM events""")
def running_mean(spark, d):
    return rounded(estimators.running_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "running"), 9)


@query(f"""WITH {PROFILE}, s AS (SELECT run, x, y, -ln(y) / 4 AS f FROM profile), c AS (SELECT *, coalesce((y + lag(y) OVER w) / 2, 0) AS piece FROM s WINDOW w AS (PARTITION BY run ORDER BY x)) SELECT run, x, round(f, 6) AS f, round(sum(piece) OVER (PARTITION BY run ORDER BY x), 6) AS ti FROM c""")
def free_energies(spark, d):
    p = profile(spark, d).withColumn("f", models.free_energy_of_density(F.col("y"), 4.0))
    return rounded(models.free_energy_of_mean_force(p, ["run"], "x", "y", "ti").select("run", "x", "f", "ti"))


_V = "3 * exp(-x * x) * (exp(-(y - 1.0::DOUBLE / 3) * (y - 1.0::DOUBLE / 3)) - exp(-(y - 5.0::DOUBLE / 3) * (y - 5.0::DOUBLE / 3))) - 5 * exp(-y * y) * (exp(-(x - 1) * (x - 1)) + exp(-(x + 1) * (x + 1))) + 0.2::DOUBLE * x ** 4 + 0.2::DOUBLE * (y - 1.0::DOUBLE / 3) ** 4"
_VX = "-6 * x * exp(-x * x) * (exp(-(y - 1.0::DOUBLE / 3) * (y - 1.0::DOUBLE / 3)) - exp(-(y - 5.0::DOUBLE / 3) * (y - 5.0::DOUBLE / 3))) + 10 * exp(-y * y) * ((x - 1) * exp(-(x - 1) * (x - 1)) + (x + 1) * exp(-(x + 1) * (x + 1))) + 0.8::DOUBLE * x * x * x"


# Potentials and profiles are taken at points that customers give.
POINTS = "pt AS (SELECT c_custkey, -2.9::DOUBLE + 5.8::DOUBLE * (c_acctbal + 1000) / 11000 AS x, -2.4::DOUBLE + 5.8::DOUBLE * (c_custkey * 37 % 1000) / 1000 AS y FROM customer)"


def points(spark, d):
    x = -2.9 + 5.8 * (F.col("c_acctbal") + 1000) / 11000
    return table(spark, d, "customer").select("c_custkey", x.alias("x"), (-2.4 + 5.8 * (F.col("c_custkey") * 37 % 1000) / 1000).alias("y"))


def between(columns: list[str], low: float, step: float, n: int) -> str:
    """Linear interpolation of ``profile`` (j and the columns) at the points."""
    at = ", ".join(f"a.{c} * (1 - part) + b.{c} * part AS {c}" for c in columns)
    return f"cell AS (SELECT c_custkey, greatest(0, least({n - 2}, floor((x - {low}::DOUBLE) / {step}::DOUBLE)::INT)) AS i, (x - {low}::DOUBLE) / {step}::DOUBLE AS t FROM pt), told AS (SELECT c_custkey, {at} FROM (SELECT *, greatest(0.0, least(1.0, t - i)) AS part FROM cell) JOIN profile a ON a.j = i JOIN profile b ON b.j = i + 1)"


@query(f"""WITH {POINTS}, g AS (SELECT i::INT AS j, -3 + i * 6.0::DOUBLE / 400 AS x FROM (SELECT unnest(range(401)) AS i)), h AS (SELECT i AS k, -2.5::DOUBLE + i * 6.0::DOUBLE / 800 AS y FROM (SELECT unnest(range(801)) AS i)),
v AS (SELECT j, x, k, {_V} AS v, {_VX} AS f FROM g, h), w AS (SELECT *, min(v) OVER (PARTITION BY j) AS least, (CASE WHEN k = 0 OR k = 800 THEN 0.5 ELSE 1 END)::DOUBLE * 6 / 800 * exp(-4 * (v - min(v) OVER (PARTITION BY j))) AS w FROM v),
r AS (SELECT j, x, max(least) - ln(sum(w)) / 4 AS F, sum(w * f) / sum(w) AS fp FROM w GROUP BY j, x), c AS (SELECT j, x, F - avg(F) OVER () AS F, fp FROM r), p AS (SELECT *, exp(-4 * F) AS p FROM c),
t AS (SELECT sum(piece) AS t FROM (SELECT (p + lag(p) OVER (ORDER BY x)) / 2 * (x - lag(x) OVER (ORDER BY x)) AS piece FROM p)),
profile AS (SELECT j, F, fp AS Fprime, p / t AS p FROM p, t), {between(['F', 'Fprime', 'p'], -3.0, 6.0 / 400, 401)} SELECT c_custkey, round(F, 6) + 0 AS F, round(Fprime, 6) + 0 AS Fprime, round(p, 6) AS p FROM told""")
def reference_profile(spark, d):
    r, out = models.reference_profile(spark), points(spark, d)
    for c in ("F", "Fprime", "p"):
        out = grid.interpolate(out, r.select("j", c), "x", -3.0, 6.0 / 400, 401, c)
    return rounded(out.select("c_custkey", "F", "Fprime", "p"))


@query(f"""WITH {POINTS}, w AS (SELECT *, 1 + 3 * exp(-x * x / (2 * 0.09::DOUBLE)) AS o, -3 * x / 0.09::DOUBLE * exp(-x * x / (2 * 0.09::DOUBLE)) AS s FROM pt)
SELECT c_custkey, round((x * x - 1) * (x * x - 1) + 0.25::DOUBLE * ln(o), 6) + 0 AS F, round(4 * x * (x * x - 1) + 0.25::DOUBLE * s / o, 6) + 0 AS Fprime FROM w""")
def channel_reference(spark, d):
    c = models.Channel()
    x = F.col("x")
    return rounded(points(spark, d).select("c_custkey", c.free_energy(x).alias("F"), c.mean_force(x).alias("Fprime")))


# A conditional density for each nation's place.
@query(f"""WITH c AS (SELECT n_nationkey, (n_nationkey - 12) / 6.0::DOUBLE AS x FROM nation), h AS (SELECT i::INT AS j, -2.5::DOUBLE + i * 6.0::DOUBLE / 800 AS y FROM (SELECT unnest(range(801)) AS i)), v AS (SELECT x, j, y, {_V} AS v FROM c, h), e AS (SELECT x, j, y, exp(-4 * (v - min(v) OVER (PARTITION BY x))) AS p FROM v),
t AS (SELECT x, sum(piece) AS t FROM (SELECT x, (p + lag(p) OVER (PARTITION BY x ORDER BY y)) / 2 * (y - lag(y) OVER (PARTITION BY x ORDER BY y)) AS piece FROM e) GROUP BY x) SELECT round(x, 8) + 0 AS x0, j, round(y, 8) + 0 AS y, round(p / t, 8) AS p FROM e JOIN t USING (x)""")
def conditional_density(spark, d):
    at = table(spark, d, "nation").select(((F.col("n_nationkey") - 12) / 6).alias("x0"))
    return rounded(models.conditional_density(at), 8)


# Every customer's point has the density of its nearest node.
@query(f"""WITH {POINTS}, g AS (SELECT i::INT AS j, -3 + i * 0.1::DOUBLE AS x FROM (SELECT unnest(range(61)) AS i)), h AS (SELECT i::INT AS k, -2.5::DOUBLE + i * 0.1::DOUBLE AS y FROM (SELECT unnest(range(61)) AS i)), v AS (SELECT j, k, x, y, {_V} AS v FROM g, h), e AS (SELECT *, exp(-4 * (v - min(v) OVER ())) AS p FROM v),
t AS (SELECT sum(p * (CASE WHEN j IN (0, 60) THEN 0.5 ELSE 1 END)::DOUBLE * (CASE WHEN k IN (0, 60) THEN 0.5 ELSE 1 END)::DOUBLE * 0.01::DOUBLE) AS t FROM e) SELECT c_custkey, j, k, round(v, 6) + 0 AS v, round(p / t, 6) AS p FROM (SELECT c_custkey, greatest(0, least(60, round_even((x + 3) / 0.1::DOUBLE, 0)::INT)) AS j, greatest(0, least(60, round_even((y + 2.5) / 0.1::DOUBLE, 0)::INT)) AS k FROM pt) q JOIN e USING (j, k), t""")
def boltzmann_grid(spark, d):
    at = points(spark, d).select("c_custkey", grid.nearest_bin(F.col("x"), -3.0, 0.1, 61).alias("j"), grid.nearest_bin(F.col("y"), -2.5, 0.1, 61).alias("k"))
    return rounded(at.join(F.broadcast(models.boltzmann_grid(spark)), ["j", "k"]).select("c_custkey", "j", "k", "v", "p"))


@query(f"""WITH {PROFILE}, n AS (SELECT run, sum(piece) AS t FROM (SELECT run, (y + lag(y) OVER w) / 2 * (x - lag(x) OVER w) AS piece FROM profile WINDOW w AS (PARTITION BY run ORDER BY x)) GROUP BY run), p AS (SELECT run, x, y / t AS p, 1.0::DOUBLE / 49 AS q FROM profile JOIN n USING (run)),
l AS (SELECT *, ln(p / q) AS l FROM p), k AS (SELECT run, sum(piece) AS kl FROM (SELECT run, (p * l + lag(p * l) OVER w) / 2 * (x - lag(x) OVER w) AS piece FROM l WINDOW w AS (PARTITION BY run ORDER BY x)) GROUP BY run)
SELECT run, x, round(l - kl, 6) AS score, round(CASE WHEN l - kl > 0 THEN 1 - exp(-0.5::DOUBLE * (l - kl) * 0.01) ELSE 0 END, 8) AS p_death FROM l JOIN k USING (run)""")
def birth_death_weights(spark, d):
    p = grid.normalised(profile(spark, d), ["run"], "x", "y").withColumnRenamed("y", "p")
    s = estimators.scores(estimators.target_density(p, ["run"], "x", "uniform", 1.0), ["run"], "x", "p", "q")
    out = s.select("run", "x", "score", estimators.death_probability(F.col("score"), 0.5, 0.01).alias("p_death"))
    return rounded(out.withColumn("score", F.round("score", 6)), 8)


_U = "((('0x' || substr(md5('s:' || {0}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496"


@query(f"""SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_U.format("o_orderkey")}, o_orderkey) <= 25""")
def random_k(spark, d):
    return sampling.random_subset(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 25, "s").select("o_orderpriority", "o_orderkey")


@query(f"""SELECT o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln({_U.format("o_orderkey")}) / o_totalprice, o_orderkey) <= 25""")
def weighted_subset(spark, d):
    return sampling.weighted_subset(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", 25, "s").select("o_orderpriority", "o_orderkey")


@query(f"""WITH p AS (SELECT n_regionkey, n_nationkey, (sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::DOUBLE / sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey) AS upto FROM nation), a AS (SELECT r_regionkey AS n_regionkey, unnest(range(40)) AS draw FROM region), u AS (SELECT *, {_U.format("(n_regionkey * 100 + draw)")} AS u FROM a)
SELECT n_regionkey, draw, min(n_nationkey) AS n_nationkey FROM u JOIN p USING (n_regionkey) WHERE upto >= u GROUP BY ALL""")
def weighted_draw(spark, d):
    n = table(spark, d, "nation").withColumn("w", (F.col("n_nationkey") + 1).cast("long"))
    asked = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.explode(F.expr("sequence(0L, 39L)")).alias("draw"))
    asked = asked.withColumn("id", F.col("n_regionkey") * 100 + F.col("draw")).withColumn("u", sampling.uniform("s", "id"))
    return sampling.weighted_draws(n, "n_nationkey", "w", asked, "u", ["n_regionkey"])


_DENSITY = "(SELECT unnest(range(20000)) AS i)"


# The tail of Student's law by quadrature over the angle whose tangent is t / sqrt(dof).
@query(f"""WITH {PAIRS}, t AS (SELECT method, count(*) AS n, abs(avg(base - value) / (stddev_samp(base - value) / sqrt(count(*)))) AS t FROM pairs GROUP BY method), a AS (SELECT method, n, atan(t / sqrt(n - 1)) AS low FROM t),
p AS (SELECT method, n, sum(cos(low + (i + 0.5::DOUBLE) * (pi() / 2 - low) / 20000) ^ (n - 2)) * (pi() / 2 - low) / (sum(cos((i + 0.5::DOUBLE) * pi() / 40000) ^ (n - 2)) * pi() / 2) AS p FROM a, {_DENSITY} GROUP BY method, n, low) SELECT method, n, round(p, 6) AS t_p FROM p""")
def paired_t_pvalue(spark, d):
    return rounded(significance.paired_t_test(pairs(spark, d), ["method"]))


@query("""SELECT s_suppkey, round(4 * s_acctbal / 10000, 6) AS energetic, round(2 * ln((1 + s_nationkey) / 2.0::DOUBLE), 6) AS entropic, round((s_suppkey % 7 + s_suppkey % 5) / greatest((s_suppkey % 3) * 100, 1)::DOUBLE, 6) AS replaced FROM supplier""")
def barrier_and_replacement(spark, d):
    s = table(spark, d, "supplier")
    parts = estimators.barrier_decomposition(F.col("s_acctbal") / 10000, 4.0, 2, (1 + F.col("s_nationkey")).cast("double"), F.lit(2.0))
    replaced = estimators.replacement_fraction(F.col("s_suppkey") % 7, F.col("s_suppkey") % 5, F.col("s_suppkey") % 3, 100)
    return rounded(s.select("s_suppkey", *parts, replaced.cast("double").alias("replaced")))


