"""Joins of points with intervals by hierarchical cells.

The line is divided into cells of side 2^level on every level.  An interval belongs to the
level whose side is the least one not below its length, so it touches two cells at most.  A
point looks into its one cell on each level that any interval has.  So points and intervals
meet by equality of (keys, level, cell), which any join that Spark has can do, and what
meets is tested exactly; a point sees only intervals whose length or distance is near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .quantiles import same

#: Cells of a level are numbered exactly up to this power of two.
_DIGITS = 50
#: Intervals that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _level(low: Column, high: Column) -> Column:
    span = F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**-1000)))), F.lit(-1000))
    # An interval that is short for its place gets cells that are still told apart there.
    far = F.floor(F.log2(F.greatest(F.abs(low), F.abs(high), F.lit(2.0**-1000)))) - _DIGITS
    return F.greatest(span, far).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def within(points: DataFrame, x: Column, intervals: DataFrame, low: Column, high: Column, keys: list[str] = [], closed: tuple[bool, bool] = (True, True)) -> DataFrame:  # noqa: B006
    """Every point with every interval that holds it; an end belongs to an interval where
    ``closed`` says so.  ``keys`` must be equal, null to null; they come from the points,
    all other columns from both sides and must differ in name.  Intervals whose ends are
    null, NaN or infinite, or whose low end is above the high one, hold nothing."""
    size = F.abs(low) + F.abs(high)
    spans = intervals.withColumns({"_low": low.cast("double"), "_high": high.cast("double")}).where((size < float("inf")) & (low <= high))
    spans = spans.withColumn("_level", _level(F.col("_low"), F.col("_high")))
    # There are as many levels as binary orders of length: a few, 2100 at the very most.
    found = spans.groupBy("_level").count().collect()
    levels = [r[0] for r in found]
    cells = F.array_distinct(F.array(_cell(F.col("_low"), F.col("_level")), _cell(F.col("_high"), F.col("_level"))))
    spans = spans.withColumn("_cell", F.explode(cells))
    at = points.withColumn("_x", x.cast("double")).where("_x is not null and not isnan(_x)")
    looks = F.array(*[F.struct(F.lit(k).alias("_level"), _cell(F.col("_x"), F.lit(float(k))).alias("_cell")) for k in levels]) if levels else F.array().cast("array<struct<_level:int,_cell:bigint>>")
    at = at.withColumn("_look", F.explode(looks)).select(*points.columns, "_x", "_look._level", "_look._cell")
    above = F.col("_x") >= F.col("_low") if closed[0] else F.col("_x") > F.col("_low")
    below = F.col("_x") <= F.col("_high") if closed[1] else F.col("_x") < F.col("_high")
    # Few intervals have few cells, and a shuffle would bring all points of one to one task.
    few = sum(r[1] for r in found) <= BROADCAST_ROWS
    met = same(at, F.broadcast(spans) if few else spans, [*keys, "_level", "_cell"])
    return met.where(above & below).drop("_x", "_low", "_high", "_level", "_cell")


def counted(points: DataFrame, x: Column, intervals: DataFrame, low: Column, high: Column, closed: tuple[bool, bool] = (True, True), n: str = "n", least: str = "least", blocks: int | None = None) -> DataFrame:
    """The intervals that hold a point, with the number of points held and the least one.

    What ``within`` would give, counted, without making its pairs: points are summed up
    along the line, and each interval looks up the sums at its two ends, so that work grows
    with points and intervals whatever their overlap.  Ends and points are as there."""
    size = F.abs(low) + F.abs(high)
    spans = intervals.withColumns({"_low": low.cast("double"), "_high": high.cast("double")}).where((size < float("inf")) & (low <= high))
    row = F.struct(*intervals.columns)
    # Intervals that are equal in all columns stay apart by a name; both ends carry it.
    spans = scan.kept(spans.select(F.monotonically_increasing_id().alias("_i"), row.alias("_row"), "_low", "_high"))
    at = points.select(x.cast("double").alias("_x")).where("_x is not null and not isnan(_x)").groupBy("_x").agg(F.count("*").alias("_c"))
    none = F.lit(None).cast("double")
    # At one place: ends that leave its points out come before them, those that take them
    # in come after.
    ends = F.array(F.struct(F.col("_low").alias("_x"), F.lit(0 if closed[0] else 2).alias("_kind"), F.lit(True).alias("_first")), F.struct(F.col("_high").alias("_x"), F.lit(2 if closed[1] else 0).alias("_kind"), F.lit(False).alias("_first")))
    asked = spans.select("_i", F.explode(ends).alias("_e")).select("_e.*", "_i", F.lit(0).cast("long").alias("_c"), none.alias("_p"))
    line = at.select("_x", F.lit(1).alias("_kind"), F.lit(None).cast("boolean").alias("_first"), F.lit(None).cast("long").alias("_i"), "_c", F.col("_x").alias("_p")).unionByName(asked)
    # The sum up to an end is of the points below it; the next point is the last one in
    # the opposite order.
    line = line.withColumns({"_back": -F.col("_x"), "_kind_back": -F.col("_kind")})
    line = scan.running_sums(line, [], ["_x", "_kind"], {"_upto": F.col("_c")}, blocks)
    line = scan.carried(line, [], ["_back", "_kind_back"], ["_p"], blocks).where("_i is not null")
    pick = lambda first, c: F.max(F.when(F.col("_first") == first, F.col(c)))
    found = line.groupBy("_i").agg((pick(False, "_upto") - pick(True, "_upto")).alias(n), pick(True, "_p").alias(least)).where(F.col(n) > 0)
    return spans.join(found, "_i").select("_row.*", n, least)
