"""Scans along runs of any length: sums, ranks, neighbours, moving averages.

A run is not one window or one row.  Rows are dealt in ranges of (run, order) to blocks,
and a block's part of a run is summed up in one row: a sum, a last row, or for a moving
average the affine map ``t -> a t + b`` that the part is.  These compose associatively, so
a part's entry value is the composition of the parts before it (as many as there are
blocks, however long the run), and every part then goes on from its entry by itself.

Ranges are chosen by a sample, which may differ when it is taken again; so rows are
written once with the number of their block.  Order columns should be unique in a run;
rows that tie are in one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import kept
from .quantiles import same


def in_blocks(df: DataFrame, run: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """The rows with ``_block``; blocks follow each other in (run, order)."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *run, *order).withColumn("_block", F.spark_partition_id()))


def _parts(run: list[str]) -> Window:
    return Window.partitionBy(*run).orderBy("_block")


def _within(run: list[str], order: list[str], *more: str) -> Window:
    return Window.partitionBy(*run, "_block", *more).orderBy(*order)


def running_sums(df: DataFrame, run: list[str], order: list[str], sums: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """The rows with a column for each sum: its expression added up along the run, the
    row's own included.  Nulls add nothing."""
    rows = in_blocks(df.withColumns({f"_v_{name}": c for name, c in sums.items()}), run, order, blocks)
    names = list(sums)
    totals = rows.groupBy(*run, "_block").agg(*[F.coalesce(F.sum(f"_v_{s}"), F.lit(0)).alias(s) for s in names])
    earlier = _parts(run).rowsBetween(Window.unboundedPreceding, -1)
    entry = totals.select(*run, "_block", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_e_{s}") for s in names])
    upto = _within(run, order).rowsBetween(Window.unboundedPreceding, 0)
    both = same(rows, entry, [*run, "_block"])
    both = both.withColumns({s: F.col(f"_e_{s}") + F.coalesce(F.sum(f"_v_{s}").over(upto), F.lit(0)) for s in names})
    return both.drop("_block", *[f"{p}{s}" for s in names for p in ("_v_", "_e_")])


def ranked(df: DataFrame, run: list[str], order: list[str], out: str = "rank", blocks: int | None = None) -> DataFrame:
    """The rows with their place in the run, from 1."""
    return running_sums(df, run, order, {out: F.lit(1).cast("long")}, blocks)


def previous(df: DataFrame, run: list[str], order: list[str], columns: dict[str, str], blocks: int | None = None) -> DataFrame:
    """The rows with values of the row before, as new columns (name: column of before);
    null in the first row of a run."""
    rows = in_blocks(df, run, order, blocks)
    ends = rows.groupBy(*run, "_block").agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("_end"))
    entry = ends.select(*run, "_block", F.lag("_end").over(_parts(run)).alias("_entry"))
    w = _within(run, order)
    both = same(rows, entry, [*run, "_block"]).withColumn("_first", F.row_number().over(w) == 1)
    return both.withColumns({name: F.when(F.col("_first"), F.col(f"_entry.{c}")).otherwise(F.lag(c).over(w)) for name, c in columns.items()}).drop("_block", "_entry", "_first")


def cumulative_trapezoid(df: DataFrame, run: list[str], x: str, y: str, out: str = "cumulative", blocks: int | None = None) -> DataFrame:
    """Running trapezoid integral from 0 at the first point of each run."""
    pairs = previous(df, run, [x], {"_x": x, "_y": y}, blocks)
    piece = F.coalesce((F.col(y) + F.col("_y")) / 2 * (F.col(x) - F.col("_x")), F.lit(0.0))
    return running_sums(pairs, run, [x], {out: piece}, blocks).drop("_x", "_y")


def _positive(keep: float) -> float:
    """A rate of 0 would have no powers; this one is lost in a double's digits."""
    return max(keep, 1e-17)


def _links(rows: DataFrame, run: list[str], order: list[str], value: str, keep: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their place ``_i`` in a link, and a link's map: ``n`` rows and ``b``.

    Links are parts of a block so short that powers of ``keep`` stay far from overflow."""
    keep = _positive(keep)
    most = max(1, int(200 / -math.log(keep))) if keep < 1 else 1 << 30
    place = F.row_number().over(_within(run, order)) - 1
    rows = rows.withColumn("_place", place).withColumn("_link", F.floor(F.col("_place") / most).cast("long")).withColumn("_i", F.col("_place") % most)
    grown = F.col(value).cast("double") * F.pow(F.lit(1 / keep), F.col("_i") + 1)
    links = rows.groupBy(*run, "_block", "_link").agg(F.count("*").alias("n"), F.sum(grown).alias("_g"))
    return rows.withColumn("_grown", grown), links.select(*run, "_block", "_link", "n", (F.col("_g") * F.pow(F.lit(keep), F.col("n"))).alias("b"))


def _block_maps(links: DataFrame, run: list[str], keep: float) -> DataFrame:
    """A block's map t -> a t + b, from those of its links in order."""
    keep = _positive(keep)
    ordered = F.array_sort(F.collect_list(F.struct("_link", "n", "b")))
    return links.groupBy(*run, "_block").agg(F.sum("n").alias("n"), ordered.alias("_o")).select(*run, "_block", "n", F.pow(F.lit(keep), F.col("n")).alias("a"), F.aggregate("_o", F.lit(0.0), lambda t, m: t * F.pow(F.lit(keep), m["n"]) + m["b"]).alias("b"))


def decayed_last(df: DataFrame, run: list[str], order: list[str], value: str, keep: float, start: Column | float | None, out: str, blocks: int | None = None) -> DataFrame:
    """(run, out, n): t = keep t + (1 - keep) v at the end of each run, from ``start``, or
    from the first value if that is None.  Values must not be null."""
    rows = in_blocks(df.select(*run, *order, F.col(value).cast("double").alias("_v")), run, order, blocks)
    _, links = _links(rows.withColumn("_w", F.col("_v") * (1 - keep)), run, order, "_w", keep)
    maps = _block_maps(links, run, keep)
    whole = maps.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("_block", "a", "b"))).alias("_maps"), F.sum("n").alias("n"))
    if start is None:
        first = rows.groupBy(*run).agg(F.min_by("_v", F.struct(*order)).alias("_start"))
        whole = same(whole, first, run)
    else:
        whole = whole.withColumn("_start", F.lit(start).cast("double"))
    return whole.select(*run, F.aggregate("_maps", F.col("_start"), lambda t, m: t * m["a"] + m["b"]).alias(out), "n")


def decayed(df: DataFrame, run: list[str], order: list[str], value: str, keep: float, start: float = 0.0, out: str = "ema", blocks: int | None = None) -> DataFrame:
    """The rows with t = keep t + (1 - keep) v after each of them."""
    rows = in_blocks(df.withColumn("_w", F.col(value).cast("double") * (1 - keep)), run, order, blocks)
    keep = _positive(keep)
    rows, links = _links(rows, run, order, "_w", keep)
    links = kept(links)
    # A block's entry from the blocks before it, then a link's from the links before it.
    entry = kept(_block_maps(links, run, keep))
    chain = F.array_sort(F.collect_list(F.struct("_block", "a", "b")).over(_parts(run).rowsBetween(Window.unboundedPreceding, -1)))
    entry = entry.select(*run, "_block", F.aggregate(chain, F.lit(float(start)), lambda t, m: t * m["a"] + m["b"]).alias("_t"))
    inner = F.array_sort(F.collect_list(F.struct("_link", "n", "b")).over(Window.partitionBy(*run, "_block").orderBy("_link").rowsBetween(Window.unboundedPreceding, -1)))
    links = same(links.withColumn("_before", inner), entry, [*run, "_block"])
    links = links.select(*run, "_block", "_link", F.aggregate("_before", F.col("_t"), lambda t, m: t * F.pow(F.lit(keep), m["n"]) + m["b"]).alias("_t"))
    both = same(rows, links, [*run, "_block", "_link"])
    upto = _within(run, order, "_link").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("_grown").over(upto)
    return both.withColumn(out, (F.col("_t") + own) * F.pow(F.lit(keep), F.col("_i") + 1)).drop("_block", "_link", "_place", "_i", "_grown", "_w", "_t")


def carried(df: DataFrame, run: list[str], order: list[str], columns: list[str], blocks: int | None = None) -> DataFrame:
    """The rows with ``columns`` replaced by their last value that is not null, of this
    row or of one before it in the run."""
    rows = in_blocks(df, run, order, blocks)
    ends = rows.groupBy(*run, "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_l_{c}") for c in columns])
    earlier = _parts(run).rowsBetween(Window.unboundedPreceding, -1)
    entry = ends.select(*run, "_block", *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_e_{c}") for c in columns])
    upto = _within(run, order).rowsBetween(Window.unboundedPreceding, 0)
    both = same(rows, entry, [*run, "_block"])
    return both.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_e_{c}")) for c in columns}).drop("_block", *[f"_e_{c}" for c in columns])


def interpolated(points: DataFrame, nodes: DataFrame, run: list[str], x: str, y: str, outside: float | None = None, blocks: int | None = None) -> DataFrame:
    """The points with ``y``: linear between the nodes of their run on both sides, whose
    distances may differ; the end value beyond the ends, or ``outside``.

    Every node carries its segment to the next one; points and nodes are merged in one
    sort and each point takes the last segment that began.  Points of a run without nodes
    get null; of nodes with one x the last by y counts; null x and null nodes are passed
    over (such points get null)."""
    known = nodes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*run, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    known = known.groupBy(*run, "_x").agg(F.max("_y").alias("_y"))
    segments = previous(known.withColumn("_back", -F.col("_x")), run, ["_back"], {"_nx": "_x", "_ny": "_y"}, blocks).drop("_back")
    left = segments.select(*run, "_x", F.lit(0).alias("_kind"), F.struct(F.col("_x").alias("x0"), F.col("_y").alias("y0"), F.col("_nx").alias("x1"), F.col("_ny").alias("y1")).alias("_s"), F.lit(None).cast(points.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    asked = points.select(*run, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_row"))
    merged = carried(left.unionByName(asked), run, ["_x", "_kind"], ["_s"], blocks).where("_kind = 1")
    first = known.groupBy(*run).agg(F.min_by("_y", "_x").alias("_fy"))
    merged = same(merged, first, run, "left") if run else merged.crossJoin(F.broadcast(first))
    s = {k: F.col(f"_s.{k}") for k in ("x0", "y0", "x1", "y1")}
    between = s["y0"] + (s["y1"] - s["y0"]) * F.try_divide(F.col("_x") - s["x0"], s["x1"] - s["x0"])
    end = F.lit(outside).cast("double") if outside is not None else None
    below = F.col("_fy") if end is None else F.when(F.col("_fy").isNotNull(), end)
    beyond = s["y0"] if end is None else F.when(F.col("_x") == s["x0"], s["y0"]).otherwise(end)
    value = F.when(F.col("_x").isNull(), None).when(F.col("_s").isNull(), below).when(s["x1"].isNull(), beyond).otherwise(between)
    return merged.select(*[F.col("_row").getField(c).alias(c) for c in points.columns if c != y], value.alias(y))
