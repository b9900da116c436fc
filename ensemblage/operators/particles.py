"""Particles in a periodic box: neighbours within a cutoff, short-range repulsion, a dimer
with two lengths, and its reaction coordinate.

Neighbours come from cell lists: a particle meets those of its own and the adjoining
cells, so a configuration's pairs grow with its density and not with its square.  Particles
at one place are one site while sites meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept
from .grid import EPS, minimum_image, wrap


#: Ids of one site that may stand in one array: those with the same id // MEMBERS.
MEMBERS = 1 << 16
#: Ids of one site that stand in one row while they are paired with another's.
CROWD = 64
#: Meetings of particles, those of adjoining cells, that make a task's share; most tasks.
MEETINGS, TASKS = 1 << 27, 10_000


def sites(particles: DataFrame, box: list[str]) -> DataFrame:
    """(box, x, y, block, ids): the particles at each place, by blocks of ids."""
    xy = [F.col(c).cast("double").alias(c) for c in "xy"]
    return particles.select(*box, *xy, F.floor(F.col("id") / MEMBERS).alias("block"), "id").groupBy(*box, "x", "y", "block").agg(F.collect_list("id").alias("ids"))


def crowds(places: DataFrame, box: list[str]) -> DataFrame:
    """Sites with at most CROWD ids in a row; ``block`` tells a site's rows apart."""
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / CROWD).cast("int"))
    parts = F.transform(starts, lambda k: F.slice("ids", k * CROWD + 1, CROWD))
    split = places.select(*box, "x", "y", "block", F.posexplode(parts).alias("part", "ids"))
    return split.withColumn("block", F.struct("block", "part")).drop("part")


def _cells(cutoff: float, length: float) -> tuple[list[Column], int, Column]:
    """Cell of a place (cx, cy), cells a side, and the steps to the cells around."""
    cells = max(1, int(length // cutoff))
    side = length / cells
    at = [F.least(F.floor(wrap(F.col(c), length) / side).cast("int"), F.lit(cells - 1)).alias(f"c{c}") for c in "xy"]
    # With fewer than three cells a side an adjoining cell is the same one twice.
    steps = sorted({k % cells for k in (-1, 0, 1)})
    return at, cells, F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in steps for b in steps])


def _around(df: DataFrame, cutoff: float, length: float) -> DataFrame:
    """Rows of cells (cx, cy), once for each cell around (and for their own)."""
    _, cells, steps = _cells(cutoff, length)
    rest = [c for c in df.columns if c not in ("cx", "cy")]
    moved = [F.pmod(F.col(f"c{c}") + F.col(f"s.{k}"), F.lit(cells)).alias(f"c{c}") for c, k in (("x", "a"), ("y", "b"))]
    return df.withColumn("s", F.explode(steps)).select(*rest, *moved, "s")


def shares(places: DataFrame, box: list[str], cutoff: float, length: float) -> tuple[DataFrame, int] | None:
    """How the meetings of sites with ``ids`` are dealt to tasks: cells (box, cx, cy) with
    too many for one and the ``parts`` that each of their two sides is cut into; and
    how many tasks.  None where the meetings are few."""
    at, _, _ = _cells(cutoff, length)
    counts = places.select(*box, *at, F.size("ids").alias("n")).where("cx is not null and cy is not null").groupBy(*box, "cx", "cy").agg(F.sum("n").alias("n"))
    home = (F.col("s.a") == 0) & (F.col("s.b") == 0)
    met = _around(counts, cutoff, length).groupBy(*box, "cx", "cy").agg((F.sum(F.when(home, F.col("n"))).cast("double") * F.sum("n")).alias("met"))
    met = kept(met.where("met > 0"))
    total = met.agg(F.sum("met")).first()[0] or 0.0
    if total <= MEETINGS:
        return None
    crowded = met.where(F.col("met") > MEETINGS).select(*box, "cx", "cy", F.ceil(F.sqrt(F.col("met") / MEETINGS)).cast("int").alias("parts"))
    return crowded, min(TASKS, math.ceil(total / MEETINGS))


def site_pairs(places: DataFrame, box: list[str], cutoff: float, length: float, more: list[str], dealt: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Pairs of places (box, x, y, block) of one box within the cutoff of their nearest
    images, each pair once and each place with itself: dx, dy (from the second to the
    first), r, ``self``, and the columns ``more`` of both with the endings 1 and 2.
    ``dealt`` are ``shares``."""
    at, _, _ = _cells(cutoff, length)
    columns = ["x", "y", "block", *more]
    named = lambda k: [F.col(c).alias(f"{c}{k}") for c in columns]
    own = places.select(*box, *named(1), *at)
    other = _around(places.select(*box, *named(2), *at), cutoff, length).drop("s")
    keys = [*box, "cx", "cy"]
    if dealt is not None:
        crowded, tasks = dealt
        # A crowded cell is a square of parts: a row of one side goes to all parts of the other.
        part = lambda df, k: F.pmod(F.xxhash64(f"x{k}", f"y{k}", f"block{k}"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        cut = lambda df: df.join(crowded, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = cut(own).withColumn("p1", part(own, 1)).withColumn("p2", every).drop("parts")
        other = cut(other).withColumn("p2", part(other, 2)).withColumn("p1", every).drop("parts")
        keys = [*keys, "p1", "p2"]
        own, other = own.repartition(tasks, *keys), other.repartition(tasks, *keys).hint("merge")
    dx, dy = minimum_image(F.col("x1") - F.col("x2"), length), minimum_image(F.col("y1") - F.col("y2"), length)
    one, two = F.struct("x1", "y1", "block1"), F.struct("x2", "y2", "block2")
    near = own.join(other, keys).where(one <= two).select(*box, *[f"{c}{k}" for k in (1, 2) for c in more], (one == two).alias("self"), dx.alias("dx"), dy.alias("dy"))
    return near.withColumn("r", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where(F.col("r") <= cutoff)


def expanded(pairs: DataFrame, box: list[str], skip: tuple[int, int] | None = (0, 1)) -> DataFrame:
    """Pairs i < j of particles from pairs of sites with ``ids1`` and ``ids2``.

    What is compiled into one loop hands out its rows only when a row that came into the
    loop is done: with the join, all pairs of a site with all sites around.  Functions of
    higher order are not compiled and part the two: the loop then holds the pairs of two
    crowds.  (It also learns from them that no id is null.)"""
    present = lambda c: F.transform(c, lambda k: F.coalesce(k, F.lit(0)))
    pairs = pairs.withColumns({c: present(c) for c in ("ids1", "ids2")})
    each = pairs.withColumn("_a", F.explode("ids1")).drop("ids1").withColumn("_b", F.explode("ids2")).drop("ids2")
    first = F.col("_a") < F.col("_b")
    each = each.where(first | (~F.col("self") & (F.col("_a") != F.col("_b"))))
    turned = lambda c: F.when(first, F.col(c)).otherwise(0.0 - F.col(c)).alias(c)
    near = each.select(*box, F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"), turned("dx"), turned("dy"), "r")
    return near if skip is None else near.where(~((F.col("i") == skip[0]) & (F.col("j") == skip[1])))


def neighbours(particles: DataFrame, box: list[str], cutoff: float, length: float, skip: tuple[int, int] | None = (0, 1), digits: int | None = None) -> DataFrame:
    """Pairs i < j of one box within the cutoff of their nearest images: box, i, j, dx, dy
    (from j to i) and r.  Particles are (box, id, x, y) in a square of side ``length``;
    ``skip`` is a pair that has a bond of its own; ``digits`` rounds.

    Particles at one place are one site while distances are found (and rounded), so
    that a pair of particles costs no more than its row.  The rows are quadratic in a
    cell's particles: sites are counted first and their meetings dealt to tasks."""
    places = kept(crowds(sites(particles, box), box))
    pairs = site_pairs(places, box, cutoff, length, ["ids"], shares(places, box, cutoff, length))
    if digits is not None:
        pairs = pairs.withColumns({c: F.round(c, digits) for c in ("dx", "dy", "r")})
    return expanded(pairs, box, skip)


def repulsion(r: Column, sigma: float, epsilon: float, least: float) -> tuple[Column, Column]:
    """Energy of the repulsive part of a Lennard-Jones pair within its cutoff, and the
    energy's slope; distances below ``least`` sigmas count as that."""
    safe = F.greatest(r, F.lit(least * sigma))
    six = F.pow(sigma / safe, F.lit(6.0))
    return 4 * epsilon * (six * six - six) + epsilon, 24 * epsilon / safe * (six - 2 * six * six)


def bond(r: Column, height: float, width: float, rest: float) -> tuple[Column, Column]:
    """Energy of the dimer's double well in its length, and the energy's slope."""
    u = (r - rest - width) / width
    return height * (1 - u * u) * (1 - u * u), -4 * height * u * (1 - u * u) / width


def energies_and_forces(particles: DataFrame, box: list[str], length: float, sigma: float = 1.0, epsilon: float = 1.0, height: float = 1.0, width: float = 0.5, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(box, energy) and (box, id, fx, fy): repulsion of all pairs but the dimer (ids 0
    and 1), and the dimer's bond.  Particles that touch nothing have no force.

    Particles at one place act, and are acted on, as one site with their number, so that
    work grows with the pairs of places.  The dimer's two ends are places of their own."""
    cutoff = 2 ** (1 / 6) * sigma
    value, slope = repulsion(F.col("r"), sigma, epsilon, least)
    # In block: ends of the dimer by their ids, all others together.
    own = F.when(F.col("id").isin(0, 1), F.col("id")).otherwise(-1).cast("long").alias("block")
    named = particles.select(*box, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), own, "id")
    places = named.groupBy(*box, "x", "y", "block").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    pairs = site_pairs(places.withColumn("place", F.struct("x", "y", "block")), box, cutoff, length, ["place", "n"])
    dimer_pair = (F.least("place1.block", "place2.block") == 0) & (F.greatest("place1.block", "place2.block") == 1)
    met = F.when(F.col("self"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))
    pairs = pairs.where(~dimer_pair).withColumn("_met", met.cast("double")).where("_met > 0")
    pairs = pairs.select(*box, "place1", "place2", "n1", "n2", "self", "dx", "dy", (value * F.col("_met")).alias("v"), (-slope / F.greatest("r", F.lit(least * sigma))).alias("f"))
    dimer = dimers(particles, box, length)
    value, slope = bond(F.col("r"), height, width, cutoff)
    bonds = dimer.select(*box, "dx", "dy", value.alias("v"), (-slope / F.col("r")).alias("f"))
    energy = pairs.select(*box, "v").union(bonds.select(*box, "v")).groupBy(*box).agg(F.sum("v").alias("energy"))
    # What each particle of a place gets from the n particles of the other place; of its
    # own place it gets nothing, but has been touched.
    sides = F.array(F.struct(F.col("place1").alias("place"), F.col("n2").alias("n"), F.col("f").alias("s")), F.struct(F.col("place2").alias("place"), F.col("n1").alias("n"), (-F.col("f")).alias("s")))
    pulls = lambda e: (F.sum(F.col(f"{e}s") * F.col("dx")).alias("fx"), F.sum(F.col(f"{e}s") * F.col("dy")).alias("fy"))
    on = pairs.withColumn("e", F.explode(sides)).select(*box, "e.place", (F.col("e.s") * F.col("e.n")).alias("s"), "dx", "dy").groupBy(*box, "place").agg(*pulls(""))
    members = named.select(*box, F.struct("x", "y", "block").alias("place"), "id")
    crowd = members.join(on, [*box, "place"]).select(*box, "id", "fx", "fy")
    ends = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.col("f").alias("s")), F.struct(F.lit(1).cast("long").alias("id"), (-F.col("f")).alias("s")))
    pair = bonds.withColumn("e", F.explode(ends)).select(*box, "e.id", (F.col("e.s") * F.col("dx")).alias("fx"), (F.col("e.s") * F.col("dy")).alias("fy"))
    forces = crowd.unionByName(pair).groupBy(*box, "id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    return energy, forces


def dimers(particles: DataFrame, box: list[str], length: float) -> DataFrame:
    """(box, dx, dy, r): from particle 1 to particle 0 by their nearest images."""
    pick = lambda k, c: F.max(F.when(F.col("id") == k, F.col(c)))
    ends = particles.where("id <= 1").groupBy(*box).agg(*[pick(k, c).alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
    df = ends.select(*box, minimum_image(F.col("x0") - F.col("x1"), length).alias("dx"), minimum_image(F.col("y0") - F.col("y1"), length).alias("dy"))
    return df.withColumn("r", F.greatest(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(EPS)))


def coordinate(df: DataFrame, rest: float, width: float) -> DataFrame:
    """Adds the reaction coordinate ``z`` of dimers, 0 at the short and 1 at the long
    length, and its gradient for particle 0 (``gx``, ``gy``; particle 1 has the opposite)."""
    return df.withColumns({"z": (F.col("r") - rest) / (2 * width), "gx": F.col("dx") / (2 * width * F.col("r")), "gy": F.col("dy") / (2 * width * F.col("r"))})


def local_mean_force(df: DataFrame, f0: tuple[str, str], f1: tuple[str, str], width: float, beta: float) -> Column:
    """Energetic part along the dimer, less the entropic one of the plane."""
    along = F.col("dx") * (F.col(f1[0]) - F.col(f0[0])) + F.col("dy") * (F.col(f1[1]) - F.col(f0[1]))
    return width / F.col("r") * along - 2 * width / (beta * F.col("r"))


def gathered(state: DataFrame, chosen: DataFrame, keys: list[str], source: str, into: str = "id") -> DataFrame:
    """State after a resampling: the row ``into`` gets what the row ``source`` had."""
    rows = [c for c in state.columns if c not in (*keys, into)]
    moved = chosen.select(*keys, F.col(into).alias("_into"), F.col(source).alias(into))
    return moved.join(state, [*keys, into]).select(*keys, F.col("_into").alias(into), *rows)


def rest_length(sigma: float = 1.0) -> float:
    return 2 ** (1 / 6) * sigma


def xyz_lines(particles: DataFrame, box: str, element: str = "A") -> DataFrame:
    """Lines of an XYZ trajectory, a frame for each box: (frame, line, value)."""
    rows = particles.select(F.col(box).alias("frame"), (F.col("id") + 2).alias("line"), F.format_string(element + " %.6f %.6f 0.000000", F.col("x").cast("double"), F.col("y").cast("double")).alias("value"))
    heads = particles.groupBy(F.col(box).alias("frame")).agg(F.count("*").cast("string").alias("n"))
    heads = heads.select("frame", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line"), F.col("n").alias("value")), F.struct(F.lit(1).cast("long").alias("line"), F.concat(F.lit("frame "), F.col("frame").cast("string")).alias("value")))).alias("h"))
    return heads.select("frame", "h.*").union(rows)
